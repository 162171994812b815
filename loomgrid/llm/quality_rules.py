"""Quality rules: a learned decision list over text statistics, on built-in Spark functions alone.

Sequential covering learns the list from labelled statistics: each rule is a conjunction of thresholds, grown
condition by condition on two thirds of the labelled rows (FOIL gain) and pruned on the last third; rows that a
rule covers leave, and the next rule is grown on the rest. The list is emitted as one ordered CASE expression
over the statistics, which is all that runs over the documents: no Python sees a row.

Defined results: null text counts as empty (no words, so it fails the base rule); repeated rows are judged one by
one; an empty table gives an empty result; no labels give an empty list, which keeps what the base rule keeps;
other columns of the input are passed through, but for those named like a statistic, which are replaced, and those that
begin with an underscore, which are reserved.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the contract: blanks between words, symbols, and the base rule's thresholds.
GAP = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Labelled rows that the list is fitted on at most (those of the smallest hashes of their id).
FIT_ROWS = 40_000

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATIOS = ("symbol_rate", "upper_rate", "digit_rate", "exclaim_rate", "mean_word", "dup_line_rate", "repeat_rate")


def _with_covered(df: DataFrame, hashes: str) -> DataFrame:
    """Adds _covered: words in a 3-word window found twice or more, from the hashes of all windows in order.

    Sorted by (hash, place), a repeated window stands beside its equal; the places of those windows, sorted
    again, each add the words that the window before did not cover. Everything is O(n log n), and arrays are
    only built for texts in which a hash occurs twice.
    """
    h = F.col(hashes)
    n = F.size(h)
    ranked = F.sort_array(F.arrays_zip(h.alias("h"), F.sequence(F.lit(1), n).alias("i")))
    df = df.withColumn("_ranked", F.when(F.size(F.array_distinct(h)) < n, ranked))
    r, n = F.col("_ranked"), F.size("_ranked")
    # each place twice at most: with the next of the same hash, and with the one before
    pair = F.zip_with(F.slice(r, F.lit(1), n - 1), F.slice(r, F.lit(2), n - 1), lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], y["i"])))
    df = df.withColumn("_places", F.when(r.isNotNull(), F.sort_array(F.array_distinct(F.flatten(F.filter(pair, lambda z: z.isNotNull()))))))
    p = F.col("_places")
    m = F.size(p)
    # the first covers three words, each other one at most three, and no more than the distance to the one before
    steps = F.zip_with(F.slice(p, F.lit(1), m - 1), F.slice(p, F.lit(2), m - 1), lambda x, y: F.least(F.lit(3), y - x))
    total = F.aggregate(steps, F.lit(3), lambda acc, x: acc + x)
    return df.withColumn("_covered", F.when(p.isNull(), F.lit(0)).otherwise(total).cast("long")).drop("_ranked", "_places")


def statistics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and the RATIOS (double)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = df.withColumn("_words", F.filter(F.split(text, GAP + "+"), lambda w: w != ""))
    n = F.size("_words")
    triples = F.arrays_zip(F.slice("_words", F.lit(1), n - 2).alias("a"), F.slice("_words", F.lit(2), n - 2).alias("b"), F.slice("_words", F.lit(3), n - 2).alias("c"))
    hashes = F.transform(triples, lambda z: F.xxhash64(z["a"], z["b"], z["c"]))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = out.withColumns({
        "_hashes": F.when(n >= 3, hashes).otherwise(F.array().cast("array<bigint>")),
        "_lines": lines,
        "_bare": F.array_join("_words", ""),
    })
    out = _with_covered(out, "_hashes")
    size = F.length("_bare")
    only = lambda kept: F.length(F.regexp_replace("_bare", f"[^{kept}]+", "")).cast("long")
    out = out.withColumns({
        "n_words": n.cast("long"),
        "word_chars": size.cast("long"),
        "n_symbols": only(SYMBOLS),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.col("_covered"),
        "_n_lines": F.size("_lines").cast("long"),
        "_upper": only("A-Z"),
        "_digit": only("0-9"),
        "_exclaim": (size - F.length(F.replace("_bare", F.lit("!")))).cast("long"),
    }).drop("_words", "_hashes", "_lines", "_bare", "_covered")
    rate = lambda a, b: F.coalesce(F.col(a) / F.when(F.col(b) > 0, F.col(b)), F.lit(0.0))
    out = out.withColumns({
        "symbol_rate": rate("n_symbols", "word_chars"),
        "upper_rate": rate("_upper", "word_chars"),
        "digit_rate": rate("_digit", "word_chars"),
        "exclaim_rate": rate("_exclaim", "word_chars"),
        "mean_word": rate("word_chars", "n_words"),
        "dup_line_rate": rate("n_dup_lines", "_n_lines"),
        "repeat_rate": rate("n_repeat_words", "n_words"),
    })
    # a generator of one row: predicates on statistics stay above it, else the optimizer would copy the whole
    # expression of each into the filter and evaluate the word array once per word
    stats = [c for c in out.columns if c not in df.columns and not c.startswith("_") or c in COUNTS + RATIOS]
    return out.select(*[c for c in df.columns if c not in stats], F.inline(F.array(F.struct(*stats))))


# ------------------------------------------------------------------------------------------- the learner

Condition = tuple[str, str, float]


def _holds(cond: Condition, row: dict) -> bool:
    name, op, cut = cond
    return row[name] >= cut if op == ">=" else row[name] < cut


def _cuts(values: list[float], most: int = 32) -> list[float]:
    distinct = sorted(set(values))
    if len(distinct) <= 1:
        return []
    step = max(1, len(distinct) // most)
    return [(distinct[i - 1] + distinct[i]) / 2 for i in range(step, len(distinct), step)]


def _best(rows: list[dict], bad: list[bool], features: tuple[str, ...]) -> tuple[float, Condition | None]:
    """The condition of the largest FOIL gain among the thresholds of all features."""
    p0, n0 = sum(bad), len(bad) - sum(bad)
    base = math.log2(p0 / (p0 + n0))
    found: tuple[float, Condition | None] = (0.0, None)
    for name in features:
        column = [r[name] for r in rows]
        order = sorted(range(len(rows)), key=column.__getitem__)
        cuts = _cuts(column)
        below_p = below_n = at = 0
        for cut in cuts:
            while at < len(order) and column[order[at]] < cut:
                below_p, below_n, at = below_p + bad[order[at]], below_n + (not bad[order[at]]), at + 1
            for op, p, n in (("<", below_p, below_n), (">=", p0 - below_p, n0 - below_n)):
                gain = p * (math.log2(p / (p + n)) - base) if p else 0.0
                if gain > found[0] + 1e-9:
                    found = (gain, (name, op, cut))
    return found


def _precision(rule: list[Condition], rows: list[dict], bad: list[bool]) -> float:
    got = [b for r, b in zip(rows, bad, strict=True) if all(_holds(c, r) for c in rule)]
    return (sum(got) + 0.5) / (len(got) + 1.0)


def learn(rows: list[dict], bad: list[bool], features: tuple[str, ...] = RATIOS, most_rules: int = 12, longest: int = 4, floor: float = 0.85, least: int = 8) -> list[list[Condition]]:
    """Rules, in order, that reject: a rule stays while it is right for ``floor`` of the pruning rows it covers."""
    rules: list[list[Condition]] = []
    while len(rules) < most_rules and sum(bad) >= least:
        grow = [i for i in range(len(rows)) if i % 3]
        prune = [i for i in range(len(rows)) if not i % 3]
        at, rule = grow, []
        while len(rule) < longest and any(bad[i] for i in at) and not all(bad[i] for i in at):
            _, cond = _best([rows[i] for i in at], [bad[i] for i in at], features)
            if cond is None:
                break
            rule.append(cond)
            at = [i for i in at if _holds(cond, rows[i])]
        held, held_bad = [rows[i] for i in prune], [bad[i] for i in prune]
        while len(rule) > 1 and _precision(rule[:-1], held, held_bad) >= _precision(rule, held, held_bad):
            rule = rule[:-1]
        covered = [all(_holds(c, r) for c in rule) for r in rows] if rule else []
        if not rule or _precision(rule, held, held_bad) < floor or sum(covered) < least:
            break
        rules.append(rule)
        rows, bad = [r for r, c in zip(rows, covered, strict=True) if not c], [b for b, c in zip(bad, covered, strict=True) if not c]
    return rules


def as_column(rules: list[list[Condition]]) -> Column:
    """The list as one ordered conditional expression: the number of the first rule that holds, else null."""
    out = None
    for k, rule in enumerate(rules):
        cond = None
        for name, op, cut in rule:
            one = F.col(name) >= F.lit(cut) if op == ">=" else F.col(name) < F.lit(cut)
            cond = one if cond is None else cond & one
        out = F.when(cond, F.lit(k)) if out is None else out.when(cond, F.lit(k))
    return F.lit(None).cast("int") if out is None else out


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> list[list[Condition]]:
    """Learns the list from the labelled documents; at most ``fit_rows`` labels, by the hash of their id."""
    chosen = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    stats = with_base(statistics(texts)).where(~F.col("base_failed")).select("doc_id", "quality", *RATIOS)
    rows = [r.asDict() for r in stats.collect()]  # at most fit_rows rows of eight numbers
    rows.sort(key=lambda r: tuple(r[k] for k in ("doc_id", *RATIOS)))
    return learn(rows, [r["quality"] == 0 for r in rows])


def with_base(stats: DataFrame) -> DataFrame:
    return stats.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def judge(docs: DataFrame, rules: list[list[Condition]], text_col: str = "text") -> DataFrame:
    """Adds the statistics, base_failed, rule (int, of the list; null: none) and kept."""
    judged = with_base(statistics(docs, text_col)).withColumn("rule", as_column(rules))
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def op8(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rules = fit(docs, table(spark, sf_dir, "labels"))
    return judge(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
