"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

The lexicon (words and word beginnings of four to six bytes whose documents are far more often toxic), the trees and
the calibration are each learned from a part of their own of the labelled rows, which are a bounded sample: the
``FIT_ROWS`` labelled documents of the smallest id hashes, of the folds that may be learned from. Features are rates
over the whole text: lexicon densities, second-person words and their nearness to lexicon words, capitals,
punctuation, symbols within words. Scores depend on the text alone.

Defined results: null and empty texts get the score of a text without words; repeated rows get equal scores; an empty
table gives no rows; a null doc_id counts as held out from nothing (false) and is scored; without labels of both
kinds every score is the share of toxic labels (0 if there are none); other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, materialise, table, tidy
from .wordtable import intern, slices, spans, text_bytes, words_of

#: Parameters of the fit: labelled rows, terms of the lexicon, and the toxic documents and log odds that a term needs.
FIT_ROWS, LEXICON, LEAST_DOCS, LEAST_ODDS, CUT = 24_000, 2_000, 3, 2.3, 0.7
#: Second-person words of the languages at hand.
SECOND_PERSON = frozenset("you your yours yourself yourselves u ur du dich dir dein deine deinen deiner deines ihr euch euer eure tu te toi ton ta tes vous votre vos tú ti tuyo tuya usted ustedes vosotros vuestro vuestra".split())
FEATURES = ("word_density", "stem_density", "hits", "strongest", "odds_density", "near_second", "second_density", "capitals", "shouted", "exclaims", "questions", "marks", "obfuscated", "digits", "log_words", "word_length")
NEAR = 3


def _folded(flat: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and the two-byte letters of Latin-1."""
    out = flat + (((flat >= 65) & (flat <= 90)) * np.uint8(32))
    wide = np.zeros(len(flat), bool)
    wide[1:] = (flat[:-1] == 0xC3) & (flat[1:] >= 0x80) & (flat[1:] <= 0x9E) & (flat[1:] != 0x97)
    return out + (wide * np.uint8(32))


def _word_mask(flat: np.ndarray) -> np.ndarray:
    return (flat >= 0x80) | ((flat >= 97) & (flat <= 122)) | ((flat >= 48) & (flat <= 57)) | ((flat >= 65) & (flat <= 90))


def _terms(word: bytes) -> list[bytes]:
    """The word itself, and its beginnings marked by a star; a cut within a letter of two bytes does no harm."""
    return [word, *(word[:k] + b"*" for k in (4, 5, 6) if len(word) > k)]


def term_counts(column: pa.Array, toxic: np.ndarray) -> tuple[dict[bytes, int], dict[bytes, int]]:
    """In how many toxic and other rows of the batch each term occurs."""
    flat, offsets = text_bytes(column)
    starts, ends = spans(~_word_mask(flat), offsets)
    codes, rep = intern(folded := _folded(flat), starts, ends)
    row = np.searchsorted(offsets, starts, side="right") - 1
    pairs = np.unique(row * (len(rep) + 1) + codes)
    owner, code = pairs // (len(rep) + 1), pairs % (len(rep) + 1)
    words = words_of(folded, starts, ends, rep)
    found: tuple[dict, dict] = ({}, {})
    at = np.searchsorted(owner, np.arange(len(toxic) + 1))
    for r in range(len(toxic)):
        mine = found[0 if toxic[r] else 1]
        for t in {t for c in code[at[r] : at[r + 1]].tolist() for t in _terms(words[c])}:
            mine[t] = mine.get(t, 0) + 1
    return found


def features_of(column: pa.Array, lexicon: dict[bytes, float]) -> np.ndarray:
    """A row of FEATURES per text."""
    flat, offsets = text_bytes(column)
    n = len(offsets) - 1
    out = np.zeros((n, len(FEATURES)))
    if not len(flat):
        return out
    folded = _folded(flat)
    starts, ends = spans(~_word_mask(flat), offsets)
    per = lambda mask: np.diff(np.append(0, np.cumsum(mask))[offsets])
    size = np.maximum(np.diff(offsets), 1).astype(float)
    upper, lower = (flat >= 65) & (flat <= 90), (flat >= 97) & (flat <= 122)
    letter = upper | lower | (flat >= 0x80)
    odd = np.isin(flat, np.frombuffer(b"@$*013457!|.", np.uint8))
    inside = np.zeros(len(flat), bool)
    inside[1:-1] = odd[1:-1] & letter[:-2] & letter[2:]
    digit = (flat >= 48) & (flat <= 57)
    blank = (flat == 32) | ((flat >= 9) & (flat <= 13))
    words = np.zeros(n)
    if len(starts):
        codes, rep = intern(folded, starts, ends)
        row = np.searchsorted(offsets, starts, side="right") - 1
        words = np.bincount(row, minlength=n).astype(float)
        heads = {t[:3] for t in lexicon} | {w.encode()[:3] for w in SECOND_PERSON}
        whole, stem, second = np.zeros(len(rep)), np.zeros(len(rep)), np.zeros(len(rep), bool)
        people = {w.encode() for w in SECOND_PERSON}
        for k, w in enumerate(words_of(folded, starts, ends, rep)):
            if w[:3] in heads:
                second[k] = w in people
                terms = _terms(w)
                whole[k] = lexicon.get(terms[0], 0.0)
                stem[k] = max((lexicon.get(t, 0.0) for t in terms[1:]), default=0.0)
        whole, stem, second = whole[codes], stem[codes], second[codes]
        odds = np.maximum(whole, stem)
        hit = odds > 0
        add = lambda v: np.bincount(row, weights=v, minlength=n)
        many = np.maximum(words, 1)
        out[:, 0], out[:, 1] = add(whole > 0) / many, add(stem > 0) / many
        out[:, 2] = np.log1p(add(hit))
        np.maximum.at(out[:, 3], row, odds)
        out[:, 4] = add(odds) / many
        # nearness: lexicon words with a second-person word at most NEAR words away in the same text
        where = np.flatnonzero(second)
        if len(where):
            right = np.minimum(np.searchsorted(where, np.arange(len(row))), len(where) - 1)
            left = np.maximum(right - 1, 0)
            place = np.arange(len(row))
            near = ((np.abs(where[right] - place) <= NEAR) & (row[where[right]] == row)) | ((np.abs(where[left] - place) <= NEAR) & (row[where[left]] == row))
            out[:, 5] = add(near & hit) / many
        out[:, 6] = add(second) / many
        ups = np.append(0, np.cumsum(upper))
        length = ends - starts
        out[:, 8] = add((length > 1) & (ups[ends] - ups[starts] == length)) / many
        out[:, 15] = add(length) / many
    out[:, 7] = per(upper) / np.maximum(per(letter), 1)
    out[:, 9], out[:, 10] = per(flat == 33) / size, per(flat == 63) / size
    out[:, 11] = per(~letter & ~digit & ~blank) / size
    out[:, 12] = per(inside) / np.maximum(words, 1)
    out[:, 13] = per(digit) / size
    out[:, 14] = np.log1p(words)
    return out


# ------------------------------------------------------------------------------------------- trees and calibration


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.2, bins: int = 32, least: float = 2.0) -> tuple:
    """Trees of Newton steps on the logistic loss over quantile bins: (first score, [(feature, cut, value) arrays])."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    # rates are zero for most rows, so quantiles alone would miss the cut between none and some
    cuts = [np.unique(np.append(c, x[x[:, f] > 0, f].min() / 2)) if (x[:, f] > 0).any() else c for f, c in enumerate(cuts)]
    binned = np.stack([np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(cuts)], 1)
    width = max(len(c) for c in cuts) + 1
    start = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    score, trees = np.full(len(y), start), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, cut = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, np.inf)
        for level in range(depth):
            n_nodes, base = 1 << level, (1 << level) - 1
            best = np.full(n_nodes, 1e-6)
            for f in range(x.shape[1]):
                if not len(cuts[f]):
                    continue
                key = node * width + binned[:, f]
                gs = np.bincount(key, g, n_nodes * width).reshape(n_nodes, width).cumsum(1)
                hs = np.bincount(key, h, n_nodes * width).reshape(n_nodes, width).cumsum(1)
                gl, hl, gt, ht = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                gain = np.where((hl >= least / 10) & (ht - hl >= least / 10), gain, 0)[:, : len(cuts[f])]
                at = gain.argmax(1)
                won = gain[np.arange(n_nodes), at] > best
                best = np.where(won, gain[np.arange(n_nodes), at], best)
                feature[base : base + n_nodes][won], cut[base : base + n_nodes][won] = f, cuts[f][at[won]]
            here = base + node
            node = 2 * node + (x[np.arange(len(y)), feature[here]] >= cut[here])
        value = rate * np.bincount(node, g, 1 << depth) / (np.bincount(node, h, 1 << depth) + 1)
        score = score + value[node]
        trees.append((feature, cut, value))
    return start, trees, depth


def raw_score(model: tuple, x: np.ndarray) -> np.ndarray:
    start, trees, depth = model
    out, rows = np.full(len(x), start), np.arange(len(x))
    for feature, cut, value in trees:
        node = np.zeros(len(x), np.int64)
        for level in range(depth):
            here = (1 << level) - 1 + node
            node = 2 * node + (x[rows, feature[here]] >= cut[here])
        out += value[node]
    return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: block bounds in score, and the share of positives of each block."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, v in zip(score[order].tolist(), y[order].tolist(), strict=True):
        if blocks and blocks[-1][3] == s:
            blocks[-1][0] += v
            blocks[-1][1] += 1
        else:
            blocks.append([v, 1, s, s])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            v2, n2, _, hi = blocks.pop()
            blocks[-1][0] += v2
            blocks[-1][1] += n2
            blocks[-1][3] = hi
    centre = np.array([(b[2] + b[3]) / 2 for b in blocks])
    share = np.array([b[0] / b[1] for b in blocks])
    return centre, share


def calibrated(curve: tuple[np.ndarray, np.ndarray], raw: np.ndarray) -> np.ndarray:
    """The curve, and a small part of the squashed score, so that order within a block is kept."""
    smooth = 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
    return np.clip(0.98 * np.interp(raw, *curve) + 0.02 * smooth, 0.0, 1.0)


# ------------------------------------------------------------------------------------------- Spark


class Model:
    def __init__(self, lexicon: dict[bytes, float], trees: tuple | None, curve: tuple | None, share: float):
        self.lexicon, self.trees, self.curve, self.share = lexicon, trees, curve, share

    def score(self, column: pa.Array) -> np.ndarray:
        out = [np.zeros(0)]
        for first, last in slices(column):
            if self.trees is None:
                out.append(np.full(last - first, self.share))
            else:
                out.append(calibrated(self.curve, raw_score(self.trees, features_of(column.slice(first, last - first), self.lexicon))))
        return np.concatenate(out)


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Learns from the labels of all folds but 1."""
    chosen = (
        labels.where(F.col("toxic").isNotNull() & (crc_fold(F.col("doc_id").cast("long")) != 1))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    )
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    part = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(10))
    sample = materialise(ids.join(F.broadcast(chosen), "doc_id").withColumn("part", part), "labelled")
    if not sample.select("toxic").where("toxic = 1").limit(1).count():
        return Model({}, None, None, 0.0)

    def count(batches):
        both: tuple[dict, dict] = ({}, {})
        for batch in batches:
            toxic = batch.column(1).to_numpy() == 1
            for first, last in slices(batch.column(0)):
                for mine, more in zip(both, term_counts(batch.column(0).slice(first, last - first), toxic[first:last]), strict=True):
                    for t, k in more.items():
                        mine[t] = mine.get(t, 0) + k
        terms = list(both[0] | both[1])
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.binary()), *(pa.array([d.get(t, 0) for t in terms], pa.int64()) for d in both)], names=["term", "bad", "good"])

    learned = sample.where("part < 5")
    sizes = {r.toxic: r.n for r in learned.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = sizes.get(1, 0), sum(n for k, n in sizes.items() if k != 1)
    odds = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (good + 1))
    counts = learned.select("text", "toxic").mapInArrow(tidy(count), "term binary, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    top = counts.where(F.col("bad") >= LEAST_DOCS).withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS).orderBy(F.desc(F.col("odds") * F.col("bad")), "term").limit(LEXICON)
    lexicon = {bytes(r.term): float(r.odds) for r in top.select("term", "odds").collect()}

    def extract(batches):
        for batch in batches:
            for first, last in slices(batch.column(0)):
                x = features_of(batch.column(0).slice(first, last - first), lexicon)
                yield pa.RecordBatch.from_arrays([batch.column(k).slice(first, last - first) for k in (1, 2, 3)] + [pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "toxic", "part", "x"])

    rows = sample.where("part >= 5").select("text", "doc_id", "toxic", F.col("part").cast("int").alias("part")).mapInArrow(tidy(extract), "doc_id long, toxic int, part int, x array<double>")
    got = sorted(rows.collect(), key=lambda r: r.doc_id)  # FIT_ROWS rows of sixteen numbers at most
    x, y = np.array([r.x for r in got]).reshape(-1, len(FEATURES)), np.array([float(r.toxic == 1) for r in got])
    trees_from = np.array([r.part < 8 for r in got], bool)
    share = float(y.mean()) if len(y) else 0.0
    if not 0 < y[trees_from].sum() < trees_from.sum() or not 0 < y[~trees_from].sum() < (~trees_from).sum():
        return Model(lexicon, None, None, share)
    trees = boost(x[trees_from], y[trees_from])
    return Model(lexicon, trees, isotonic(raw_score(trees, x[~trees_from]), y[~trees_from]), share)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(model.score(batch.column(1)))], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("held_out", F.coalesce(crc_fold(F.col("doc_id")) == 1, F.lit(False)))
    return rows.mapInArrow(tidy(run), "doc_id long, held_out boolean, score double").withColumn("predicted", F.when(F.col("score") >= CUT, 1).otherwise(0))


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The documents, all their columns as they are, without those of a score of CUT or more."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            column = batch.column(at)
            yield batch.filter(pa.array(model.score(column) < CUT))

    return docs.mapInArrow(tidy(run), docs.schema)


def op6(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


