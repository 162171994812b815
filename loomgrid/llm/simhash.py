"""SimHash near-duplicates by generalised pigeonhole.

Fingerprints: 64-bit SimHash of XXH64 (seed 42) over shingles of words. Equal fingerprints collapse at once, so a
group of copies is one node. The bits are grouped into partitions of correlated bits, and each partition gets its own
threshold: with m partitions whose thresholds sum to tau - m + 1, two fingerprints within tau bits agree on some
partition within its threshold. Number of partitions and thresholds come from dynamic programming over the estimated
candidate pairs and the probes each threshold costs. Every node is filed under its value of each partition and probes
all values within the threshold; nodes that meet are verified on all 64 bits.

A task joins what meets within it into trees and emits only their edges, never all pairs; where many meet, trees grow
from node to node and what is in a tree is not met again, so a dense group costs about one pass. A value that more than
``GROUP`` nodes meet under is dealt again by the remaining bits (the same pigeonhole, one exact block of tau + 1), as
often as needed up to ``DEALS`` times. Components then come from rounds of large-star and small-star over the edges,
each written to the shared folder; keys that many rows share are dealt over tasks.

``similar`` finds near copies by the Jaccard similarity of their sets of shingles (``SIMILAR``, five words). A
similarity of 0.8 makes about 10 of 64 bits differ, so fingerprints have 128 bits: 64 are probed within ``REACH_64``
bits, all 128 verified within ``REACH_128``, and an exact check of the sets follows, in which every two members of a
component of candidates are compared in blocks of bounded size. Texts that are similar but differ in more bits are
missed (the README has the share).

Defined results: a text without words has fingerprint zero and is linked like any other; null text counts as empty;
rows with a null doc_id take part, but never name a component that has an id; repeated rows share a fingerprint and
so a component; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, id_text, materialise, spread_join, table, tidy
from .wordtable import ragged, slices, spans, text_bytes

TAU, SHINGLE, SEED = 3, 3, 42
#: Nodes under one value before it is dealt again, and how often at most; rows that a task holds in the probe; pairs
#: under one value from which trees are grown node by node; pairs that can be compared in the time that a probe takes;
#: nodes that a plan is made for at least.
GROUP, DEALS, TASK_ROWS, DENSE, PROBE_COST, PLAN_NODES = 4096, 3, 500_000, 1 << 25, 200.0, 1_000_000
#: Near copies by their sets of shingles: words of a shingle, similarity, bits of 64 and of 128 that may differ.
WORDS, SIMILAR, REACH_64, REACH_128 = 5, 0.8, 12, 26
#: Texts, and shingles of all their sets, of a block of the exact check; ids up to which a list of them is broadcast.
BLOCK_TEXTS, BLOCK_SHINGLES, FEW_IDS = 2_000, 4_000_000, 200_000
#: Bytes of text that are hashed at once; pairs of nodes, or shingles of sets, that are compared at once.
TEXT_BYTES, PIECE = 1 << 20, 1 << 18


# ------------------------------------------------------------------------------------------- fingerprints


def shingle_hashes(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle of a batch of texts, repeats included, and the number of each text's."""
    from xxhash import xxh64_intdigest

    flat, offsets = text_bytes(column)
    n = len(offsets) - 1
    upper = (flat >= 65) & (flat <= 90)
    flat = flat + (upper * np.uint8(32))
    starts, ends = spans((flat == 32) | ((flat >= 9) & (flat <= 13)), offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    size = ends - starts + 1
    joined = np.append(flat, np.uint8(32))[ragged(starts, size)]
    after = np.cumsum(size)
    joined[after - 1] = 32  # one blank after each word, whatever stood there
    begin, end = after - size, after - 1
    row = np.searchsorted(offsets, starts, side="right") - 1
    words = np.bincount(row, minlength=n)
    shingles = np.where(words > 0, np.maximum(words - width + 1, 1), 0)
    first = np.cumsum(words) - words
    at = ragged(first, shingles)
    owner = np.repeat(np.arange(n), shingles)
    last = np.minimum(at + width - 1, (first + words - 1)[owner])
    raw = joined.tobytes()
    return np.array([xxh64_intdigest(raw[a:b], SEED) for a, b in zip(begin[at].tolist(), end[last].tolist(), strict=True)], np.uint64), shingles


def majority(hashes: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """A fingerprint per text: the bits that are set in over half of its hashes."""
    out = np.zeros(len(shingles), np.uint64)
    full = np.flatnonzero(shingles)
    if not len(full):
        return out
    bound = np.append((np.cumsum(shingles) - shingles)[full], len(hashes))
    step = 1 << 16
    counts = np.zeros((len(full), 64), np.int64)
    for k in range(0, len(hashes), step):  # bits as bytes, a bounded piece at a time
        part = hashes[k : k + step]
        bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        lo, hi = np.searchsorted(bound, k, side="right") - 1, np.searchsorted(bound, k + len(part), side="left")
        cuts = np.maximum(bound[lo:hi], k) - k
        counts[lo:hi] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int64)
    set_bits = 2 * counts > shingles[full][:, None]
    out[full] = np.packbits(set_bits, axis=1).view(">u8").ravel().astype(np.uint64)
    return out


def remixed(hashes: np.ndarray) -> np.ndarray:
    """64 further bits of each hash."""
    with np.errstate(over="ignore"):
        x = hashes + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def fingerprints_of(column: pa.Array, width: int = SHINGLE) -> np.ndarray:
    """The fingerprints of a batch of texts, as unsigned integers."""
    return majority(*shingle_hashes(column, width))


def fingerprints(docs: DataFrame, width: int = SHINGLE, wide: bool = False) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long), more (64 further bits, or 0), tie (a hash of the text)."""

    def run(batches):
        for batch in batches:
            for first, last in slices(batch.column(1), TEXT_BYTES):
                hashes, shingles = shingle_hashes(batch.column(1).slice(first, last - first), width)
                got = majority(hashes, shingles)
                more = majority(remixed(hashes), shingles) if wide else np.zeros(len(got), np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(got.view(np.int64)), pa.array(more.view(np.int64)), batch.column(2).slice(first, last - first)], names=["doc_id", "fp", "more", "tie"])

    return id_text(docs).withColumn("tie", F.xxhash64("text")).mapInArrow(tidy(run), "doc_id long, fp long, more long, tie long")


# ------------------------------------------------------------------------------------------- the plan


def bit_counts(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of nodes, and for every two bits the nodes that have both set: 64 x 64 numbers."""

    def run(batches):
        both, n = np.zeros((64, 64)), 0
        for batch in batches:
            fp = batch.column(0).to_numpy().astype(np.int64)
            for k in range(0, len(fp), 1 << 15):
                bits = np.unpackbits(fp[k : k + (1 << 15)].astype(">i8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.float64)
                both += bits.T @ bits
            n += len(fp)
        i, j = np.indices((64, 64))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(i.ravel(), -1).astype(np.int32)), pa.array(np.append(j.ravel(), -1).astype(np.int32)), pa.array(np.append(both.ravel(), n).astype(np.int64))], names=["i", "j", "n"])

    out, total = np.zeros((64, 64)), 0
    for r in nodes.select("fp").mapInArrow(tidy(run), "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        if r.i < 0:
            total = r.n
        else:
            out[r.i, r.j] = r.n
    return total, out


def group_bits(total: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m partitions of equal size; each is filled, bit by bit, with the bit most correlated with those it has."""
    p = np.diag(both) / max(total, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(total, 1) - np.outer(p, p)) / np.outer(sd, sd))
    left, out = set(range(64)), []
    for k in range(m):
        size = 64 // m + (k < 64 % m)
        part = [max(left, key=lambda b: (sd[b], -b))]
        left.remove(part[0])
        while len(part) < size:
            best = max(left, key=lambda b: (corr[b, part].sum(), -b))
            part.append(best)
            left.remove(best)
        out.append(sorted(part))
    return out


def estimate(total: int, p: np.ndarray, part: list[int], tau: int) -> list[float]:
    """Cost of a partition for thresholds -1 .. tau: candidate pairs of independent bits, and the probes."""
    chance = np.zeros(tau + 1)
    chance[0] = 1.0
    for b in part:
        differ = 2 * p[b] * (1 - p[b])
        chance[1:] = chance[1:] * (1 - differ) + chance[:-1] * differ
        chance[0] *= 1 - differ
    probes = np.cumsum([math.comb(len(part), t) for t in range(tau + 1)])
    return [0.0, *(total * total / 2 * np.cumsum(chance) + PROBE_COST * total * (probes + 1)).tolist()]


def plan(total: int, both: np.ndarray, tau: int = TAU) -> list[tuple[list[int], int]]:
    """The partitions that are probed, with their thresholds, at the least estimated cost."""
    p = np.diag(both) / max(total, 1)
    best = (math.inf, [])
    for m in range(1, tau + 2):
        parts = group_bits(total, both, m)
        costs = [estimate(total, p, part, tau) for part in parts]
        # table over (sum of thresholds so far + number of partitions): least cost and the choice
        need = tau + 1
        table_ = {0: (0.0, ())}
        for cost in costs:
            more: dict[int, tuple[float, tuple]] = {}
            for done, (c, chosen) in table_.items():
                for t in range(-1, min(tau, need - done - 1) + 1):
                    k = done + t + 1
                    if k not in more or c + cost[t + 1] < more[k][0]:
                        more[k] = (c + cost[t + 1], (*chosen, t))
            table_ = more
        if need in table_ and table_[need][0] < best[0]:
            best = (table_[need][0], [(part, t) for part, t in zip(parts, table_[need][1], strict=True) if t >= 0])
    return best[1]


def planned(total: int, both: np.ndarray, tau: int) -> list[tuple[list[int], int]]:
    """The plan for PLAN_NODES nodes at least: below that any plan is cheap, and the choice would jump between sizes."""
    times = max(1.0, PLAN_NODES / max(total, 1))
    return plan(int(total * times), both * times, tau)


# ------------------------------------------------------------------------------------------- probe and verify


def _masks(bits: list[int], radius: int) -> np.ndarray:
    """All patterns of up to ``radius`` of the given bits (bit 0 is the highest)."""
    out = [0]
    ones = [1 << (63 - b) for b in bits]

    def grow(value: int, at: int, left: int) -> None:
        for k in range(at, len(ones)):
            out.append(value | ones[k])
            if left > 1:
                grow(value | ones[k], k + 1, left - 1)

    if radius:
        grow(0, 0, radius)
    return np.array(out, np.uint64)


class Trees:
    """Union by least root over the distinct values of an array."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        r = self.root[x]
        while True:
            up = self.root[r]
            if (up == r).all():
                return r
            r = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.find(a), self.find(b)
            open_ = ra != rb
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            if not len(a):
                return
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))
            self.root = self.root[self.root]


def grown(values: np.ndarray, more: np.ndarray, tau: int, tau_all: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of trees over distinct nodes: each node meets only those that are in no tree yet."""
    child, parent = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    left, v, w = np.arange(len(values)), values, more
    while len(left) > 1:
        open_, left, v, w = [int(left[0])], left[1:], v[1:], w[1:]
        while open_ and len(left):
            r = open_.pop()
            apart = np.bitwise_count(v ^ values[r])
            near = apart <= tau
            if near.any():
                near &= apart.astype(np.int64) + np.bitwise_count(w ^ more[r]) <= tau_all
                found = left[near]
                child.append(found)
                parent.append(np.full(len(found), r))
                open_ += found.tolist()
                left, v, w = left[~near], v[~near], w[~near]
    return np.concatenate(child), np.concatenate(parent)


def _pieces(size: np.ndarray):
    """(first, last + 1) of pieces of at most ``PIECE`` in all; what is larger by itself is a piece of its own."""
    bound, at = np.cumsum(size), 0
    while at < len(size):
        done = int(bound[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(bound, done + PIECE, side="right")))
        yield at, to
        at = to


def _meet(keys: np.ndarray, fps: np.ndarray, more: np.ndarray, home: np.ndarray, tau: int, tau_all: int) -> tuple[np.ndarray, np.ndarray]:
    """Tree edges among rows of equal key (a filed node and any other) within tau bits; pairs live a piece at a time."""
    values, first, node = np.unique(fps, return_index=True, return_inverse=True)
    wide = more[first]
    trees = Trees(len(values))
    order = np.lexsort((~home, keys))
    keys, node, home = keys[order], node[order], home[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    size = np.diff(np.append(first, len(keys)))
    homes = np.add.reduceat(home.astype(np.int64), first) if len(first) else first
    dense = size * homes > DENSE
    for k in np.flatnonzero(dense).tolist():
        some = np.unique(node[first[k] : first[k] + size[k]])
        a, b = grown(values[some], wide[some], tau, tau_all)
        trees.join(some[a], some[b])
    # each filed row meets all rows of its group that come after it
    many = np.where((size > 1) & ~dense, homes, 0)
    rows = ragged(first, many)
    until = np.repeat(first + size, many)
    count = until - rows - 1
    for at, to in _pieces(count):
        left = np.repeat(rows[at:to], count[at:to])
        right = ragged(rows[at:to] + 1, count[at:to])
        a, b = node[left], node[right]
        apart = np.bitwise_count(values[a] ^ values[b])
        near = np.flatnonzero(apart <= tau)
        a, b = a[near], b[near]
        if tau_all > tau:
            near = apart[near].astype(np.int64) + np.bitwise_count(wide[a] ^ wide[b]) <= tau_all
            a, b = a[near], b[near]
        trees.join(a, b)
    all_ = np.arange(len(values))
    root = trees.find(all_)
    out = root != all_
    return values[out], values[root[out]]


def _filed(nodes: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """part, value, fp, more, home: each node under its own value of each partition, and under those it probes."""
    tables = [(np.uint64(sum(1 << (63 - b) for b in bits)), _masks(bits, t)) for bits, t in parts]

    def run(batches):
        for batch in batches:
            fp, more = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            for k, (mask, flips) in enumerate(tables):
                step = max(1, (1 << 18) // len(flips))
                for s in range(0, len(fp), step):
                    own = fp[s : s + step]
                    value = ((own & mask)[:, None] ^ flips[None, :]).ravel()
                    home = np.zeros((len(own), len(flips)), bool)
                    home[:, 0] = True
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), k, np.int32)), pa.array(value.view(np.int64)), pa.array(np.repeat(own, len(flips)).view(np.int64)), pa.array(np.repeat(more[s : s + step], len(flips))), pa.array(home.ravel())], names=["part", "value", "fp", "more", "home"])

    return nodes.select("fp", "more").mapInArrow(tidy(run), "part int, value long, fp long, more long, home boolean")


def _deal(hot: DataFrame, parts: list[tuple[list[int], int]], level: int, tau: int) -> DataFrame:
    """Rows of values that too many meet under, dealt by each of tau + 1 blocks of the bits not yet used.

    Two rows that meet and are within tau bits agree on one of those blocks.
    """
    blocks = {}
    for k in range(len(parts) * (tau + 1) ** level):
        used, code = set(), k
        path = []
        for _ in range(level):
            path.append(code % (tau + 1))
            code //= tau + 1
        used |= set(parts[code][0])
        for step in reversed(path):
            rest = [b for b in range(64) if b not in used]
            used |= set(rest[step :: tau + 1])
        rest = [b for b in range(64) if b not in used]
        blocks[k] = [sum(1 << (63 - b) for b in rest[s :: tau + 1]) for s in range(tau + 1)]
    masks = np.array([blocks[k] for k in range(len(blocks))], np.uint64)

    def run(batches):
        for batch in batches:
            part, value, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy().view(np.uint64)
            for s in range(tau + 1):
                # the value holds bits already used alone, so value and block together are the new value
                yield pa.RecordBatch.from_arrays([pa.array((part * (tau + 1) + s).astype(np.int32)), pa.array((value ^ (fp & masks[part, s])).view(np.int64)), batch.column(2), batch.column(3), batch.column(4)], names=["part", "value", "fp", "more", "home"])

    return hot.select("part", "value", "fp", "more", "home").mapInArrow(tidy(run), "part int, value long, fp long, more long, home boolean")


def links(nodes: DataFrame, total: int, parts: list[tuple[list[int], int]], tau: int = TAU, tau_all: int | None = None) -> DataFrame:
    """a, b: edges of trees that connect whatever is connected within tau bits."""
    spark = nodes.sparkSession

    def meet(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        t = pa.Table.from_batches(batches)
        part, value = t.column(0).to_numpy().astype(np.uint64), t.column(1).to_numpy().view(np.uint64)
        with np.errstate(over="ignore"):
            keys = value ^ ((part + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        a, b = _meet(keys, t.column(2).to_numpy().view(np.uint64), t.column(3).to_numpy().view(np.uint64), t.column(4).to_numpy(zero_copy_only=False), tau, tau if tau_all is None else tau_all)
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    rows = _filed(nodes, parts)
    n_rows = total * sum(len(_masks(bits, t)) for bits, t in parts)
    out = None
    for level in range(DEALS + 1):
        n_tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // TASK_ROWS))
        hot = None
        if level < DEALS:
            counts = (rows if level else _filed(nodes, [(bits, 0) for bits, _ in parts])).where("home").groupBy("part", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROUP).select("part", "value")
            counts = materialise(counts, "hot")
            n_hot = counts.count()
            if n_hot:
                marked = counts.withColumn("hot", F.lit(True))
                if n_hot <= 10_000:  # two numbers each: a checked bound
                    marked = F.broadcast(marked)
                rows = materialise(rows.join(marked, ["part", "value"], "left"), "dealt")
                hot = rows.where("hot")
                rows = rows.where("hot is null").drop("hot")
        met = rows.repartition(n_tasks, "part", "value").select("part", "value", "fp", "more", "home").mapInArrow(tidy(meet), "a long, b long")
        out = met if out is None else out.unionByName(met)
        if hot is None:
            break
        rows = materialise(_deal(hot, parts, level, tau), "dealt")
        n_rows = rows.count()
    return out


def components(edges: DataFrame) -> DataFrame:
    """fp, root: the least node of the component of each node that has an edge."""
    edges = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        # large star: every greater neighbour of a node is linked to the least of its neighbourhood
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialise(both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n"), "least")
        total = least.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if not total:
            return edges.select(F.col("a").alias("fp"), F.col("b").alias("root"))
        # the centre of a large component has very many neighbours: they are dealt over tasks
        large = materialise(spread_join(both, least, "a", "n", total, "inner").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large")
        # small star: a node and its lesser neighbours are linked to the least of them
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        before, edges = edges, materialise(large.join(small, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "edges")
        drop(before, least, large)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            return edges.select(F.col("a").alias("fp"), F.col("b").alias("root"))
        state = now


def _named(prints: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """doc_id, fp, component_id, root of every row, from the root of each node that has a link."""
    named = nodes.select("fp", "least", "n").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = materialise(named, "named")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("nodes"))
    sizes = named.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    of_node = materialise(spread_join(named.select("fp", "root", "n"), ids, "root", "nodes", sizes[0]).select("fp", "component_id", "root", "n"), "components")
    return spread_join(prints.select("doc_id", "fp"), of_node, "fp", "n", sizes[1]).select("doc_id", "fp", "component_id", "root")


def _nodes(prints: DataFrame) -> DataFrame:
    """fp, least doc_id, rows, the further bits and the text's hash of one of them."""
    return materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"), F.min(F.struct("tie", "more")).alias("one")).select("fp", "least", "n", "one.more", "one.tie"), "nodes")


def near_duplicates(docs: DataFrame, tau: int = TAU, width: int = SHINGLE) -> DataFrame:
    """doc_id, fp (signed long), component_id, root (the least fingerprint of the component)."""
    prints = materialise(fingerprints(docs, width), "fingerprints")
    nodes = _nodes(prints)
    total, both = bit_counts(nodes)
    if total < 2:
        return prints.join(nodes.select("fp", F.col("least").alias("component_id")), "fp").select("doc_id", "fp", "component_id", F.col("fp").alias("root"))
    return _named(prints, nodes, components(links(nodes, total, planned(total, both, tau), tau)))


# ------------------------------------------------------------------------------------------- similarity of sets


def similar_trees(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges of trees that connect sets whose Jaccard similarity reaches ``similarity``; exact."""
    size = np.array([len(x) for x in sets], np.int64)
    first = np.cumsum(size) - size
    # each hash by its rank; the inverse of np.unique would hold five arrays of all of them
    ranked = np.concatenate([np.zeros(0, np.uint64), *sets])
    ranked.sort()
    ranked = ranked[np.append(True, ranked[1:] != ranked[:-1])[: len(ranked)]]
    code = np.empty(int(size.sum()), np.uint32)
    for at, x in zip(first.tolist(), sets, strict=True):
        code[at : at + len(x)] = np.searchsorted(ranked, x)
    mark = np.zeros(len(ranked), bool)
    del ranked
    child, parent = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    left = np.argsort(size, kind="stable")
    while len(left) > 1:
        open_, left = [int(left[0])], left[1:]
        while open_ and len(left):
            r = open_.pop()
            # sets of too different sizes cannot be similar; ``left`` is in order of size
            lo, hi = np.searchsorted(size[left], [np.ceil(similarity * size[r] - 1e-9), np.floor(size[r] / similarity + 1e-9) + 1], side="left")
            some = left[lo:hi][size[left[lo:hi]] > 0]
            if not len(some):
                continue
            mine = code[first[r] : first[r] + size[r]]
            mark[mine] = True
            common = np.zeros(len(some), np.int64)
            for at, to in _pieces(size[some]):
                part = some[at:to]
                common[at:to] = np.add.reduceat(mark[code[ragged(first[part], size[part])]], np.cumsum(size[part]) - size[part], dtype=np.int64)
            mark[mine] = False
            near = some[common >= similarity * (size[r] + size[some] - common) - 1e-9]
            if len(near):
                child.append(near)
                parent.append(np.full(len(near), r))
                open_ += near.tolist()
                left = left[~np.isin(left, near)]
    return np.concatenate(child), np.concatenate(parent)


def similar(docs: DataFrame, similarity: float = SIMILAR, width: int = WORDS, reach: int = REACH_64, reach_all: int = REACH_128, block_texts: int = BLOCK_TEXTS) -> DataFrame:
    """doc_id, fp, component_id, root: rows are linked if their sets of shingles reach ``similarity``."""
    spark = docs.sparkSession
    prints = materialise(fingerprints(docs, width, wide=True), "fingerprints")
    nodes = _nodes(prints)
    total, both = bit_counts(nodes)
    none = spark.createDataFrame([], "fp long, root long")
    if total < 2:
        return _named(prints, nodes, none)
    coarse = components(links(nodes, total, planned(total, both, reach), reach, reach_all))
    # candidates: the nodes of components of more than one, each by one of its texts
    coarse = coarse.unionByName(coarse.select(F.col("root").alias("fp"), "root")).distinct()
    members = materialise(coarse.join(nodes.select("fp", "tie"), "fp"), "members")
    n_members = members.count()
    if not n_members:
        return _named(prints, nodes, none)
    ties = members.select("tie").distinct()
    if n_members <= FEW_IDS:  # a number each: a checked bound
        ties = F.broadcast(ties)
    texts = id_text(docs).withColumn("tie", F.xxhash64("text")).select("tie", "text").join(ties, "tie", "left_semi")

    def sets(batches):
        seen: set[int] = set()
        for batch in batches:
            for first, last in slices(batch.column(1), TEXT_BYTES):
                names = batch.column(0).slice(first, last - first).to_pylist()
                keep = [k for k, t in enumerate(names) if t not in seen and not seen.add(t)]  # of copies in the task one is enough
                if keep:
                    hashes, count = shingle_hashes(batch.column(1).slice(first, last - first).take(pa.array(keep)), width)
                    parts = [np.unique(x) for x in np.split(hashes, np.cumsum(count)[:-1])]
                    yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in keep], pa.int64()), pa.array([len(x) for x in parts], pa.int64()), pa.array([x.tobytes() for x in parts], pa.binary())], names=["tie", "size", "shingles"])

    found = texts.mapInArrow(tidy(sets), "tie long, size long, shingles binary").groupBy("tie").agg(F.first("size").alias("size"), F.first("shingles").alias("shingles"))
    rows = materialise(members.join(found, "tie").select("root", "fp", "size", "shingles"), "sets")
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / block_texts), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("long")
    cuts = rows.groupBy("root").agg(parts.alias("parts"))
    # a block is two parts of a component: every two members meet in one
    blocked = rows.join(cuts, "root").withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")))
    blocked = blocked.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    by = ["root", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j")]
    n_tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_members // 20_000))

    def check(batches):
        held, key = ([], []), None

        def done():
            a, b = similar_trees([np.frombuffer(x, np.uint64) for x in held[1]], similarity)
            fps = np.array(held[0], np.int64)
            return pa.RecordBatch.from_arrays([pa.array(fps[a]), pa.array(fps[b])], names=["a", "b"])

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True))
            # sets are taken one by one, so that no second copy of the batch is held
            for one, fp, raw in zip(keys, batch.column(3).to_pylist(), (x.as_py() for x in batch.column(4)), strict=True):
                if one != key:
                    if len(held[0]) > 1:
                        yield done()
                    held, key = ([], []), one
                held[0].append(fp)
                held[1].append(raw)
        if len(held[0]) > 1:
            yield done()

    blocked = blocked.select(*by, "fp", "shingles").repartition(n_tasks, "root", "i", "j").sortWithinPartitions("root", "i", "j", "fp")
    edges = blocked.mapInArrow(tidy(check), "a long, b long")
    return _named(prints, nodes, components(edges))


def keep_one(docs: DataFrame, found: DataFrame, width: int) -> DataFrame:
    """The documents with one row of each component of ``found`` (``near_duplicates`` or ``similar`` of the same
    ``width``) kept: that of its smallest doc_id (rows without an id come last; of rows alike in id and fingerprint any
    one)."""
    found = materialise(found, "found")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")).alias("k")
    kept = found.groupBy("root").agg(first).select(F.col("k.doc_id").alias("_loom_id"), F.col("k.fp").alias("_loom_fp"))
    id_ = F.col("doc_id").cast("long")
    if found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").isEmpty():
        return docs.join(kept.select("_loom_id"), id_ == F.col("_loom_id"), "left_semi")
    # ids do not tell the rows apart, so their fingerprints must
    text_at, names = docs.columns.index("text"), docs.columns

    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column(text_at), TEXT_BYTES):
                part = batch.slice(a, b - a)
                got = fingerprints_of(part.column(text_at), width)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got.view(np.int64))], names=[*names, "_loom_own"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    rows = docs.mapInArrow(tidy(run), f"{fields}, _loom_own long")
    same = rows["doc_id"].cast("long").eqNullSafe(kept["_loom_id"]) & (rows["_loom_own"] == kept["_loom_fp"])
    return rows.join(kept, same, "left_semi").dropDuplicates(["doc_id", "_loom_own"]).select(*names)


def op10(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

