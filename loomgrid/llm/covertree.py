"""Exact top-k inner products by dual-tree search over cover trees.

Vectors are turned into integers, so scores and ties are exact. Candidates are dealt to the nearest of a bounded set of
pivots and, where one pivot has more than ``CHUNK`` of them, to parts of its group by hash; each part becomes one cover
tree, built once and kept as a row of a table in the shared folder. Equal vectors of a part are one point that keeps its
smallest ids. Queries go the same way into trees of at most ``PACK``. Packs travel in rounds of bounded bytes. A round
first meets the chunks of its own pivots, which gives every query a lower bound of its kth score, then all other
chunks. Both trees are descended together, and a pair of nodes is left out when the largest inner product their centres
and covering radii allow is below the worst kth score among the queries of the query node. Only k rows per query and
task leave a task.

A node's children have at most half its radius, always: points hardly any two of which are near each other give a node
many children of one point each, whose bounds are then their scores. ``work`` of ``top_k`` counts what was done.

Defined results: vectors that are null, empty or hold a null or non-finite component, and rows without an id, take no
part; vectors of another length than the query's are no candidates of it; repeated rows are candidates each, a
repeated query row is one query; a query never finds rows of its own id; fewer candidates than k give fewer rows; an
empty table gives no rows; other columns are ignored. Scores must fit 63 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, goes_at_exit, materialise, scratch_path, table, tidy
from .wordtable import ragged

#: Queries of a tree, points of a tree, points of a leaf, queries of a leaf, pivots at most, and bytes of query trees that travel at once.
SCALE, PACK, CHUNK, LEAF, ASKED_LEAF, PIVOTS, ROUND_BYTES = 1024, 1024, 2048, 16, 4, 4096, 64 << 20
NONE = np.iinfo(np.int64).min


class CoverTree:
    """Nodes with a centre, a covering radius and children of at most half of it.

    Points are put into an order in which every node holds the slice ``lo`` to ``hi`` of them; a node's children are
    the ``kids`` nodes from ``first`` on. Leaves hold ``leaf`` points or fewer, or equal ones.
    """

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        n = len(points)
        self.points, x = points, points.astype(np.float64)
        square = np.einsum("ij,ij->i", x, x)
        top = float(square.max(initial=0.0))
        far = x @ x.T
        np.multiply(far, -2.0, out=far)
        far += square[:, None]
        far += square[None, :]
        np.sqrt(np.maximum(far, 0.0, out=far), out=far)
        pad = 0.0 if top < 2**51 else 1e-6 * top**0.5  # sums of squares are exact below
        order = np.arange(n)
        centre, radius, lo, hi, first, kids = [0], [0.0], [0], [n], [0], [0]
        at = 0
        while at < len(centre) and n:
            a, b = lo[at], hi[at]
            rows = order[a:b]
            near = far[centre[at], rows]
            radius[at] = float(near.max()) * (1 + 1e-12) + pad
            if b - a > leaf and near.max() > 0:
                half, groups = near.max() / 2, []
                left = np.arange(b - a)
                pick = int(np.argmin(near))
                while True:
                    mine = far[rows[pick], rows[left]] <= half
                    mine |= left == pick
                    groups.append((int(rows[pick]), left[mine]))
                    left = left[~mine]
                    if not len(left):
                        break
                    pick = int(left[np.argmax(near[left])])
                order[a:b] = rows[np.concatenate([g for _, g in groups])]
                first[at], kids[at] = len(centre), len(groups)
                for c, g in groups:
                    centre.append(c)
                    radius.append(0.0)
                    lo.append(a)
                    a += len(g)
                    hi.append(a)
                    first.append(0)
                    kids.append(0)
            at += 1
        self.order = order
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        self.points = points[order]
        self.centre = place[np.array(centre, np.int64)] if n else np.zeros(0, np.int64)
        self.radius, self.lo, self.hi = np.array(radius), np.array(lo, np.int64), np.array(hi, np.int64)
        self.first, self.kids = np.array(first, np.int64), np.array(kids, np.int64)

    def ready(self) -> CoverTree:
        """Centres as doubles and their lengths, which a search needs."""
        self.at = self.points[self.centre].astype(np.float64)
        self.length = np.sqrt(np.einsum("ij,ij->i", self.at, self.at)) * (1 + 1e-12)
        self.most = float(np.abs(self.points).max(initial=0))
        return self

    def leaves(self) -> int:
        return int((self.kids == 0).sum()) if len(self.points) else 0

    PARTS = ("points", "centre", "radius", "lo", "hi", "first", "kids")

    def packed(self, extra: dict[str, np.ndarray]) -> bytes:
        parts = {k: getattr(self, k) for k in self.PARTS} | extra
        sink = pa.BufferOutputStream()
        batch = pa.RecordBatch.from_arrays([pa.array([v.ravel()]) for v in parts.values()], names=list(parts))
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_batch(batch)
        return sink.getvalue().to_pybytes()

    @classmethod
    def unpacked(cls, raw: bytes, dim: int) -> tuple[CoverTree, dict[str, np.ndarray]]:
        batch = pa.ipc.open_stream(pa.py_buffer(raw)).read_next_batch()
        parts = {name: batch.column(k).values.to_numpy() for k, name in enumerate(batch.schema.names)}
        tree = cls.__new__(cls)
        for k in cls.PARTS:
            setattr(tree, k, parts.pop(k))
        tree.points = tree.points.reshape(-1, dim)
        return tree.ready(), parts


class Best:
    """The k best (score, id) of each query, ties to the smaller id; ``floor``: what a kth score is known to reach."""

    def __init__(self, ids: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.own, self.k = ids, k
        self.score = np.full((len(ids), k), NONE, np.int64)
        self.id = np.full((len(ids), k), np.iinfo(np.int64).max, np.int64)
        self.worst = np.full(len(ids), NONE, np.int64) if floor is None else floor.copy()

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores: a row for each of ``rows``, a column for each of ``ids``; rows of a query's own id don't count."""
        fit = (scores >= self.worst[rows][:, None]) & (ids[None, :] != self.own[rows][:, None])
        if scores.shape[1] > 4 * self.k:  # of very many only those that reach the kth of them
            kth = np.partition(np.where(fit, scores, NONE), -self.k, axis=1)[:, -self.k]
            fit &= scores >= kth[:, None]
        r, c = np.nonzero(fit)
        if not len(r):
            return
        some = np.unique(r)
        old = np.repeat(some, self.k)
        row = np.concatenate([old, r])
        score = np.concatenate([self.score[rows[some]].ravel(), scores[r, c]])
        name = np.concatenate([self.id[rows[some]].ravel(), ids[c]])
        order = np.lexsort((name, ~score, row))  # ascending order of ~score is descending order of score
        row = row[order]
        begin = np.searchsorted(row, some)
        take = order[(begin[:, None] + np.arange(self.k)[None, :]).ravel()]
        self.score[rows[some]] = score[take].reshape(-1, self.k)
        self.id[rows[some]] = name[take].reshape(-1, self.k)
        self.worst[rows[some]] = np.maximum(self.worst[rows[some]], self.score[rows[some], -1])


def of_equals(ids: np.ndarray, k: int) -> np.ndarray:
    """Of the ascending ids of equal vectors those that can be among the k best of any query: k besides its own.

    No id counts more than k times, and a query's own id takes up as many of the first places as it occurs.
    """
    if len(ids) <= k:
        return ids
    own, many = np.unique(ids, return_counts=True)
    many = np.minimum(many, k)
    return np.repeat(own, many)[: k + int(many.max())]


def search(queries: CoverTree, tree: CoverTree, ids: np.ndarray, many: np.ndarray, best: Best) -> tuple[int, int]:
    """Descends both trees together; returns how many pairs of leaves were scored, and how many points met.

    ids: of all points, one point's after the other's; many: how many each point has.
    """
    if not len(tree.points) or not len(queries.points):
        return 0, 0
    most = queries.most * tree.most * tree.points.shape[1]
    exact = most < 2**53
    slack = 1 + most * 1e-9
    ends = np.cumsum(many)
    scored = met = 0
    stack = [(0, 0)]

    def score(rows: np.ndarray, cols: np.ndarray) -> None:
        nonlocal met
        a, b = queries.points[rows], tree.points[cols]
        dots = (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64) if exact else a @ b.T
        n = many[cols]
        if (n > 1).any():
            dots = np.repeat(dots, n, axis=1)
        best.offer(rows, dots, ids[ragged((ends - many)[cols], n)])
        met += len(rows) * len(cols)

    while stack:
        q, c = stack.pop()
        qs = np.arange(queries.first[q], queries.first[q] + queries.kids[q]) if queries.kids[q] else np.array([q])
        cs = np.arange(tree.first[c], tree.first[c] + tree.kids[c]) if tree.kids[c] else np.array([c])
        rq, rc = queries.radius[qs][:, None], tree.radius[cs][None, :]
        bound = queries.at[qs] @ tree.at[cs].T + queries.length[qs][:, None] * rc + tree.length[cs][None, :] * rq + rq * rc + slack
        worst = np.minimum.reduceat(best.worst[queries.lo[q] : queries.hi[q]], queries.lo[qs] - queries.lo[q])
        open_ = bound >= worst[:, None]
        leaf = (queries.kids[qs] == 0)[:, None] & (tree.kids[cs] == 0)[None, :]
        ends_here = open_ & leaf
        if ends_here.any():
            scored += int(ends_here.sum())
            some_q, some_c = np.flatnonzero(ends_here.any(1)), np.flatnonzero(ends_here.any(0))
            if 2 * ends_here.sum() >= len(some_q) * len(some_c):  # most of the block is needed: at once
                groups = [(some_q, some_c)]
            else:
                groups = [(np.array([i]), np.flatnonzero(ends_here[i])) for i in some_q]
            for i, j in groups:
                rows, cols = (ragged(t.lo[x], t.hi[x] - t.lo[x]) for t, x in ((queries, qs[i]), (tree, cs[j])))
                score(rows, cols)
        i, j = np.nonzero(open_ & ~leaf)
        if len(i):
            by = np.argsort(bound[i, j], kind="stable")  # the most promising pair is searched first: on the stack last
            stack += list(zip(qs[i[by]].tolist(), cs[j[by]].tolist(), strict=True))
    return scored, met


# ------------------------------------------------------------------------------------------- Spark


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, v (array of long): floor(scale * component), components as doubles; only valid vectors."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0))
    sound = F.forall("x", lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))), F.lit(False)))
    return rows.where(sound).select("vec_id", F.transform("x", lambda e: F.floor(e * F.lit(float(scale)))).alias("v"))


def _pivots(rows: DataFrame, most: int) -> dict[int, np.ndarray]:
    """Vectors of the ``most`` rows of the least hashes, by length: a bounded choice that no layout changes."""
    picked = rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(most).select("v").distinct().collect()
    out: dict[int, list] = {}
    for r in sorted(picked):
        out.setdefault(len(r.v), []).append(r.v)
    return {d: np.array(vs, np.int64) for d, vs in out.items()}


def _dealt(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """vec_id, dim, pivot (the nearest of its length; -1 without one), v as bytes."""

    def run(batches):
        for batch in batches:
            column = batch.column(1)
            if not batch.num_rows:
                continue
            offsets = column.offsets.to_numpy()
            flat, length = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], np.diff(offsets)
            begin, ids = np.cumsum(length) - length, batch.column(0).to_numpy()
            for d in np.unique(length).tolist():
                at = np.flatnonzero(length == d)
                v = flat[begin[at][:, None] + np.arange(d)[None, :]]
                near = np.full(len(at), -1, np.int32)
                if d in pivots:
                    p = pivots[d].astype(np.float64)
                    half = np.einsum("ij,ij->i", p, p) / 2
                    step = max(1, (1 << 22) // len(p))
                    for k in range(0, len(at), step):
                        near[k : k + step] = np.argmax(v[k : k + step].astype(np.float64) @ p.T - half, axis=1)
                raw = np.ascontiguousarray(v, "<i8").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[at]), pa.array(np.full(len(at), d, np.int32)), pa.array(near), pa.array([raw[8 * d * k : 8 * d * (k + 1)] for k in range(len(at))], pa.binary())],
                    names=["vec_id", "dim", "pivot", "v"],
                )

    return rows.mapInArrow(tidy(run), "vec_id long, dim int, pivot int, v binary")


def _trees(dealt: DataFrame, sizes: list, most: int, name: str, k: int | None) -> DataFrame:
    """dim, pivot, part, n, tree: a packed tree per part of a pivot's group; ``sizes`` has the rows of each group.

    Parts are dealt by the hash of the id, and of equal ids by the vector, so the part of a row never changes. With
    ``k`` equal vectors are one point that keeps the ids which can be among the k best; without, every row is a point.
    """
    spark = dealt.sparkSession
    parts = F.broadcast(spark.createDataFrame([(r.dim, r.pivot, -(-r.n // most)) for r in sizes], "dim int, pivot int, parts int"))  # PIVOTS rows and a few
    rows = dealt.join(parts, ["dim", "pivot"]).withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), F.col("parts")).cast("int"))
    n_tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(r.n for r in sizes) // (1 << 18)))

    def build(dim, pivot, part, ids, v):
        ids, v = np.array(ids, np.int64), np.frombuffer(b"".join(v), "<i8").reshape(-1, dim)
        for at in range(0, len(ids), 2 * most):  # hashing deals unevenly, and equal rows all alike
            own, rows_ = ids[at : at + 2 * most], v[at : at + 2 * most]
            if k is None:
                tree = CoverTree(rows_, ASKED_LEAF)
                extra = {"ids": own[tree.order]}
            else:
                points, of = np.unique(rows_, axis=0, return_inverse=True)
                by = np.lexsort((own, of.ravel()))
                names = [of_equals(x, k) for x in np.split(own[by], np.cumsum(np.bincount(of.ravel(), minlength=len(points)))[:-1])]
                tree = CoverTree(points)
                extra = {"ids": np.concatenate([names[j] for j in tree.order]), "many": np.array([len(names[j]) for j in tree.order], np.int64)}
            yield pa.RecordBatch.from_arrays(
                [pa.array([dim], pa.int32()), pa.array([pivot], pa.int32()), pa.array([part], pa.int32()), pa.array([len(own)], pa.int64()), pa.array([tree.packed(extra)], pa.binary())],
                names=["dim", "pivot", "part", "n", "tree"],
            )

    def run(batches):
        held, key = ([], []), None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True))
            ids, v = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            for one, i, x in zip(keys, ids, v, strict=True):
                if one != key or len(held[0]) >= 2 * most:
                    if held[0]:
                        yield from build(*key, *held)
                    held, key = ([], []), one
                held[0].append(i)
                held[1].append(x)
        if held[0]:
            yield from build(*key, *held)

    by = ["dim", "pivot", "part"]
    ordered = rows.select(*by, "vec_id", "v").repartition(n_tasks, *by).sortWithinPartitions(*by, "vec_id", "v")
    return materialise(ordered.mapInArrow(tidy(run), "dim int, pivot int, part int, n long, tree binary"), name)


def _rounds(packs: DataFrame, most: int):
    """Lists of query trees whose bytes together stay within ``most`` (one tree at least)."""
    held, size = [], 0
    for r in packs.toLocalIterator():
        if held and size + len(r.tree) > most:
            yield held
            held, size = [], 0
        held.append((r.dim, r.pivot, bytes(r.tree)))
        size += len(r.tree)
    if held:
        yield held


def top_k(vectors: DataFrame, is_query, k: int = 10, scale: int = SCALE, pack: int = PACK, chunk: int = CHUNK, round_bytes: int = ROUND_BYTES, work: dict | None = None) -> DataFrame:
    """query_id, rank, vec_id, score for the rows that ``is_query`` (a condition on vec_id) marks.

    ``work``, if given, gets the leaf pairs and pairs of points that were scored, and those there are.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score long"
    rows = integers(vectors, scale)
    n = rows.count()
    dealt = materialise(_dealt(rows, _pivots(rows, max(1, min(PIVOTS, -(-n // chunk))))), "dealt")
    count = lambda df: df.groupBy("dim", "pivot").agg(F.count(F.lit(1)).alias("n")).collect()
    asked = dealt.where(is_query).dropDuplicates(["vec_id", "dim", "v"])
    packs = _trees(asked, count(asked), pack, "packs", None)
    chunks = _trees(dealt, count(dealt), chunk, "chunks", k)
    path = scratch_path(spark, "topk")
    found_schema = "query_id long, vec_id long, score long, leaf_pairs long, pairs long"
    n_tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // (1 << 17)))
    spread = chunks.select("dim", "pivot", "tree").repartition(n_tasks, F.xxhash64("dim", "pivot", "part"))

    def meet(shared, own: bool):
        """The search of a round: of the chunks of a pack's own pivot, or of all others."""

        def run(batches):
            packs_, floors = shared.value
            held, scored, met = None, 0, 0
            for batch in batches:
                for dim, pivot, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                    if held is None:
                        held = []
                        for j, (d, p, t) in enumerate(packs_):
                            q, extra = CoverTree.unpacked(t, d)
                            held.append((d, p, q, Best(extra["ids"], k, floors[j] if floors else None)))
                    tree = None
                    for d, p, q, best in held:
                        if d == dim and (p == pivot) == own:
                            if tree is None:
                                tree, extra = CoverTree.unpacked(raw.as_py(), dim)
                            a, b = search(q, tree, extra["ids"], extra["many"], best)
                            scored, met = scored + a, met + b
            out = [(b.own[r], b.id[r, c], b.score[r, c]) for _, _, _, b in held or [] for r, c in [np.nonzero(b.score != NONE)]]
            if out:
                ids, names, scores = (np.concatenate(x) for x in zip(*out, strict=True))
                ids, names, scores = np.append(ids, 0), np.append(names, 0), np.append(scores, 0)
                last = np.arange(len(ids)) == len(ids) - 1  # what the task did goes into a row of its own
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), pa.array(names), pa.array(scores), pa.array(np.where(last, scored, 0), mask=~last), pa.array(np.where(last, met, 0), mask=~last)],
                    names=["query_id", "vec_id", "score", "leaf_pairs", "pairs"],
                )

        return spread.select("dim", "pivot", "tree").mapInArrow(tidy(run), found_schema)

    for held in _rounds(packs.select("dim", "pivot", "tree"), round_bytes):
        shared = spark.sparkContext.broadcast((held, None))
        near = materialise(meet(shared, True), "near")
        near.write.mode("append").parquet(path)
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        kth = near.where("leaf_pairs is null").withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k)
        floor = {r.query_id: r.score for r in kth.select("query_id", "score").collect()}  # a number per query of the round
        floors = [np.array([floor.get(i, NONE) for i in CoverTree.unpacked(t, d)[1]["ids"].tolist()], np.int64) for d, _, t in held]
        again = spark.sparkContext.broadcast((held, floors))
        meet(again, False).write.mode("append").parquet(path)
        shared.destroy()
        again.destroy()
        drop(near)
    if packs.isEmpty():
        return spark.createDataFrame([], schema)
    goes_at_exit(spark, path)
    found = spark.read.schema(found_schema).parquet(path)
    if work is not None:
        did = found.agg(F.coalesce(F.sum("leaf_pairs"), F.lit(0)), F.coalesce(F.sum("pairs"), F.lit(0))).first()
        work |= {"leaf_pairs": did[0], "pairs": did[1], "all_pairs": n * asked.count()}
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.where("leaf_pairs is null").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op7(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP7_SQL = """
WITH v AS (
  SELECT CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM (SELECT * FROM v WHERE vec_id % 100 = 0) q JOIN v c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
