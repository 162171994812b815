"""Packing of token sequences: shortest pack first over the histogram of lengths.

Documents are tokenised, an end id is appended, and ids beyond the window are cut off as full pieces; what is left
of each document is one shorter piece. Only the histogram of piece lengths (a row per length) comes to the driver,
where lengths are placed longest first, each into the open pack that is shortest so far and still has room; packs
of the same contents are one pattern with a count. Patterns are joined back to the pieces by the rank of a piece
among those of its length. Ranks are a local count within the partition plus an offset summed over partitions, so
a length shared by a third of all pieces is never brought together.

A pack is never padded beyond the window, and one whose length is a power of two not at all.

Defined results: null text is an empty document (the end id alone); repeated rows are packed one by one, each with
its own pieces; an empty table gives no rows; a null doc_id is kept; other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_text, materialise, table, tidy
from .wordbpe import default_vocabulary, encoder

WINDOW = 4096


def shortest_pack_first(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """(number of packs, ((length, how often in the pack), ...)) with every length of the histogram placed."""
    open_packs: dict[int, list] = defaultdict(list)  # by length so far
    heap: list[int] = []
    done = []

    def put(fill: int, n: int, parts: tuple) -> None:
        if fill == window:
            done.append((n, parts))
            return
        if not open_packs[fill]:
            heapq.heappush(heap, fill)
        open_packs[fill].append([n, parts])

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            while heap and not open_packs[heap[0]]:
                heapq.heappop(heap)
            if not heap or heap[0] + length > window:
                # no pack has room: new ones; a length that fits several times shares packs as far as it goes
                each = min(left, window // length)
                n = left // each
                put(each * length, n, ((length, each),))
                left -= n * each
                continue
            fill = heap[0]
            n, parts = open_packs[fill].pop()
            each = max(1, min((window - fill) // length, left // n))
            used = min(n, left // each)
            if used < n:
                put(fill, n - used, parts)
            put(fill + each * length, used, (*parts, (length, each)))
            left -= used * each
    return done + [(n, parts) for packs in open_packs.values() for n, parts in packs]


def layout(histogram: dict[int, int], window: int = WINDOW) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, how often in a pack, first sequence, offset) in order of the first rank."""
    seen: dict[int, int] = defaultdict(int)
    rows: dict[int, list] = defaultdict(list)
    sequence = 0
    for n, parts in shortest_pack_first(histogram, window):
        at = 0
        for length, each in parts:
            rows[length].append((seen[length], each, sequence, at))
            seen[length] += n * each
            at += length * each
        sequence += n
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def pieces(docs: DataFrame, vocabulary: str, end_id: int, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """A row per piece, with its local rank among the pieces of its length in this partition."""

    def run(batches):
        enc = encoder(vocabulary)
        part, seen = TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            for first, ids, counts in enc.encode_slices(batch.column(1)):
                n = len(counts)
                at = np.cumsum(counts)
                flat = np.insert(ids.astype("<u4"), at, end_id)
                total = counts + 1
                begin = np.cumsum(total) - total
                cuts = -(-total // window)
                row = np.repeat(np.arange(n), cuts)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * window
                length = np.minimum(window, total[row] - start)
                raw = flat.tobytes()
                bounds = [(a * 4, b * 4) for a, b in zip((begin[row] + start).tolist(), (begin[row] + start + length).tolist(), strict=True)]
                rank = []
                for k in length.tolist():
                    rank.append(seen[k])
                    seen[k] += 1
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, n).take(pa.array(row)),
                        pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()),
                        pa.array([zlib.crc32(raw[a:b]) for a, b in bounds], pa.int64()),
                        pa.array(total[row], pa.int64()),
                        pa.array([part] * len(row), pa.int32()),
                        pa.array(rank, pa.int64()),
                        pa.array([raw[a:b] if with_ids else None for a, b in bounds], pa.binary()),
                    ],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "rank", "ids"],
                )

    return id_text(docs).mapInArrow(tidy(run), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, rank long, ids binary")


def pack(docs: DataFrame, vocabulary: str, end_id: int, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, the ids of each piece."""
    cut = materialise(pieces(docs, vocabulary, end_id, window, with_ids), "pieces")
    per_part = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r.length: r.n for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row per length
    places = layout(histogram, window)
    by_part = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = per_part.select("length", "part", F.coalesce(F.sum("n").over(by_part), F.lit(0)).alias("first"))
    ranked = cut.join(first, ["length", "part"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("rank") + F.col("first")).alias("rank"), "ids")

    def run(batches):
        for batch in batches:
            length, rank = batch.column(2).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for k in np.unique(length).tolist():
                at, rows = np.flatnonzero(length == k), places[k]
                row = rows[np.searchsorted(rows[:, 0], rank[at], side="right") - 1]
                left = rank[at] - row[:, 0]
                sequence[at] = row[:, 2] + left // row[:, 1]
                offset[at] = row[:, 3] + left % row[:, 1] * k
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset), batch.column(6)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    out = ranked.mapInArrow(tidy(run), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")
    return out if with_ids else out.drop("ids")


def op9(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_vocabulary(), 2)
