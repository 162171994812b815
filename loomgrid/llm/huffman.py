"""Token ids as files: canonical length-limited Huffman codes in independent blocks, decoded through a table.

Code lengths come from the counts of every id in the corpus (package-merge, at most ``MAX_BITS`` bits). A file holds
blocks; a block holds whole or continued documents of up to ``BLOCK_TOKENS`` ids, and the bit offset of every
``EVERY``-th id, so any block, and any checkpoint within it, decodes on its own. Decoding steps through all
checkpoints of a file at once, one table lookup per id.

Block layout, little-endian: b"HTK1", then seven u32 (documents, ids, payload bytes, checkpoints, EVERY, bits of the
table, 1 if the first document continues), i64 ids of documents (the smallest i64 stands for null), u32 ids of each
document in the block, u32 bit offsets, payload, one line feed. Files are written and read by Spark's own readers,
so they may lie in any store.

Defined results: null text is an empty document (the end id alone); a null doc_id sorts first; repeated rows each
have a place of their own (order among equal ids is settled by their text's hash); an empty table writes no block and
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, goes_at_exit, id_text, materialise, scratch_path, table, tidy
from .wordbpe import default_vocabulary, encoder


MAX_BITS, BLOCK_TOKENS, EVERY, FILE_IDS = 16, 65_536, 64, 12_000_000
MAGIC = b"HTK1"
NULL_ID = np.iinfo(np.int64).min


# ------------------------------------------------------------------------------------------- the code


def code_lengths(counts: np.ndarray, most: int = MAX_BITS) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``most`` bits (more only if that many symbols need them)."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n <= 1:
        lengths[used] = 1
        return lengths
    most = max(most, int(n - 1).bit_length())
    order = used[np.lexsort((used, counts[used]))]
    leaves = counts[order].astype(np.float64)
    row, kinds = leaves, [np.ones(n, bool)]
    for _ in range(most - 1):
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, pairs])
        at = np.argsort(both, kind="stable")
        row = both[at]
        kinds.append(at < n)
    take = 2 * n - 2
    for leaf in reversed(kinds):
        k = int(leaf[:take].sum())
        lengths[order[:k]] += 1
        take = 2 * (take - k)
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, symbol)."""
    codes = np.zeros(len(lengths), np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if len(order):
        top = int(lengths.max())
        step = np.uint64(1) << (top - lengths[order].astype(np.uint64))
        codes[order] = (np.cumsum(step) - step) >> (top - lengths[order].astype(np.uint64))
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For every value of the next bits: the symbol and its length."""
    top = max(1, int(lengths.max(initial=1)))
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    fill = 1 << (top - lengths[order].astype(np.int64))
    symbols, sizes = np.zeros(1 << top, np.uint32), np.ones(1 << top, np.int64)
    total = int(fill.sum())
    symbols[:total] = np.repeat(order, fill)
    sizes[:total] = np.repeat(lengths[order], fill)
    return symbols, sizes, top


def pack_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bits of all codes, most significant first, and the bit at which each id starts."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    at = ends - size
    words = np.zeros(int(ends[-1] + 63) // 32 + 1 if len(ids) else 1, np.uint64)
    wide = codes[ids].astype(np.uint64) << (64 - (at & 31) - size).astype(np.uint64)
    word = at >> 5
    # codes that share a word have disjoint bits, so sums are their union; both halves stay below 2 ** 53
    high = np.bincount(word, weights=(wide >> np.uint64(32)).astype(np.float64), minlength=len(words))
    low = np.bincount(word + 1, weights=(wide & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=len(words))
    return (high + low).astype(np.uint32).astype(">u4").tobytes()[: int(ends[-1] + 7) // 8 if len(ids) else 0], at


def encode_block(doc_ids: np.ndarray, sizes: np.ndarray, ids: np.ndarray, continues: bool, codes: np.ndarray, lengths: np.ndarray) -> bytes:
    payload, at = pack_bits(ids, codes, lengths)
    marks = at[::EVERY].astype("<u4")
    head = np.array([len(doc_ids), len(ids), len(payload), len(marks), EVERY, max(1, int(lengths.max(initial=1))), int(continues)], "<u4")
    return MAGIC + head.tobytes() + doc_ids.astype("<i8").tobytes() + sizes.astype("<u4").tobytes() + marks.tobytes() + payload


def decode_file(raw: bytes, lengths: np.ndarray, tables=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, ids per document and all ids of a file's blocks, in order."""
    symbols, sizes, top = tables or decode_table(lengths)
    flat = np.frombuffer(raw, np.uint8)
    docs, counts, base, lanes_n, at = [], [], [], [], 0
    while at < len(raw):
        if raw[at : at + 4] != MAGIC:
            raise ValueError(f"no block at byte {at}")
        n, m, size, marks, every, bits, continues = np.frombuffer(raw, "<u4", 7, at + 4).tolist()
        if every != EVERY or bits != top:
            raise ValueError("the block was written with another code")
        p = at + 32
        ids, per = np.frombuffer(raw, "<i8", n, p), np.frombuffer(raw, "<u4", n, p + 8 * n).astype(np.int64)
        if continues:
            counts[-1][-1] += per[0]
            ids, per = ids[1:], per[1:]
        if len(ids):
            docs.append(ids)
            counts.append(per.copy())
        p += 12 * n
        base.append((p + 4 * marks) * 8 + np.frombuffer(raw, "<u4", marks, p).astype(np.int64))
        lanes_n.append(np.minimum(EVERY, m - EVERY * np.arange(marks)))
        at = p + 4 * marks + size + 1
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
    bit, left = np.concatenate(base), np.concatenate(lanes_n)
    out = np.empty((len(bit), EVERY), np.uint32)
    padded = np.concatenate([flat, np.zeros(8, np.uint8)])
    words = np.ndarray((len(padded) - 7,), dtype=">u8", buffer=padded, strides=(1,))
    lanes, rows = bit, None
    for k in range(EVERY):
        if rows is None and (left <= k).any():
            rows = np.flatnonzero(left > k)
            lanes = bit[rows]
        elif rows is not None:
            keep = left[rows] > k
            rows, lanes = rows[keep], lanes[keep]
        look = (words[lanes >> 3] >> (64 - top - (lanes & 7)).astype(np.uint64)).astype(np.int64) & ((1 << top) - 1)
        out[rows if rows is not None else slice(None), k] = symbols[look]
        lanes += sizes[look]
    return np.concatenate(docs), np.concatenate(counts), out[np.arange(EVERY) < left[:, None]]


# ------------------------------------------------------------------------------------------- Spark


def tokens(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """doc_id, order (a hash that settles ties), ids (little-endian u16 or u32, the end id last)."""

    def run(batches):
        enc = encoder(vocabulary)
        for batch in batches:
            column = batch.column(1)
            for first, ids, counts in enc.encode_slices(column):
                size = enc.dtype.itemsize
                at = np.concatenate([[0], np.cumsum(counts)])
                raw, end = ids.tobytes(), np.array([end_id], enc.dtype).tobytes()
                rows = [raw[a * size : b * size] + end for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                n = len(rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), batch.column(2).slice(first, n), pa.array(rows, pa.binary()), pa.array([size] * n, pa.int32())], names=["doc_id", "tie", "ids", "width"])

    return id_text(docs).withColumn("tie", F.xxhash64("text")).mapInArrow(tidy(run), "doc_id long, tie long, ids binary, width int")


def global_counts(toks: DataFrame) -> np.ndarray:
    """How often each id occurs in the corpus; as long as the vocabulary at most, so it may come to the driver."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for width in (2, 4):
                rows = batch.filter(pa.compute.equal(batch.column(1), width))
                if rows.num_rows:
                    ids = np.frombuffer(b"".join(rows.column(0).to_pylist()), f"<u{width}")
                    got = np.bincount(ids)
                    if len(got) > len(total):
                        total = np.pad(total, (0, len(got) - len(total)))
                    total[: len(got)] += got
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])

    rows = toks.select("ids", "width").mapInArrow(tidy(run), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r.id for r in rows), default=0) + 1, np.int64)
    for r in rows:
        counts[r.id] = r.n
    return counts


def write(toks: DataFrame, path: str, lengths: np.ndarray, n_ids: int, file_ids: int = FILE_IDS, block_tokens: int = BLOCK_TOKENS) -> None:
    """Writes the files: documents in ascending doc_id order, part after part."""
    codes = canonical(lengths)

    def run(batches):
        ids_of, sizes_of, parts, held, continues = [], [], [], 0, False

        def block():
            return pa.RecordBatch.from_arrays([pa.array([encode_block(np.array(ids_of, np.int64), np.array(sizes_of, np.int64), np.concatenate(parts), continues, codes, lengths)], pa.binary())], names=["value"])

        for batch in batches:
            for doc_id, raw, width in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                ids, at = np.frombuffer(raw, f"<u{width}").astype(np.int64), 0
                while at < len(ids):
                    take = min(len(ids) - at, block_tokens - held)
                    ids_of.append(NULL_ID if doc_id is None else doc_id)
                    sizes_of.append(take)
                    parts.append(ids[at : at + take])
                    at, held = at + take, held + take
                    if held == block_tokens:
                        yield block()
                        ids_of, sizes_of, parts, held, continues = [], [], [], 0, at < len(ids)
        if held:
            yield block()

    n_files = max(1, -(-n_ids // file_ids))
    # the place in the table of tokens parts rows that are alike in all else, so that a range never grows beyond its share
    by = [F.col("doc_id").asc_nulls_first(), F.col("tie"), F.col("place")]
    ordered = toks.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(n_files, *by).sortWithinPartitions(*by)
    # the text writer puts the bytes of a string out as they are, and a line feed after each block
    ordered.select("doc_id", "ids", "width").mapInArrow(tidy(run), "value binary").select(F.col("value").cast("string")).write.option("lineSep", "\n").text(path)


def read(spark, path: str, lengths: np.ndarray, with_ids: bool = False) -> DataFrame:
    """file, place, doc_id, start (within the file), n_tokens, ids_crc32 and, if asked for, ids of every document."""

    def run(batches):
        tables = decode_table(lengths)
        for batch in batches:
            for name, raw in zip(batch.column(0), batch.column(1), strict=True):
                doc_ids, counts, ids = decode_file(raw.as_py(), lengths, tables)
                ends = np.cumsum(counts)
                wide = ids.astype("<u4").tobytes()
                spans = list(zip((ends - counts).tolist(), ends.tolist(), strict=True))
                n = len(spans)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name.as_py().rsplit("/", 1)[-1]] * n, pa.string()),
                        pa.array(np.arange(n), pa.int64()),
                        pa.array(doc_ids, pa.int64(), mask=doc_ids == NULL_ID),
                        pa.array(ends - counts, pa.int64()),
                        pa.array(counts, pa.int64()),
                        pa.array([zlib.crc32(wide[4 * a : 4 * b]) for a, b in spans], pa.int64()),
                        pa.array([wide[4 * a : 4 * b] if with_ids else None for a, b in spans], pa.binary()),
                    ],
                    names=["file", "place", "doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                )

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(tidy(run), "file string, place long, doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def part_number(name: str) -> int:
    """The number of a part file: names are padded to five digits only, so they don't sort by it."""
    return int(re.match(r"part-(\d+)", name)[1])


def round_trip(docs: DataFrame, vocabulary: str, end_id: int, path: str | None = None, with_ids: bool = False, **sizes_of) -> DataFrame:
    """Encodes, writes and reads back; ``start`` counts the ids of all documents before, over all
    files. ``sizes_of``: file_ids and block_tokens of ``write``."""
    spark = docs.sparkSession
    toks = materialise(tokens(docs, vocabulary, end_id), "tokens")
    counts = global_counts(toks)
    lengths = code_lengths(counts)
    own = path is None
    path = path or scratch_path(spark, "huffman")
    write(toks, path, lengths, int(counts.sum()), **sizes_of)
    drop(toks)
    if own:
        goes_at_exit(spark, path)
    rows = materialise(read(spark, path, lengths, with_ids), "decoded")
    # one row per file, in the order of the parts; a single running sum over the files
    sizes = rows.groupBy("file").agg(F.sum("n_tokens").alias("n")).collect()
    before, total = [], 0
    for r in sorted(sizes, key=lambda r: part_number(r.file)):
        before.append((r.file, total))
        total += r.n
    starts = spark.createDataFrame(before, "file string, _before long")
    out = rows.join(starts, "file").withColumn("start", F.col("start") + F.col("_before"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def op4(spark, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), default_vocabulary(), 1)


__all__ = ["canonical", "code_lengths", "decode_file", "decode_table", "encode_block", "op4", "read", "round_trip", "write"]
