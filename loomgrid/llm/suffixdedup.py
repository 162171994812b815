"""Removal of repeated passages through run-length compressed Burrows-Wheeler indexes.

A byte goes if it lies in a ``WIDTH``-byte string that also starts in a document with a smaller doc_id; strings are
compared whole and judged on the input. Work is dealt by content: the least hash among the ``GRAM``-byte substrings
of a window (its key) is the same wherever the window stands, so equal windows meet under equal keys. Neighbouring
windows of one key form a segment of at most ``2 * WIDTH - GRAM`` bytes.

1. Documents are packed into blocks (a table in the shared folder). Every block names its distinct keys, once each,
   and learns by a bitmap which of them occur in several documents; other windows cannot repeat.
2. Blocks send the segments of those keys, each distinct one once with its least doc_id. A task builds run-length
   indexes over bounded sets of distinct segments: suffix array, Burrows-Wheeler runs with the suffix array sampled at
   both ends of each run, and the least doc_id of each range of suffixes that share WIDTH bytes. The suffix array is
   dropped, and all segments are streamed through the index from right to left: where the run's letter is the next
   one, the match grows by a step of LF, else it moves to the nearer end of the next run of that letter. A match of
   WIDTH bytes or more whose range has a smaller doc_id marks a window. A segment that has a key to itself shares no
   window with another one, so it stays out; copies of it are settled by its least doc_id.
3. Blocks get back, per distinct segment, its least doc_id and the marked windows, and cut the bytes they cover.

Keys that very many documents share are dealt further, window by window, so no key gathers an unbounded group.

Defined results: null text is empty; texts shorter than WIDTH bytes are kept; rows with equal doc_id do not mark each
other; a null doc_id counts as larger than any other (null rows do not mark each other); an empty table gives no rows;
other columns are passed through, but for those of the names it adds. Bytes of a cut letter that remain are dropped from the text column only, digests
are over the remaining bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, table, tidy
from .wordtable import intern, ragged, text_bytes

WIDTH, GRAM = 50, 24
#: Text bytes of a block; bytes under one index; documents that share a key before it is dealt by windows.
BLOCK_BYTES, INDEX_BYTES, HOT_DOCS = 4 << 20, 1_800_000, 20_000
NO_ID = np.iinfo(np.int64).max
#: Windows that are hashed at once, so that what is in hand stays in a core's cache.
PIECE = 1 << 15
SPAN = WIDTH - GRAM + 1


# ------------------------------------------------------------------------------------------- the index


class RunLengthIndex:
    """Runs of the Burrows-Wheeler transform of separate strings, sampled at run ends, with ranges of WIDTH bytes."""

    def __init__(self, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner_least: np.ndarray, width: int = WIDTH):
        """The strings lie one after the other in ``flat``; owner_least: the least doc_id of each string."""
        self.width = width
        n_strings = len(starts)
        size = ends - starts
        # letters 1 .. 256; each string ends with the separator 0, so that no suffix runs into the next string
        at = np.cumsum(size + 1) - (size + 1)
        text = np.zeros(int((size + 1).sum()), np.int16)
        text[ragged(at, size)] = flat[ragged(starts, size)].astype(np.int16) + 1
        self.text = text
        self.first, self.size = at, size
        string = np.repeat(np.arange(n_strings), size + 1)
        left = np.repeat(at + size, size + 1) - np.arange(len(text))  # letters before the separator
        order = self._suffixes(text, left)
        before = np.where(order == at[string[order]], 0, text[order - 1])  # order - 1 is -1 only where the mask holds
        change = np.flatnonzero(np.append(True, before[1:] != before[:-1]))
        self.n = len(text)
        self.run_start = change
        self.run_letter = before[change].astype(np.int64)
        run_end = np.append(change[1:], self.n) - 1
        self.run_end = run_end
        self.sample_start, self.sample_end = order[change], order[run_end]
        # a bit per row where a run starts, and the runs before each word of 64 rows
        begins = np.zeros(-(-self.n // 64) * 64, np.uint8)
        begins[change] = 1
        self.begin_bits = np.packbits(begins, bitorder="little").view("<u8")
        ones = np.bitwise_count(self.begin_bits).astype(np.int64)
        self.begin_rank = np.cumsum(ones) - ones
        length = run_end - change + 1
        # rows of the first column by letter, and letters of the kind in the runs before
        counts = np.bincount(self.run_letter, weights=length, minlength=258).astype(np.int64)
        self.total = counts
        self.less = np.cumsum(counts) - counts
        by = np.argsort(self.run_letter, kind="stable")
        run_before = np.empty(len(change), np.int64)
        cum = np.cumsum(length[by]) - length[by]
        run_before[by] = cum - self.less[self.run_letter[by]]
        self.run_before = run_before
        self.by_letter = self.run_letter[by] * (len(change) + 1) + by
        self.by_run = by
        # ranges: neighbouring rows whose suffixes share ``width`` letters; rows of shorter suffixes are in none
        long = np.flatnonzero(left[order] >= width)
        rows = order[long]
        same = np.zeros(len(rows), bool)
        if len(rows) > 1:
            packed = np.concatenate([(text - 1).astype(np.uint8), np.zeros(width + 16, np.uint8)])
            lanes = np.ndarray((len(packed) - 7,), dtype="<u8", buffer=packed, strides=(1,))
            near = long[1:] == long[:-1] + 1
            same[1:] = near
            for k in [*range(0, width - 8, 8), width - 8]:
                open_ = np.flatnonzero(same)
                if not len(open_):
                    break
                same[open_] = lanes[rows[open_] + k] == lanes[rows[open_ - 1] + k]
        cuts = np.flatnonzero(~same)
        self.range_first = long[cuts]
        self.range_least = np.minimum.reduceat(owner_least[string[rows]], cuts) if len(rows) else np.zeros(0, np.int64)

    @staticmethod
    def _suffixes(text: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Suffix array by doubling from the first few letters; only rows that still tie are sorted again.

        What is compared and the place of the suffix are sorted as one integer while they fit 63 bits (sets beyond
        two million letters sort by keys instead). Suffixes that are the same to their end so stay in the order of
        their places, which LF relies on.
        """
        n = len(text)
        letter = 8 if int(text.max(initial=0)) < 256 else 9
        bits = max(1, int(n + 1).bit_length())
        depth = max(1, (63 - bits) // letter)
        packed = 3 * bits <= 63
        key, wide = np.zeros(n, np.int64), np.concatenate([text, np.zeros(16, np.int16)])
        for k in range(depth):
            key = (key << letter) | np.where(left > k, wide[k : k + n], 0)
        key = (key << bits) | np.arange(n)
        key.sort()
        order = key & ((1 << bits) - 1)
        key >>= bits
        new = np.append(True, key[1:] != key[:-1])
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rows = np.flatnonzero(~(new & np.append(new[1:], True)))
        most = int(left.max(initial=0))
        while len(rows) and depth <= most:
            p = order[rows]
            # what follows the letters compared so far; nothing, if the string ended before
            more = np.where(left[p] > depth, rank[np.minimum(p + depth, n - 1)] + 1, 0)
            both = (rank[p] << bits) | more
            if packed:
                both = (both << bits) | p
                both.sort()
                p = both & ((1 << bits) - 1)
                both >>= bits
            else:
                at = np.lexsort((p, both))
                p, both = p[at], both[at]
            order[rows] = p
            fresh = np.append(True, both[1:] != both[:-1])
            rank[p] = np.maximum.accumulate(np.where(fresh, rows, 0))
            rows = rows[~(fresh & np.append(fresh[1:], True))]
            depth *= 2
        return order

    def _run_of(self, row: np.ndarray) -> np.ndarray:
        """The run that each row lies in: the number of runs begun up to it, less one."""
        word = row >> 6
        upto = np.uint64(0xFFFFFFFFFFFFFFFF) >> (63 - (row & 63)).astype(np.uint64)
        return self.begin_rank[word] + np.bitwise_count(self.begin_bits[word] & upto) - 1

    def _shared(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Letters that the suffixes at a and b share, at most ``most``."""
        out = np.zeros(len(a), np.int64)
        open_ = np.flatnonzero(most > 0)
        while len(open_):
            x, y = self.text[a[open_] + out[open_]], self.text[b[open_] + out[open_]]
            open_ = open_[(x == y) & (x > 0)]
            out[open_] += 1
            open_ = open_[out[open_] < most[open_]]
        return out

    def stream(self, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """Yields, from the last letter of the patterns to the first, (patterns, offsets, match lengths, rows).

        All patterns go in step; the match length is that of the longest match starting at the offset.
        """
        size = ends - starts
        m = len(starts)
        row, place, match = np.zeros(m, np.int64), np.full(m, self.sample_start[0]), np.zeros(m, np.int64)
        by_size = np.argsort(-size, kind="stable")
        sizes = size[by_size]
        n_runs = len(self.run_start)
        for step in range(1, int(size.max(initial=0)) + 1):
            live = by_size[: np.searchsorted(-sizes, -step, side="right")]
            letter = flat[ends[live] - step].astype(np.int64) + 1
            run = self._run_of(row[live])
            there = self.total[letter] > 0
            jump = (self.run_letter[run] != letter) & there
            if jump.any():
                j = np.flatnonzero(jump)
                at = np.searchsorted(self.by_letter, letter[j] * (n_runs + 1) + run[j])
                up = np.maximum(at - 1, 0)
                down = np.minimum(at, n_runs - 1)
                up_run, down_run = self.by_run[up], self.by_run[down]
                up_ok = (at > 0) & (self.run_letter[up_run] == letter[j])
                down_ok = (at < n_runs) & (self.run_letter[down_run] == letter[j])
                p, have = place[live[j]], match[live[j]]
                up_len = np.where(up_ok, self._shared(p, self.sample_end[up_run], np.where(up_ok, have, 0)), -1)
                down_len = np.where(down_ok, self._shared(p, self.sample_start[down_run], np.where(down_ok, have, 0)), -1)
                take_up = up_len >= down_len
                run[j] = np.where(take_up, up_run, down_run)
                row[live[j]] = np.where(take_up, self.run_end[up_run], self.run_start[down_run])
                place[live[j]] = np.where(take_up, self.sample_end[up_run], self.sample_start[down_run])
                match[live[j]] = np.maximum(np.where(take_up, up_len, down_len), 0)
            ok = live[there]
            r = run[there]
            row[ok] = self.less[letter[there]] + self.run_before[r] + row[ok] - self.run_start[r]
            place[ok] -= 1
            match[ok] += 1
            lost = live[~there]
            row[lost], match[lost], place[lost] = 0, 0, self.sample_start[0]
            yield live, size[live] - step, match[live], row[live]

    def marks(self, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: np.ndarray):
        """(pattern, offset) of the windows that also occur in a string of a smaller doc_id than the pattern's."""
        patterns, offsets = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for who, offset, match, row in self.stream(flat, starts, ends):
            long = match >= self.width
            if long.any():
                w, o = who[long], offset[long]
                found = self.range_least[np.searchsorted(self.range_first, row[long], side="right") - 1]
                hit = found < least[w]
                patterns.append(w[hit])
                offsets.append(o[hit])
        return np.concatenate(patterns), np.concatenate(offsets)


# ------------------------------------------------------------------------------------------- keys and segments


def _least_hashes(lanes: np.ndarray, out: np.ndarray) -> None:
    """The least hash among the GRAM-byte substrings of each window; lanes: the eight bytes from each place on."""
    reach = len(out) + SPAN - 1
    with np.errstate(over="ignore"):
        x = lanes[:reach] * np.uint64(0x9E3779B97F4A7C15)
        y = x >> np.uint64(29)
        x ^= y
        x += lanes[8 : 8 + reach]
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= np.right_shift(x, np.uint64(32), out=y)
        x += lanes[16 : 16 + reach]
        x *= np.uint64(0x94D049BB133111EB)
        x ^= np.right_shift(x, np.uint64(31), out=y)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= np.right_shift(x, np.uint64(30), out=y)
    wide = 1
    while 2 * wide <= SPAN:
        x, y = np.minimum(x[:-wide], x[wide:], out=y[: len(x) - wide]), x
        wide *= 2
    np.minimum(x[: len(out)], x[SPAN - wide : SPAN - wide + len(out)], out=out)


def window_keys(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments of windows of one key: first window, number of windows (SPAN at most), key, row of the text."""
    none = np.zeros(0, np.int64)
    size = np.diff(offsets)
    n = len(flat)
    if n < WIDTH:
        return none, none, none.astype(np.uint64), none
    padded = np.concatenate([flat, np.zeros(WIDTH + 16, np.uint8)])
    lanes = np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
    x = np.empty(n - WIDTH + 1, np.uint64)
    for lo in range(0, len(x), PIECE):
        _least_hashes(lanes[lo : lo + PIECE + WIDTH - 8], x[lo : lo + PIECE])
    # x[i] is the key of the window at i; windows must end within their text
    windows = np.maximum(size - WIDTH + 1, 0)
    sound = np.zeros(len(x) + 1, np.int8)
    np.add.at(sound, offsets[:-1][windows > 0], 1)
    np.add.at(sound, (offsets[:-1] + windows)[windows > 0], -1)
    sound = np.cumsum(sound[:-1], dtype=np.int8) > 0
    new = np.empty(len(x), bool)
    new[0] = True
    np.not_equal(x[1:], x[:-1], out=new[1:])
    new[offsets[:-1][windows > 0]] = True
    new[1:] |= sound[1:] != sound[:-1]
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(x)))
    keep = sound[first]
    first, count = first[keep], count[keep]
    if (count > SPAN).any():  # texts of a short period: one key for very many windows
        parts = -(-count // SPAN)
        begin = ragged(np.zeros(len(first), np.int64), parts) * SPAN
        first, last = np.repeat(first, parts) + begin, np.repeat(first + count, parts)
        count = np.minimum(SPAN, last - first)
    row = np.searchsorted(offsets, first, side="right") - 1
    key = x[first]  # the least of many hashes is small: mixed again, so that its high bits deal evenly
    with np.errstate(over="ignore"):
        key ^= key >> np.uint64(33)
        key *= np.uint64(0xFF51AFD7ED558CCD)
        key ^= key >> np.uint64(29)
        key *= np.uint64(0xC4CEB9FE1A85EC53)
        key ^= key >> np.uint64(32)
    return first, count, key, row


def _squeeze(*arrays: np.ndarray) -> bytes:
    return pa.compress(b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() for a in arrays), codec="zstd", asbytes=True) if len(arrays[0]) else b""


def _spread(raw: bytes, n: int, *kinds: str) -> list[np.ndarray]:
    width = sum(np.dtype(k).itemsize for k in kinds)
    if not n:
        return [np.zeros(0, k) for k in kinds]
    flat = np.frombuffer(pa.decompress(raw, decompressed_size=n * width, codec="zstd", asbytes=True), np.uint8)
    out, at = [], 0
    for k in kinds:
        w = np.dtype(k).itemsize
        out.append(np.ascontiguousarray(flat[at : at + n * w].reshape(w, n).T).view(k).ravel())
        at += n * w
    return out


class Block:
    """A batch of documents, its segments and distinct keys."""

    def __init__(self, batch: pa.RecordBatch, id_at: int, text_at: int):
        ids = batch.column(id_at).cast(pa.int64())
        self.ids = ids.fill_null(NO_ID).to_numpy(zero_copy_only=False)
        self.flat, self.offsets = text_bytes(batch.column(text_at))
        self.first, self.count, key, self.row = window_keys(self.flat, self.offsets)
        order = np.argsort(key, kind="stable")
        ranked, rows = key[order], self.row[order]
        new = np.append(True, ranked[1:] != ranked[:-1])[: len(ranked)]
        self.keys = ranked[new]
        self.of = np.empty(len(key), np.int64)
        self.of[order] = np.cumsum(new) - 1
        other = np.append(True, rows[1:] != rows[:-1])[: len(rows)] | new
        self.docs = np.add.reduceat(other.astype(np.int64), np.flatnonzero(new)) if len(key) else np.zeros(0, np.int64)

    def segments(self, state: np.ndarray):
        """Distinct segments of shared keys, in order of their key.

        state: 0, 1 or 2 of each key: not shared, shared, shared by very many. Returns the segments of the block
        (start, number of windows, row, the distinct segment each is) and of the distinct ones the key, start, end
        and least doc_id.
        """
        mine = np.flatnonzero(state[self.of] > 0) if len(self.of) else np.zeros(0, np.int64)
        first, count, row, key = self.first[mine], self.count[mine], self.row[mine], self.keys[self.of[mine]]
        hot = state[self.of[mine]] == 2
        if hot.any():  # a segment per window, under a key of its own
            n = np.where(hot, count, 1)
            step = ragged(np.zeros(len(n), np.int64), n)
            first, row, key, single = np.repeat(first, n) + step, np.repeat(row, n), np.repeat(key, n), np.repeat(hot, n)
            count = np.where(single, 1, np.repeat(count, n))
            at = np.flatnonzero(single)
            key[at] = _window_hash(self.flat, first[at])
        codes, rep = intern(self.flat, first, first + count + WIDTH - 1)
        least = np.full(len(rep), NO_ID)
        np.minimum.at(least, codes, self.ids[row])
        order = np.lexsort((rep, key[rep])) if len(rep) else rep
        place = np.empty(len(rep), np.int64)
        place[order] = np.arange(len(rep))
        rep = rep[order]
        return (first, count, row, place[codes]), (key[rep], first[rep], first[rep] + count[rep] + WIDTH - 1, least[order])


def _window_hash(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    padded = np.concatenate([flat, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
    x = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in [*range(0, WIDTH - 8, 8), WIDTH - 8]:
            x = (x + lanes[at + k]) * np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(31)
    return x


def _contested(keys: np.ndarray) -> np.ndarray:
    """Distinct segments in order of their key, without those that have a key to themselves.

    Equal windows have equal keys, so no window of such a segment lies in another one, and none of it can be marked.
    """
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    return order[np.append(False, same) | np.append(same, False)] if len(order) else order


def find_marks(keys: np.ndarray, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each segment, given with its key: the least doc_id that has it, and a bit for each window that is marked."""
    codes, rep = intern(flat, starts, ends)
    of_code = np.full(len(rep), NO_ID)
    np.minimum.at(of_code, codes, least)
    mask = np.zeros(len(rep), np.uint32)
    order = _contested(keys[rep])
    weight = np.cumsum((ends - starts)[rep[order]])
    key_end = np.flatnonzero(np.append(keys[rep[order]][1:] != keys[rep[order]][:-1], True)) + 1
    lo = 0
    while lo < len(order):  # sets of whole keys, of INDEX_BYTES or one key
        base = int(weight[lo - 1]) if lo else 0
        hi = int(key_end[max(np.searchsorted(key_end, np.searchsorted(weight, base + INDEX_BYTES, side="right"), side="right") - 1, np.searchsorted(key_end, lo, side="right"))])
        some = order[lo:hi]
        s, e = starts[rep[some]], ends[rep[some]]
        who, offset = RunLengthIndex(flat, s, e, of_code[some]).marks(flat, s, e, of_code[some])
        np.bitwise_or.at(mask, some[who], np.uint32(1) << offset.astype(np.uint32))
        lo = hi
    return of_code[codes], mask[codes]


# ------------------------------------------------------------------------------------------- Spark


def _unpack(raw: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(pa.py_buffer(raw)).read_next_batch()


def blocks_of(docs: DataFrame, most: int = BLOCK_BYTES) -> DataFrame:
    """blk, size, data: batches of about ``most`` text bytes with all their columns, compressed."""
    text_at = docs.columns.index("text")

    def run(batches):
        part, k = TaskContext.get().partitionId(), 0
        held, weight = [], 0

        def out():
            nonlocal k
            batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_batch(batch)
            k += 1
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + k], pa.int64()), pa.array([weight], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["blk", "size", "data"])

        for batch in batches:
            _, offsets = text_bytes(batch.column(text_at))
            at = 0
            while at < batch.num_rows:
                to = int(np.searchsorted(offsets, offsets[at] + most - weight, side="right")) - 1
                to = min(batch.num_rows, max(to, at + (not held)))
                if to > at:
                    held.append(batch.slice(at, to - at))
                    weight += int(offsets[to] - offsets[at])
                if to < batch.num_rows:
                    yield out()
                    held, weight = [], 0
                at = to
        if held:
            yield out()

    return materialise(docs.mapInArrow(tidy(run), "blk long, size long, data binary"), "blocks")


def dedup(docs: DataFrame, hot_docs: int = HOT_DOCS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All columns of the documents, the text as it remains, then _n_bytes, _n_removed, _n_spans, _kept_sha256."""
    spark = docs.sparkSession
    docs = docs.drop("_n_bytes", "_n_removed", "_n_spans", "_kept_sha256")
    id_at, text_at = docs.columns.index("doc_id"), docs.columns.index("text")
    blocks = blocks_of(docs, block_bytes)
    total = blocks.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    least_tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    # -- 1: which keys occur in several documents
    n_tasks = max(least_tasks, -(-total // (32 << 20)))
    bits = min(24, max(6, int(4 * n_tasks - 1).bit_length()))  # a bucket is held whole by a task: they grow in number
    shift = np.uint64(64 - bits)

    def name_keys(batches):
        for batch in batches:
            for blk, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                b = Block(_unpack(raw.as_py()), id_at, text_at)
                if not len(b.keys):
                    continue
                cuts = np.flatnonzero(np.append(True, (b.keys[1:] >> shift) != (b.keys[:-1] >> shift)))[: len(b.keys)]
                ends = np.append(cuts[1:], len(b.keys))
                rows = [(int(b.keys[s] >> shift), blk, e - s, _squeeze(np.diff(b.keys[s:e], prepend=np.uint64(0)), np.minimum(b.docs[s:e], 0xFFFF).astype(np.uint16))) for s, e in zip(cuts.tolist(), ends.tolist(), strict=True)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["bucket", "blk", "n", "data"])

    def share(batches):
        # a table row per block and bucket; a key occurs once in each, however many documents of the block have it
        rows = [(r["bucket"], r["blk"], r["n"], r["data"]) for batch in batches for r in batch.to_pylist()]
        rows.sort(key=lambda r: r[0])
        at = 0
        while at < len(rows):
            to = at
            while to < len(rows) and rows[to][0] == rows[at][0]:
                to += 1
            group = rows[at:to]
            at = to
            keys, docs_ = zip(*(_spread(r[3], r[2], "<u8", "<u2") for r in group), strict=True)
            keys = [np.cumsum(k, dtype=np.uint64) for k in keys]
            size = [len(k) for k in keys]
            every, docs_ = np.concatenate(keys), np.concatenate(docs_).astype(np.int64)
            order = np.argsort(every, kind="stable")
            new = np.append(True, every[order][1:] != every[order][:-1])
            sums = np.add.reduceat(docs_[order], np.flatnonzero(new))
            state = np.where(sums > hot_docs, 2, np.where(sums > 1, 1, 0)).astype(np.uint8)
            back = np.empty(len(every), np.uint8)
            back[order] = state[np.cumsum(new) - 1]
            parts = np.split(back, np.cumsum(size)[:-1])
            yield pa.RecordBatch.from_arrays([
                pa.array([r[1] for r in group], pa.int64()), pa.array([r[0] for r in group], pa.int32()), pa.array(size, pa.int32()),
                pa.array([int((p > 0).sum()) for p in parts], pa.int64()), pa.array([_squeeze(p) for p in parts], pa.binary()),
            ], names=["blk", "bucket", "n", "shared", "data"])

    named = blocks.select("blk", "data").mapInArrow(tidy(name_keys), "bucket int, blk long, n int, data binary")
    states = materialise(named.repartition(n_tasks, "bucket").mapInArrow(tidy(share), "blk long, bucket int, n int, shared long, data binary"), "states")
    n_shared = states.agg(F.coalesce(F.sum("shared"), F.lit(0))).first()[0]
    per_block = states.groupBy("blk").agg(F.sort_array(F.collect_list(F.struct("bucket", "n", "data"))).alias("states"))

    def state_of(groups) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint8), *(_spread(g["data"], g["n"], "<u1")[0] for g in groups or [])])

    # -- 2: distinct segments of shared keys meet in indexes
    def send(batches):
        for batch in batches:
            for blk, raw, groups in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                b = Block(_unpack(raw.as_py()), id_at, text_at)
                _, (keys, starts, ends, least) = b.segments(state_of(groups))
                if not len(keys):
                    continue
                cuts = np.flatnonzero(np.append(True, (keys[1:] >> shift) != (keys[:-1] >> shift)))
                text = b.flat[ragged(starts, ends - starts)]
                at = np.append(0, np.cumsum(ends - starts))
                rows = []
                for s, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(keys)], strict=True):
                    head = _squeeze(np.diff(keys[s:e], prepend=np.uint64(0)), (ends - starts)[s:e].astype(np.uint8), least[s:e])
                    rows.append((int(keys[s] >> shift), blk, e - s, int(at[e] - at[s]), head, pa.compress(text[at[s] : at[e]].tobytes(), codec="zstd", asbytes=True)))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "blk", "n", "size", "head", "text"])

    def search(batches):
        rows = [r for batch in batches for r in batch.to_pylist()]
        rows.sort(key=lambda r: r["bucket"])
        at = 0
        while at < len(rows):
            to = at
            while to < len(rows) and rows[to]["bucket"] == rows[at]["bucket"]:
                to += 1
            yield _bucket(rows[at:to])
            at = to

    def _bucket(group) -> pa.RecordBatch:
        heads = [_spread(r["head"], r["n"], "<u8", "<u1", "<i8") for r in group]
        keys = np.concatenate([np.cumsum(h[0], dtype=np.uint64) for h in heads])
        size = np.concatenate([h[1] for h in heads]).astype(np.int64)
        least = np.concatenate([h[2] for h in heads])
        flat = np.frombuffer(b"".join(pa.decompress(r["text"], decompressed_size=r["size"], codec="zstd", asbytes=True) for r in group), np.uint8)
        ends = np.cumsum(size)
        firsts, masks = find_marks(keys, flat, ends - size, ends, least)
        n = [r["n"] for r in group]
        cuts = np.cumsum(n)[:-1]
        firsts, masks = np.split(firsts, cuts), np.split(masks, cuts)
        return pa.RecordBatch.from_arrays([
            pa.array([r["blk"] for r in group], pa.int64()), pa.array([r["bucket"] for r in group], pa.int32()), pa.array(n, pa.int32()),
            pa.array([_squeeze(a, b) for a, b in zip(firsts, masks, strict=True)], pa.binary()),
        ], names=["blk", "bucket", "n", "data"])

    with_states = blocks.join(per_block, "blk").select("blk", "data", "states")
    sent = with_states.mapInArrow(tidy(send), "bucket int, blk long, n int, size long, head binary, text binary")
    n_search = max(least_tasks, -(-n_shared * 64 // (12 << 20)))
    found = sent.repartition(n_search, "bucket").mapInArrow(tidy(search), "blk long, bucket int, n int, data binary")
    found = materialise(found, "found").groupBy("blk").agg(F.sort_array(F.collect_list(F.struct("bucket", "n", "data"))).alias("found"))

    # -- 3: blocks cut what is covered
    schema = [*docs.schema.fields]
    out_schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), "_n_bytes long, _n_removed long, _n_spans long, _kept_sha256 string"])

    def cut(batches):
        for batch in batches:
            for raw, groups, results in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                yield _cut(_unpack(raw.as_py()), groups, results)

    def _cut(rows: pa.RecordBatch, groups, results) -> pa.RecordBatch:
        b = Block(rows, id_at, text_at)
        gone = np.zeros(len(b.flat) + 1, np.int32)
        if results:
            (first, count, row, code), _ = b.segments(state_of(groups))
            parts = [_spread(r["data"], r["n"], "<i8", "<u4") for r in results]
            least, mask = (np.concatenate(x) for x in zip(*parts, strict=True))
            # a segment that a smaller doc_id has goes whole; else only its marked windows
            whole = least[code] < b.ids[row]
            np.add.at(gone, first[whole], 1)
            np.add.at(gone, (first + count + WIDTH - 1)[whole], -1)
            some = np.flatnonzero(~whole & (mask[code] > 0))
            for k in range(SPAN):
                at = first[some[(mask[code[some]] >> np.uint32(k)) & 1 > 0]] + k
                np.add.at(gone, at, 1)
                np.add.at(gone, at + WIDTH, -1)
        gone = np.cumsum(gone[:-1]) > 0
        n_bytes = np.diff(b.offsets)
        removed = np.diff(np.append(0, np.cumsum(gone))[b.offsets])
        begin = gone.copy()
        inner = np.ones(len(gone), bool)
        inner[b.offsets[:-1][b.offsets[:-1] < len(gone)]] = False  # a run of another document ends where this one starts
        begin[1:] &= ~(gone[:-1] & inner[1:])
        spans = np.diff(np.append(0, np.cumsum(begin))[b.offsets])
        raw = b.flat.tobytes()
        kept_bytes = b.flat[~gone].tobytes()
        left = np.append(0, np.cumsum(~gone))[b.offsets].tolist()
        bounds = b.offsets.tolist()
        texts, digests = [], []
        was = rows.column(text_at).is_null().to_pylist()
        for k in range(rows.num_rows):
            kept = raw[bounds[k] : bounds[k + 1]] if not removed[k] else kept_bytes[left[k] : left[k + 1]]
            digests.append(hashlib.sha256(kept).hexdigest())
            texts.append(None if was[k] else kept.decode(errors="ignore"))
        columns = [pa.array(texts, pa.string()) if k == text_at else rows.column(k) for k in range(rows.num_columns)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())], names=[*(f.name for f in schema), "_n_bytes", "_n_removed", "_n_spans", "_kept_sha256"])

    both = blocks.join(per_block, "blk", "left").join(found, "blk", "left")
    return both.select("data", "states", "found").mapInArrow(tidy(cut), out_schema)


def op2(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = dedup(docs)
    return out.select("doc_id", F.col("_n_bytes").alias("n_bytes"), F.col("_n_removed").alias("n_removed"), F.col("_n_spans").alias("n_spans"), F.col("_kept_sha256").alias("kept_sha256"))
