"""Vectorised interning of words: distinct words of a batch of texts, found without a Python step per word."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa

#: Words up to so many bytes are compared as 8-byte lanes; longer ones as bytes objects.
LANE_BYTES = 96
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [0xFFFFFFFFFFFFFFFF], dtype=np.uint64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first, last = (int(offsets[0]), int(offsets[-1])) if len(column) else (0, 0)
    return flat[first:last], (offsets - first) if len(column) else np.zeros(1, np.int64)


def spans(is_gap: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of non-gap bytes; a run never crosses a row's bounds."""
    n = len(is_gap)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    word = ~is_gap
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends


def intern(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A code for each span such that equal codes mean equal bytes; the span that stands for each code.

    Lanes of eight bytes are mixed into 64 bits; every span is then compared lane by lane with the one
    that stands for its code, so a collision of the mix is found and settled, never taken for equality.
    """
    m = len(starts)
    if not m:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    padded = np.concatenate([flat, np.zeros(16, np.uint8)])
    lanes = np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
    length = ends - starts

    def lane(rows: np.ndarray | slice, k: int) -> np.ndarray:
        left = length[rows] - 8 * k
        return lanes[starts[rows] + 8 * k] & _MASKS[np.minimum(left, 8)]

    with np.errstate(over="ignore"):
        mix = lane(slice(None), 0) + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        rows, k = np.flatnonzero(length > 8), 1
        while len(rows) and k < LANE_BYTES // 8:
            x = mix[rows]
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(32)
            mix[rows] = (x + lane(rows, k)) * np.uint64(0x94D049BB133111EB) ^ (x >> np.uint64(17))
            k += 1
            rows = rows[length[rows] > 8 * k]
    codes, _ = pd.factorize(mix)
    found = int(codes.max()) + 1
    rep = np.empty(found, np.int64)
    rep[codes[::-1]] = np.arange(m - 1, -1, -1)
    mine = rep[codes]
    bad = (length != length[mine]) | (lane(slice(None), 0) != lane(mine, 0))
    rows, k = np.flatnonzero(length > 8), 1
    while len(rows) and k < LANE_BYTES // 8:
        bad[rows] |= lane(rows, k) != lane(mine[rows], k)
        k += 1
        rows = rows[length[rows] > 8 * k]
    odd = np.flatnonzero(bad | (length > LANE_BYTES))
    if len(odd):
        codes = codes.astype(np.int64)
        seen: dict[bytes, int] = {}
        more = []
        raw = flat.tobytes()
        for i in odd.tolist():
            word = raw[starts[i] : ends[i]]
            code = seen.get(word)
            if code is None:
                code = seen[word] = found + len(more)
                more.append(i)
            codes[i] = code
        used, codes = np.unique(codes, return_inverse=True)  # some codes stand for odd spans alone, and now for none
        rep = np.concatenate([rep, np.array(more, np.int64)])[used]
    return codes, rep


def words_of(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, rep: np.ndarray) -> list[bytes]:
    raw = flat.tobytes()
    return [raw[s:e] for s, e in zip(starts[rep].tolist(), ends[rep].tolist(), strict=True)]


def ragged(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Indices first[i] .. first[i] + count[i] - 1 for each i, in order."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    at = np.cumsum(count) - count
    return np.arange(total, dtype=np.int64) + np.repeat(first - at, count)


def slices(column: pa.Array, most_bytes: int = 4 << 20):
    """(first row, last row + 1) of pieces of about ``most_bytes`` of text; a longer row is a piece of its own."""
    _, offsets = text_bytes(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most_bytes, side="right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last
