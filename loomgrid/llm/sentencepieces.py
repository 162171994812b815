"""SentencePiece ids of a merge-type vocabulary by a score-ordered agenda, and back.

A segment's symbols start as its code points; the agenda holds adjacent pairs whose union is a piece, best score
first (leftmost of equals), and each merge adds the pairs it makes. A symbol that is no piece falls back to bytes.
Texts are cut where no piece of the vocabulary could join two neighbouring code points, so the segments' ids follow
each other unchanged; each distinct segment of a batch is encoded once, and every one met for the first time is
checked against the library, which also decodes the ids.

Defined results: null text is empty (the end id alone); repeated rows give repeated rows; an empty table gives no
rows; a null doc_id is kept; other columns are ignored; a vocabulary with another normalisation than "identity" is
refused.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text, table, tidy
from .wordbpe import default_vocabulary
from .wordtable import intern, ragged, slices, text_bytes, words_of

#: Bytes of distinct segments, their parts and ids kept per worker, and what an entry takes besides; the caches start
#: anew beyond it.
CACHE_BYTES, ENTRY = 192 << 20, 300
SPACE = "▁"


class Agenda:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, path: str, check: bool = True):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("a merge-type vocabulary with identity normalisation and a leading blank is needed")
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.check = check
        self.end = self.library.eos_id()
        self.unknown = self.library.unk_id()
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (1, 4)}
        self.scores = {p.piece: p.score for p in model.pieces if p.type in (1, 4)}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        self.joins = {a + b for p in self.ids for a, b in zip(p, p[1:], strict=False)}
        #: whether blanks only begin pieces and line feeds stand alone, so that texts may be cut there
        self.cuts = not any(x[1] == SPACE and x[0] != SPACE or "\n" in x for x in self.joins)
        #: whether a piece could join two neighbouring bytes; bytes beyond ASCII are told apart code point by code point
        self.byte_joins = np.ones((256, 256), bool)
        ascii_ = [SPACE if b == 32 else chr(b) for b in range(128)]
        self.byte_joins[:128, :128] = [[a + b in self.joins for b in ascii_] for a in ascii_]
        self.known: dict[bytes, tuple[bytes, str]] = {}
        self.parts: dict[str, list[int]] = {}
        self.held = 0

    def merge(self, text: str) -> list[int]:
        """Ids of one segment, blanks already written as the blank symbol."""
        symbols: list = list(text)
        n = len(symbols)
        if n == 1:
            return self._symbol(text)
        scores, heap = self.scores, []
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        for i in range(n - 1):
            pair = symbols[i] + symbols[i + 1]
            if pair in scores:
                heap.append((-scores[pair], i, pair))
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            left = symbols[i]
            if left is None:
                continue
            j = after[i]
            if j >= n or left + symbols[j] != pair:
                continue
            symbols[i], symbols[j] = pair, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                more = pair + symbols[k]
                if more in scores:
                    heapq.heappush(heap, (-scores[more], i, more))
            h = before[i]
            if h >= 0:
                more = symbols[h] + pair
                if more in scores:
                    heapq.heappush(heap, (-scores[more], h, more))
        ids, out = self.ids, []
        for s in symbols:
            if s is not None:
                if s in ids:
                    out.append(ids[s])
                else:
                    out += self._symbol(s)
        return out

    def _symbol(self, s: str) -> list[int]:
        if s in self.ids:
            return [self.ids[s]]
        return [self.bytes[b] for b in s.encode()] if self.bytes else [self.unknown]

    def segment(self, text: str) -> list[int]:
        """Ids of a segment, cut further where no piece joins two neighbours."""
        whole = self.cuts and text.isascii()  # cut already, byte by byte
        text = text.replace(" ", SPACE)
        if whole:
            return self.merge(text)
        joins, first, out = self.joins, 0, []
        parts = self.parts
        for i in range(1, len(text) + 1):
            if i == len(text) or text[i - 1 : i + 1] not in joins:
                part = text[first:i]
                got = parts.get(part)
                if got is None:
                    got = parts[part] = self.merge(part)
                out += got
                first = i
        return out

    def _learn(self, raw: list[bytes]) -> None:
        if self.held > CACHE_BYTES:
            self.known, self.parts, self.held = {}, {}, 0
        texts = [r.decode() for r in raw]
        found = [self.segment(t) for t in texts]
        if self.check:
            if self.cuts:
                asked = [t[1:] if t[0] == " " else "\n" + t for t in texts]
                skip = [0 if t[0] == " " else 2 for t in texts]
            else:
                asked, skip = [t[1:] for t in texts], [0] * len(texts)
            for t, mine, theirs, k in zip(texts, found, self.library.encode(asked, num_threads=1), skip, strict=True):
                # the library sees nothing at all in an empty text, where the segment is the lone blank before more
                if mine != theirs[k:] and t != " ":
                    raise AssertionError(f"the agenda and the library differ on {t!r}: {mine} and {theirs[k:]}")
        for r, ids in zip(raw, found, strict=True):
            self.known[r] = (np.array(ids, "<i4").tobytes(), " ".join(map(str, ids)))
            self.held += ENTRY + 2 * len(r) + 20 * len(ids)

    def encode(self, column: pa.Array):
        """Flat ids, ids per row, and the decimal ids of each row joined by blanks; no end id yet."""
        texts = [" " + x.replace(SPACE, " ") if x else "" for x in column.to_pylist()]
        flat, offsets = text_bytes(pa.array(texts, pa.large_string()))
        n, size = len(texts), len(flat)
        if not size:
            return np.zeros(0, np.int32), np.zeros(n, np.int64), [""] * n
        first = np.zeros(size + 1, bool)
        first[offsets] = True
        if self.cuts:
            blank, line = flat == 32, flat == 10
            first[1:size] |= (blank[1:] & ~blank[:-1]) | line[1:] | line[:-1] | ~self.byte_joins[flat[:-1], flat[1:]]
        starts = np.flatnonzero(first[:-1])
        ends = np.append(starts[1:], size)
        codes, rep = intern(flat, starts, ends)
        raw = words_of(flat, starts, ends, rep)
        new = [r for r in raw if r not in self.known]
        if new:
            mine = self.known
            self._learn(new)
            if self.known is not mine:  # begun anew: what was known before is learned again
                self._learn([r for r in raw if r not in self.known])
        pieces = [self.known[r] for r in raw]
        pool = np.frombuffer(b"".join(p[0] for p in pieces), "<i4")
        length = np.array([len(p[0]) // 4 for p in pieces], np.int64)
        count = length[codes]
        ids = pool[ragged((np.cumsum(length) - length)[codes], count)]
        at = np.searchsorted(starts, offsets)
        said = [p[1] for p in pieces].__getitem__
        listed = codes.tolist()
        at = at.tolist()
        joined = [" ".join(map(said, listed[a:b])) for a, b in zip(at[:-1], at[1:], strict=True)]
        row = np.searchsorted(offsets, starts, side="right") - 1
        return ids, np.bincount(row, weights=count, minlength=n).astype(np.int64), joined


_AGENDAS: dict[str, Agenda] = {}


def agenda(path: str) -> Agenda:
    if path not in _AGENDAS:
        _AGENDAS[path] = Agenda(path)
    return _AGENDAS[path]


def encode(docs: DataFrame, vocabulary: str, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (with the end id; null unless asked for), decoded, ids_sha256, decoded_sha256."""

    def run(batches):
        coder = agenda(vocabulary)
        end = f"{coder.end}"
        for batch in batches:
            column = batch.column(1)
            for first, last in slices(column):
                ids, counts, joined = coder.encode(column.slice(first, last - first))
                flat, ends = ids.tolist(), np.cumsum(counts).tolist()
                lists = [[*flat[b - n : b], coder.end] for b, n in zip(ends, counts.tolist(), strict=True)]
                decoded = [coder.library.decode(x) for x in lists]
                sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
                n = last - first
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, n),
                        pa.array(counts + 1, pa.int64()),
                        pa.array([sha(f"{x} {end}" if x else end) for x in joined], pa.string()),
                        pa.array([sha(x) for x in decoded], pa.string()),
                        pa.array(lists if with_ids else [None] * n, pa.list_(pa.int32())),
                        pa.array(decoded if with_ids else [None] * n, pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"],
                )

    return id_text(docs).mapInArrow(tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>, decoded string")


def op3(spark, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), default_vocabulary("piece_bpe_32k.model"), with_ids=False).drop("ids", "decoded")
