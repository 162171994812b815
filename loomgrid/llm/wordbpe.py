"""Token ids of whole texts by a tokenizers file, with each distinct word encoded once.

For a tokenizer whose normaliser works code point by code point (NFC, blanks to one space, lower case) and whose
pre-tokeniser never joins across blanks, the ids of a text are the ids of its blank-separated words, one after the
other. Words are interned per batch (``wordtable``), and only words not met before reach the library. Any other
tokenizer encodes whole texts with the library.
"""

from __future__ import annotations

import json
import os
import string
import unicodedata

import numpy as np
import pyarrow as pa

from .wordtable import intern, ragged, slices, spans, text_bytes, words_of

#: Bytes of distinct words and their ids kept per worker, and what an entry takes besides; the cache starts anew beyond
#: it, which costs time and changes nothing else.
CACHE_BYTES, ENTRY = 64 << 20, 180
_NFC, _BLANKS, _LOWER = {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}


def _by_words(spec: dict) -> bool:
    """Whether the ids of a text are those of its words."""
    norm, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    parts = pre.get("pretokenizers") or [{}]
    pattern = (parts[0].get("pattern") or {}).get("Regex", "")
    return (
        norm.get("normalizers") == [_NFC, _BLANKS, _LOWER]
        and parts[0].get("type") == "Split" and parts[0].get("behavior") == "Removed" and parts[0].get("invert") is True
        and pattern.endswith("[^\\s\\p{L}\\p{N}]+") and "[\\p{L}]+" in pattern
        and [p.get("type") for p in parts[1:]] == ["ByteLevel"] and not parts[1].get("add_prefix_space") and not parts[1].get("use_regex", True)
        and spec.get("post_processor") is None
    )


def _byte_chars() -> dict[int, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: b for b in own} | {b: 256 + k for k, b in enumerate(rest)}


_MARK, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_MARK[list(string.punctuation.encode())] = True
_LETTER[list(string.ascii_letters.encode())] = True
#: Marks after a word that are cut off here; longer runs stay with their word, and are told apart where it is learnt.
MARKS = 8


def simplified(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same words with fewer distinct ones among them: ASCII words in lower case, and the marks after a last ASCII
    letter as a span of their own (the pre-tokeniser parts them there). Words with "<" are left, for special tokens."""
    if not len(starts):
        return flat, starts, ends
    special, other = np.zeros(len(starts), bool), np.zeros(len(starts), bool)
    special[np.searchsorted(starts, np.flatnonzero(flat == 60), side="right") - 1] = True
    other[np.searchsorted(starts, np.flatnonzero(flat >= 128), side="right") - 1] = True
    upper = np.flatnonzero((flat >= 65) & (flat <= 90))
    upper = upper[~(special | other)[np.searchsorted(starts, upper, side="right") - 1]]
    flat = flat.copy()
    flat[upper] += 32
    words = np.flatnonzero(_MARK[flat[ends - 1]] & ~special)
    cut = ends[words] - 1
    for _ in range(MARKS):
        back = (cut > starts[words]) & _MARK[flat[cut - 1]]
        if not back.any():
            break
        cut = cut - back
    # a run that goes on ends in no letter here
    parted = (cut > starts[words]) & _LETTER[flat[cut - 1]]
    words, cut = words[parted], cut[parted]
    return flat, np.insert(starts, words + 1, cut), np.insert(ends, words, cut)


class TokenEncoder:
    """Encodes string columns into flat token ids and counts per row; null texts are empty."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_words = _by_words(spec)
        self.dtype = np.dtype("<u2") if self.full.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        if self.by_words:
            # the library's own merges alone, for words of letters that are normalised already
            self.bare = Tokenizer(self.full.model)
            self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            self.chars = _byte_chars()
            suffix = spec["model"].get("end_of_word_suffix")
            self.closes = np.zeros(self.full.get_vocab_size(), bool)
            if suffix:
                self.closes[[i for t, i in self.full.get_vocab().items() if t.endswith(suffix)]] = True
        self.known: dict[bytes, bytes] = {}
        self.held = 0

    def _library(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.full.encode_batch_fast(words, add_special_tokens=False)]

    def _letters(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters, joined: each is one pre-token and ends in the one id that closes a word."""
        return self._closed([w.encode().decode("latin-1").translate(self.chars) for w in words], words)

    def _closed(self, written: list[str], words: list[str]) -> list[bytes]:
        """Ids of words, each ``written`` in the byte-level alphabet."""
        out: list[bytes] = []
        for k in range(0, len(written), 512):
            part = written[k : k + 512]
            ids = np.array(self.bare.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, self.dtype)
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) != len(part) or ends[-1] != len(ids):
                out += self._library(words[k : k + 512])
                continue
            raw, size = ids.tobytes(), self.dtype.itemsize
            at = (ends * size).tolist()
            out += [raw[a:b] for a, b in zip([0, *at[:-1]], at, strict=True)]
        return out

    def _learn(self, words: list[bytes]) -> None:
        """Puts the ids of new words into the cache."""
        known, need, form = self.known, {}, {}
        for raw in words:
            w = raw.decode()
            if w.isascii() and "<|" not in w:
                w = w.lower()
            tail, base = "", w.rstrip(string.punctuation)
            # the letter as normalised: some become a letter and a combining mark, which joins the marks after it
            if base != w and base and unicodedata.normalize("NFC", base[-1]).lower()[-1].isalpha() and "<|" not in w:
                w, tail = base, w[len(base) :]  # letters end there, and the run of marks is a pre-token of its own
            form[raw] = (w.encode(), tail.encode())
            for part in form[raw]:
                if part and part not in known:
                    need[part] = None
        plain, other = [], []
        for raw in need:
            w = raw.decode()
            if w.isalpha() and (w.isascii() and w.islower() or w == w.lower() and "σ" not in w and "ς" not in w and unicodedata.is_normalized("NFC", w) and "İ" not in w):
                plain.append(w)
            else:
                other.append(w)
        for group, ids in ((plain, self._letters(plain)), (other, self._library(other))):
            for w, i in zip(group, ids, strict=True):
                known[w.encode()] = i
        for raw, (w, tail) in form.items():
            if raw not in known:
                known[raw] = known[w] + (known[tail] if tail else b"")

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the number of ids of each row, for a batch of bounded bytes."""
        flat, offsets = text_bytes(column)
        n = len(offsets) - 1
        if not self.by_words:
            found = self._library([x or "" for x in column.to_pylist()])
            return np.frombuffer(b"".join(found), self.dtype), np.array([len(x) // self.dtype.itemsize for x in found], np.int64)
        flat, starts, ends = simplified(flat, *spans((flat == 32) | (flat == 10), offsets))
        if not len(starts):
            return np.zeros(0, self.dtype), np.zeros(n, np.int64)
        codes, rep = intern(flat, starts, ends)
        words = words_of(flat, starts, ends, rep)
        if self.held > CACHE_BYTES:
            self.known, self.held = {}, 0
        known, before = self.known, len(self.known)
        pieces = list(map(known.get, words))
        new = [k for k, ids in enumerate(pieces) if ids is None]
        if new:
            # words of a to z alone are written alike in the byte-level alphabet and normalised already
            odd = np.append(0, np.cumsum((flat < 97) | (flat > 122)))
            plain = (odd[ends[rep[new]]] == odd[starts[rep[new]]]).tolist()
            letters = [words[k] for k, p in zip(new, plain, strict=True) if p]
            if letters:
                written = b" ".join(letters).decode().split(" ")
                known.update(zip(letters, self._closed(written, written), strict=True))
            self._learn([words[k] for k, p in zip(new, plain, strict=True) if not p])
            for k in new:
                pieces[k] = known[words[k]]
            self.held += ENTRY * (len(known) - before) + 2 * sum(len(words[k]) for k in new)
        pool = np.frombuffer(b"".join(pieces), self.dtype)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces)) // self.dtype.itemsize
        count = size[codes]
        ids = pool[ragged((np.cumsum(size) - size)[codes], count)]
        row = np.searchsorted(offsets, starts, side="right") - 1
        return ids, np.bincount(row, weights=count, minlength=n).astype(np.int64)

    def encode_slices(self, column: pa.Array):
        """(first row, ids, counts) of pieces of the column that hold a few MB of text each."""
        for first, last in slices(column):
            yield (first, *self.encode(column.slice(first, last - first)))


_ENCODERS: dict[str, TokenEncoder] = {}


def encoder(path: str) -> TokenEncoder:
    """One encoder, and so one cache, per worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TokenEncoder(path)
    return _ENCODERS[path]


def default_vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
