"""Masked pseudo-likelihood: a bidirectional window network that predicts every token from both sides.

Tokens are the subword ids of a published vocabulary (a parameter), so every position of every text is a token of its
own; nothing is cut off or hashed together. Ids are ranked by their counts over the whole corpus. The network sums
position-weighted embeddings of the ``REACH`` tokens on either side and passes them through a hidden layer. Softmaxes
over classes and within a class predict the ``HEAD`` most frequent ids; one class stands for all others, and two more
softmaxes predict their group and the place within it. So a prediction is a proper probability over all ids.

Training is numpy on the executors, by masked positions: of every document each ``MASK``-th token is masked and
predicted from its surroundings, all others only surround it. Documents are dealt by a hash of their id and text into
shards whose number follows the corpus' tokens, and each shard is sorted, so what a shard trains on does not depend on
files or partitions: weights are the same to the last bit, and scores but for the rounding of products. In each of ``ROUNDS`` rounds every shard starts from the same weights and learns from its share
(a document belongs to one round); changes, as integers weighted by the occurrences a shard saw, are summed in any
order and divided once. Only one set of weights comes to the driver, whose size is that of the vocabulary.

A document's score is the sum over all its tokens of log p(token | tokens around it).

Defined results: a text without tokens (null, empty) has sum 0 and a null mean; repeated rows get equal scores (to
rounding), and train side by side in one shard; an empty table gives no rows; a null doc_id is kept; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, id_text, materialise, table, tidy
from .huffman import global_counts
from .wordbpe import default_vocabulary, encoder
from .wordtable import ragged, spans, text_bytes

KINDS, WITHIN, REACH, EMBED, HIDDEN = 32, 32, 3, 16, 32
#: Ids that have a place in a class; the last class stands for all others.
HEAD = (KINDS - 1) * WITHIN
ROUNDS, MASK, BATCH, RATE = 2, 6, 2048, 0.2
#: Tokens of a shard, tokens that are read at once and scored at once, and tasks that shards are dealt to at most.
SHARD_TOKENS, PIECE, SCORED, TASKS = 4_000_000, 1 << 16, 1 << 14, 4096
#: Start of the squares of gradients, and the unit of changes as integers.
SQUARE, UNIT = 1e-4, float(1 << 20)
#: Rows of the embeddings that travel as one block.
BLOCK = 256


def softmax(x: np.ndarray) -> np.ndarray:
    """In place, a distribution per column; columns are cases, so that sums and maxima run along memory."""
    x -= x.max(0)
    np.exp(x, out=x)
    x /= x.sum(0)
    return x


def log_softmax_at(x: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The log of the softmax of each column of x, at one place; x is spent."""
    x -= x.max(0)
    at = x[place, np.arange(x.shape[1])]
    np.exp(x, out=x)
    return at - np.log(x.sum(0))


def logits(weights: np.ndarray, bias: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A row per place, a column per case."""
    x = weights.T @ h.T
    x += bias[:, None]
    return x


def runs(sorted_keys: np.ndarray):
    """(key, first, end) of the runs of equal keys."""
    first = np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1])) if len(sorted_keys) else np.zeros(0, np.int64)
    return zip(sorted_keys[first].tolist(), first.tolist(), [*first[1:].tolist(), len(sorted_keys)], strict=True)


class Network:
    """Weights of a network over ``size`` ranked ids; id ``size`` stands for what lies beyond a text."""

    #: The weights that every batch changes, and those of rare ids, which are changed by rows.
    DENSE = ("place", "inner", "bias", "kind", "kind_bias", "word", "word_bias", "group", "group_bias")
    ROWS = ("embed", "slot")

    def __init__(self, size: int):
        self.size = size
        self.side = max(1, int(np.ceil(np.sqrt(max(0, size - HEAD)))))  # groups of the others, and ids of a group

    def shapes(self) -> dict[str, tuple]:
        g = self.side
        return {
            "place": (2 * REACH, EMBED), "inner": (EMBED, HIDDEN), "bias": (HIDDEN,), "kind": (HIDDEN, KINDS), "kind_bias": (KINDS,), "word": (KINDS - 1, HIDDEN, WITHIN), "word_bias": (KINDS - 1, WITHIN),
            "group": (HIDDEN, g), "group_bias": (g,), "embed": (self.size + 1, EMBED), "slot": (g, (HIDDEN + 1) * g),
        }

    @classmethod
    def start(cls, counts: np.ndarray, seed: int = 1) -> Network:
        """Small random weights; biases at the log frequencies. counts: by rank."""
        net, rng = cls(len(counts)), np.random.default_rng(seed)
        net.w = w = {k: rng.normal(0, 0.1, s).astype(np.float32) for k, s in net.shapes().items()}
        w["place"] += 1
        w["embed"] *= 3
        w["bias"] *= 0
        mass = np.zeros(HEAD + net.side**2)
        mass[: net.size] = counts + 0.5
        head, tail = mass[:HEAD].reshape(-1, WITHIN), mass[HEAD:].reshape(net.side, net.side)

        def log_share(x, total):
            with np.errstate(divide="ignore", invalid="ignore"):
                return np.where(x > 0, np.log(x / total), -1e9).astype(np.float32)  # places without an id

        w["kind_bias"] = log_share(np.append(head.sum(1), tail.sum()), mass.sum())
        w["word_bias"] = log_share(head, head.sum(1, keepdims=True))
        w["group_bias"] = log_share(tail.sum(1), tail.sum())
        w["slot"].reshape(net.side, HIDDEN + 1, net.side)[:, -1] = log_share(tail, tail.sum(1, keepdims=True))
        return net

    def slots(self, g: int) -> tuple[np.ndarray, np.ndarray]:
        """The weights and biases of the places of a group, as views."""
        both = self.w["slot"][g].reshape(HIDDEN + 1, self.side)
        return both[:-1], both[-1]

    # -- scoring

    def ready(self) -> Network:
        """What the inner layer gets from each id at each place: the weights are not changed any more."""
        w = self.w
        self.given = [(w["embed"] * w["place"][k]) @ w["inner"] for k in range(2 * REACH)]
        return self

    def log_prob(self, flat: np.ndarray) -> np.ndarray:
        """log p(id | ids around it) of each of the ranks in ``flat``, of which the outer REACH only surround others."""
        w, n = self.w, len(flat) - 2 * REACH
        x = np.empty((n, HIDDEN), np.float32)
        x[:] = w["bias"]
        for k, step in enumerate(STEPS):
            x += self.given[k].take(flat[REACH + step : REACH + step + n], axis=0)
        h = np.tanh(x, out=x)
        ids = flat[REACH : REACH + n]
        out = np.zeros(n, np.float64)
        real = np.flatnonzero(ids < self.size)
        kind = np.minimum(ids[real] // WITHIN, KINDS - 1).astype(np.uint8)
        order = real[np.argsort(kind, kind="stable")]
        kind = np.sort(kind, kind="stable")
        h, ids = h.take(order, axis=0), ids[order].astype(np.int64)
        got = log_softmax_at(logits(w["kind"], w["kind_bias"], h), kind).astype(np.float64)
        for c, a, b in runs(kind):
            if c < KINDS - 1:
                got[a:b] += log_softmax_at(logits(w["word"][c], w["word_bias"][c], h[a:b]), ids[a:b] % WITHIN)
                continue
            tail, ht = ids[a:b] - HEAD, h[a:b]
            by = np.argsort(tail, kind="stable")
            tail, ht = tail[by], ht[by]
            part = log_softmax_at(logits(w["group"], w["group_bias"], ht), tail // self.side).astype(np.float64)
            for g, s, e in runs(tail // self.side):
                weights, bias = self.slots(g)
                part[s:e] += log_softmax_at(logits(weights, bias, ht[s:e]), tail[s:e] % self.side)
            got[a + by] += part
        out[order] = got
        return out

    # -- training

    def learn(self) -> Network:
        """Squares of gradients: of each weight, or of each row of rare ids."""
        self.squares = {k: np.full(self.w[k].shape, SQUARE, np.float32) for k in self.DENSE}
        self.squares |= {k: np.full(len(self.w[k]), 1e-8, np.float32) for k in self.ROWS}
        return self

    def step(self, flat: np.ndarray, at: np.ndarray, rate: float = RATE) -> None:
        """One step of AdaGrad on the mean log loss of the ids at the places ``at`` of ``flat``."""
        w, n = self.w, len(at)
        order = np.argsort(flat[at], kind="stable")
        at = at[order]
        ids = flat[at].astype(np.int64)
        around = [flat[at + step] for step in STEPS]
        seen = [w["embed"].take(x, axis=0) for x in around]
        total = np.zeros((n, EMBED), np.float32)
        for k, x in enumerate(seen):
            total += x * w["place"][k]
        h = np.tanh(total @ w["inner"] + w["bias"])
        kind = np.minimum(ids // WITHIN, KINDS - 1)
        d = softmax(logits(w["kind"], w["kind_bias"], h))
        d[kind, np.arange(n)] -= 1
        grad = {"kind": h.T @ d.T, "kind_bias": d.sum(1), "word": np.zeros_like(w["word"]), "word_bias": np.zeros_like(w["word_bias"])}
        d_h = d.T @ w["kind"].T
        for c, a, b in runs(kind):
            if c < KINDS - 1:
                d = softmax(logits(w["word"][c], w["word_bias"][c], h[a:b]))
                d[ids[a:b] % WITHIN, np.arange(b - a)] -= 1
                grad["word"][c], grad["word_bias"][c] = h[a:b].T @ d.T, d.sum(1)
                d_h[a:b] += d.T @ w["word"][c].T
                continue
            tail, ht = ids[a:b] - HEAD, h[a:b]
            d = softmax(logits(w["group"], w["group_bias"], ht))
            d[tail // self.side, np.arange(b - a)] -= 1
            grad["group"], grad["group_bias"] = ht.T @ d.T, d.sum(1)
            d_h[a:b] += d.T @ w["group"].T
            for g, s, e in runs(tail // self.side):
                weights, bias = self.slots(g)
                d = softmax(logits(weights, bias, ht[s:e]))
                d[tail[s:e] % self.side, np.arange(e - s)] -= 1
                d_h[a + s : a + e] += d.T @ weights.T
                change = np.concatenate([ht[s:e].T @ d.T, d.sum(1)[None]]).ravel() / n
                self._move("slot", np.array([g]), change[None], rate)
        d_pre = d_h * (1 - h * h)
        grad["inner"], grad["bias"] = total.T @ d_pre, d_pre.sum(0)
        d_total = d_pre @ w["inner"].T
        grad["place"] = np.stack([np.einsum("ij,ij->j", d_total, x) for x in seen])
        every = np.concatenate(around)
        by = np.argsort(every, kind="stable")
        first = np.flatnonzero(np.append(True, every[by][1:] != every[by][:-1]))
        each = np.concatenate([d_total * w["place"][k] for k in range(2 * REACH)])
        self._move("embed", every[by][first].astype(np.int64), np.add.reduceat(each.take(by, axis=0), first, axis=0) / np.float32(n), rate)
        for k, g in grad.items():
            g = g / np.float32(n)
            self.squares[k] += g * g
            w[k] -= rate * g / np.sqrt(self.squares[k])

    def _move(self, name: str, rows: np.ndarray, grad: np.ndarray, rate: float) -> None:
        self.squares[name][rows] += np.einsum("ij,ij->i", grad, grad) / grad.shape[1]
        self.w[name][rows] -= rate * grad / np.sqrt(self.squares[name][rows])[:, None]

    # -- changes of weights, as integers

    def dense(self) -> np.ndarray:
        return np.concatenate([self.w[k].ravel() for k in self.DENSE])

    def put_dense(self, flat: np.ndarray) -> None:
        at = 0
        for k in self.DENSE:
            size = self.w[k].size
            self.w[k] = flat[at : at + size].reshape(self.w[k].shape).astype(np.float32)
            at += size

    def copy(self) -> Network:
        out = Network(self.size)
        out.w = {k: v.copy() for k, v in self.w.items()}
        return out


STEPS = [*range(-REACH, 0), *range(1, REACH + 1)]


class Changes:
    """Sums over shards of changes times occurrences, as integers, so that any order gives the same."""

    def __init__(self, net: Network):
        self.net, self.words, self.dense = net, 0, np.zeros(len(net.dense()), np.int64)
        self.seen = {k: np.zeros(len(net.w[k]), np.int64) for k in net.ROWS}
        self.sums = {k: np.zeros(net.w[k].shape, np.int64) for k in net.ROWS}

    def add(self, start: Network, met: dict[str, np.ndarray], words: int) -> None:
        """What a shard changed. met: occurrences that moved each row."""
        whole = lambda x: np.rint(x * np.float32(UNIT)).astype(np.int64)
        self.words += words
        self.dense += words * whole(self.net.dense() - start.dense())
        for k, n in met.items():
            rows = np.flatnonzero(n)
            self.seen[k][rows] += n[rows]
            self.sums[k][rows] += n[rows, None] * whole(self.net.w[k][rows] - start.w[k][rows])

    def blocks(self):
        """(name, block, occurrences by row, sums) of what was seen, in blocks of bounded bytes."""
        if self.words:
            yield "dense", 0, np.array([self.words]), self.dense
        for k in self.net.ROWS:
            step = max(1, BLOCK * EMBED // self.net.w[k].shape[1])
            some = np.unique(np.flatnonzero(self.seen[k]) // step)
            for b in some.tolist():
                rows = slice(b * step, (b + 1) * step)
                yield k, b, self.seen[k][rows], self.sums[k][rows]


def sum_blocks(batches):
    """Adds up blocks of equal names; rows arrive in any order."""
    held: dict[tuple, list[np.ndarray]] = {}
    for batch in batches:
        for name, block, n, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            n, v = np.frombuffer(n, np.int64), np.frombuffer(v, np.int64)
            if (name, block) in held:
                held[name, block][0] += n
                held[name, block][1] += v
            else:
                held[name, block] = [n.copy(), v.copy()]
    for (name, block), (n, v) in held.items():
        by = np.maximum(np.repeat(n, len(v) // len(n)), 1)
        mean = (v.astype(np.float64) / by / UNIT).astype("<f4")
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([block]), pa.array([mean.tobytes()], pa.binary())], names=["name", "block", "mean"])


# ------------------------------------------------------------------------------------------- Spark


def tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, tie (a hash of the text), n_words, ids (little-endian u16 or u32), width."""

    def run(batches):
        enc = encoder(vocabulary)
        for batch in batches:
            column = batch.column(1)
            for first, ids, counts in enc.encode_slices(column):
                size, n = enc.dtype.itemsize, len(counts)
                at, raw = np.append(0, np.cumsum(counts)) * size, ids.tobytes()
                flat, offsets = text_bytes(column.slice(first, n))
                starts, _ = spans((flat == 32) | ((flat >= 9) & (flat <= 13)), offsets)
                words = np.bincount(np.searchsorted(offsets, starts, side="right") - 1, minlength=n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), batch.column(2).slice(first, n), pa.array(words, pa.int64()), pa.array([raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary()), pa.array([size] * n, pa.int32())],
                    names=["doc_id", "tie", "n_words", "ids", "width"],
                )

    return id_text(docs).withColumn("tie", F.xxhash64("text")).mapInArrow(tidy(run), "doc_id long, tie long, n_words long, ids binary, width int")


def padded(rank: np.ndarray, rows: list[bytes], width: int, pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranks of all rows with REACH pads before, between and after them; the place of each row's first rank, and its length."""
    size = np.array([len(x) // width for x in rows], np.int64)
    first = REACH + np.cumsum(size + REACH) - (size + REACH)
    flat = np.full(REACH + int((size + REACH).sum()), pad, rank.dtype)
    flat[ragged(first, size)] = rank[np.frombuffer(b"".join(rows), f"<u{width}")]
    return flat, first, size


def masked(first: np.ndarray, size: np.ndarray, ties: np.ndarray, every: int) -> np.ndarray:
    """The places of the masked tokens: each ``every``-th of a row, from an offset that its hash gives."""
    offset = (ties.astype(np.int64) >> 7) % every
    count = np.maximum(0, -(-(size - offset) // every))
    return np.repeat(first + offset, count) + every * ragged(np.zeros(len(count), np.int64), count)


def train(toks: DataFrame, counts: np.ndarray, rounds: int = ROUNDS, shard_tokens: int = SHARD_TOKENS) -> tuple[np.ndarray, Network]:
    """The rank of each id, and the network. counts: of each id over all of ``toks`` (see ``tokens``)."""
    spark = toks.sparkSession
    rank = np.empty(len(counts), np.uint16 if len(counts) < 1 << 16 else np.uint32)
    by = np.lexsort((np.arange(len(counts)), -counts))
    rank[by] = np.arange(len(counts))
    net = Network.start(counts[by])
    shards = max(1, -(-int(counts.sum()) // (rounds * shard_tokens)))
    n_tasks = min(shards, TASKS)
    dealt = toks.where(F.length("ids") > 0).select("doc_id", "tie", "ids", "width", F.xxhash64("doc_id", "tie").alias("hash"))
    for k in range(rounds):
        shared = spark.sparkContext.broadcast((rank, net))

        def learn(batches, shared=shared):
            rank, start = shared.value
            net = start.copy()
            changes, pad = Changes(net), start.size
            met = words = shard = None
            held, ties, weight = [], [], 0

            def flush():
                nonlocal held, ties, weight, words
                flat, first, size = padded(rank, held, width, pad)
                at = masked(first, size, np.array(ties, np.int64), MASK)
                for s in range(0, len(at), BATCH):
                    net.step(flat, at[s : s + BATCH])
                words += len(at)
                for step in STEPS:
                    met["embed"] += np.bincount(flat[at + step], minlength=pad + 1)
                tail = flat[at][flat[at] >= HEAD].astype(np.int64) - HEAD
                met["slot"] += np.bincount(tail // net.side, minlength=net.side)
                held, ties, weight = [], [], 0

            def close():
                if held:
                    flush()
                if shard is not None:
                    changes.add(start, met, words)

            for batch in batches:
                for one, tie, ids, width in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if one != shard:
                        close()
                        shard, words, met = one, 0, {k: np.zeros(len(start.w[k]), np.int64) for k in start.ROWS}
                        net.w = {k: v.copy() for k, v in start.w.items()}
                        net.learn()
                    held.append(ids)
                    ties.append(tie)
                    weight += len(ids)
                    if weight >= PIECE * width:
                        flush()
            close()
            for name, block, n, v in changes.blocks():
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([block]), pa.array([n.astype(np.int64).tobytes()], pa.binary()), pa.array([np.ascontiguousarray(v).tobytes()], pa.binary())], names=["name", "block", "n", "v"])

        mine = dealt.where(F.pmod(F.shiftright("hash", 40), F.lit(rounds)) == k).withColumn("shard", F.pmod("hash", F.lit(shards)))
        ordered = mine.repartitionById(n_tasks, F.pmod("shard", F.lit(n_tasks)).cast("int")).sortWithinPartitions("shard", "tie", "doc_id")
        parts = materialise(ordered.select("shard", "tie", "ids", "width").mapInArrow(tidy(learn), "name string, block long, n binary, v binary"), "changes")
        means = parts.repartition("name", "block").mapInArrow(tidy(sum_blocks), "name string, block long, mean binary")
        net = net.copy()
        for r in means.toLocalIterator():  # together as large as the weights
            mean = np.frombuffer(bytes(r.mean), "<f4")
            if r.name == "dense":
                net.put_dense(net.dense() + mean)
            else:
                step = max(1, BLOCK * EMBED // net.w[r.name].shape[1])
                net.w[r.name][r.block * step : (r.block + 1) * step] += mean.reshape(-1, net.w[r.name].shape[1])
        shared.destroy()
        drop(parts)
    return rank, net


def score(toks: DataFrame, model: tuple[np.ndarray, Network]) -> DataFrame:
    """doc_id, n_words, n_tokens, log_likelihood (the sum over tokens), mean_log_likelihood (a token's)."""
    shared = toks.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        rank, net = shared.value
        net.ready()
        for batch in batches:
            ids, widths = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            at = 0
            while at < len(ids):
                to, weight = at, 0
                while to < len(ids) and (to == at or weight + len(ids[to]) <= 2 * PIECE * widths[at]):
                    weight += len(ids[to])
                    to += 1
                flat, first, size = padded(rank, ids[at:to], widths[at], net.size)
                each = np.zeros(len(flat) + 1)
                for s in range(0, len(flat) - 2 * REACH, SCORED):
                    part = flat[s : s + SCORED + 2 * REACH]
                    each[s + REACH : s + len(part) - REACH] = net.log_prob(part)
                some = size > 0
                total = np.zeros(to - at)
                if some.any():
                    sums = np.add.reduceat(each, np.column_stack([first[some], first[some] + size[some]]).ravel())[::2]
                    total[some] = sums
                mean = pa.array(total / np.maximum(size, 1), mask=~some)
                n = to - at
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), batch.column(1).slice(at, n), pa.array(size), pa.array(total), mean], names=["doc_id", "n_words", "n_tokens", "log_likelihood", "mean_log_likelihood"])
                at = to

    return toks.select("doc_id", "n_words", "ids", "width").mapInArrow(tidy(run), "doc_id long, n_words long, n_tokens long, log_likelihood double, mean_log_likelihood double")


def prepared(docs: DataFrame, vocabulary: str | None = None) -> tuple[DataFrame, np.ndarray]:
    """The tokens as a table in the shared folder, and the counts of all ids."""
    toks = materialise(tokens(docs, vocabulary or default_vocabulary()), "tokens")
    return toks, global_counts(toks)


def op1(spark, sf_dir: str) -> DataFrame:
    toks, counts = prepared(table(spark, sf_dir, "documents"))
    return score(toks, train(toks, counts))
