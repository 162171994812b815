"""The llm operators against brute force, exact round trips and held-out accuracy, with edge cases of the input."""

import gzip
import hashlib
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgrid.llm import common, covertree, huffman, packing, pseudolikelihood, quality_rules, sentencepieces, simhash, suffixdedup, toxicity, warc, wordbpe, wordtable

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def _prose(seed, n):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


BASE = _prose(1, 120)
#: null and empty texts, blanks alone, a very long text, letters of several bytes, a null id, a repeated row, copies
TEXTS = [
    (10, BASE), (11, None), (12, ""), (13, " \n\t \x0b"), (14, _prose(2, 30_000)), (15, "Ünï-cödé ▁ ́ <|endoftext|> </s> 😀\x00 d'où  wide"), (None, BASE + " more words at the end of it"),
    (16, "one"), (16, "one"), (17, "two words"), (18, "start here " + BASE + " and end there"), (19, BASE), (20, "x" * 5000), (21, "ab" * 300), (22, "don't !!!??? I'LL 1234 a1b2... ÉCOLE"), (23, "line\nline\nline\n\nother line"),
]


@pytest.fixture(scope="module")
def docs(spark):
    """The edge texts, with columns whose names operators use themselves."""
    rows = [(i, t, "n", 5, b"z", -1.0) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, fp int, value binary, score double").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def sample(spark, sf):
    return common.table(spark, sf, "documents")


def _bag(rows):
    return Counter(tuple(r) for r in rows)


# ------------------------------------------------------------------------------------------- words


def test_words_are_interned_exactly():
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("ab"), rng.integers(1, 200))) for _ in range(300)] + ["a", "b", "a" * 96, "a" * 97]
    flat, offsets = wordtable.text_bytes(pa.array([" ".join(words), None, "", "a b"]))
    starts, ends = wordtable.spans(flat == 32, offsets)
    codes, rep = wordtable.intern(flat, starts, ends)
    names = wordtable.words_of(flat, starts, ends, rep)
    assert [names[c].decode() for c in codes] == [*words, "a", "b"] and len(set(names)) == len(names)


# ------------------------------------------------------------------------------------------- 1


def _ranks(text, rank):
    ids = np.array(wordbpe.encoder(wordbpe.default_vocabulary()).full.encode(text or "", add_special_tokens=False).ids, np.int64)
    return rank[ids].astype(np.int64)


def _log_probs_by_hand(net, ranks):
    """log p of each rank from the weights, one by one."""
    w, pad, r = net.w, net.size, pseudolikelihood.REACH
    flat, out = [pad] * r + ranks.tolist() + [pad] * r, []
    log_softmax = lambda x: x - np.logaddexp.reduce(x)
    for k, i in enumerate(ranks.tolist(), r):
        around = [*flat[k - r : k], *flat[k + 1 : k + 1 + r]]
        h = np.tanh(sum(w["embed"][x] * w["place"][j] for j, x in enumerate(around)) @ w["inner"] + w["bias"])
        kinds = log_softmax(h @ w["kind"] + w["kind_bias"])
        if i < pseudolikelihood.HEAD:
            out.append(kinds[i // 32] + log_softmax(h @ w["word"][i // 32] + w["word_bias"][i // 32])[i % 32])
        else:
            g, slot = divmod(i - pseudolikelihood.HEAD, net.side)
            weights, bias = net.slots(g)
            out.append(kinds[-1] + log_softmax(h @ w["group"] + w["group_bias"])[g] + log_softmax(h @ weights + bias)[slot])
    return np.array(out)


def test_scores_are_sums_of_conditional_log_probabilities(spark, sample, docs):
    for df in (sample, docs.select("doc_id", "text")):
        toks, counts = pseudolikelihood.prepared(df)
        rank, net = pseudolikelihood.train(toks, counts)
        got = _bag((r.doc_id, r.n_tokens, round(r.log_likelihood, 1)) for r in pseudolikelihood.score(toks, (rank, net)).collect())
        texts = [(r.doc_id, r.text) for r in df.collect()]
        assert sum(got.values()) == len(texts)
        for i, t in texts:
            ranks = _ranks(t, rank) if len(t or "") < 4000 else None
            if ranks is not None:
                total = _log_probs_by_hand(net, ranks).sum()
                assert any(x[0] == i and x[1] == len(ranks) and x[2] == pytest.approx(total, rel=1e-4, abs=0.11) for x in got), i
        # the probabilities of all ids of the vocabulary sum to one
        every, r = np.arange(net.size), pseudolikelihood.REACH
        flat = np.tile(np.array([0, 1, net.size, 0, 5, 1200, net.size]), (net.size, 1))
        flat[:, 3] = every
        each = net.ready().log_prob(np.concatenate([np.full(r, net.size), flat.ravel(), np.full(r, net.size)])).reshape(-1, 7)[:, 3]
        assert np.exp(each).sum() == pytest.approx(1, abs=1e-3)


def test_scores_do_not_depend_on_the_layout(spark, sample):
    """Nor on the number of partitions, and with several shards a round."""
    seen = []
    for n in (1, 8, 64):
        toks, counts = pseudolikelihood.prepared(sample.repartition(n))
        model = pseudolikelihood.train(toks, counts, shard_tokens=20_000)
        seen.append((model, {r.doc_id: r for r in pseudolikelihood.score(toks, model).collect()}))
    (rank, net), rows = seen[0]
    for (other_rank, other), got in seen[1:]:
        assert (rank == other_rank).all() and all((net.w[k] == other.w[k]).all() for k in net.w)
        assert got.keys() == rows.keys()
        for i, r in got.items():
            assert (r.n_words, r.n_tokens) == (rows[i].n_words, rows[i].n_tokens) and r.log_likelihood == pytest.approx(rows[i].log_likelihood, rel=1e-7)
    assert counts.sum() > 4 * 2 * 20_000


def test_network_beats_unigram_frequencies_on_held_out_texts(spark):
    """By more than 0.7 nats a token over 1,000 texts (it learns more from more), on documents that it was not trained on."""
    docs = common.table(spark, "/root/testdata/sf0.01", "documents").dropDuplicates(["text"])
    toks, counts = pseudolikelihood.prepared(docs)
    test = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = pseudolikelihood.train(toks.where(~test), counts)
    rank, net = model
    got = pseudolikelihood.score(toks.where(test), model).agg(F.sum("log_likelihood"), F.sum("n_tokens")).first()
    ids = np.concatenate([np.frombuffer(bytes(r.ids), "<u2") for r in toks.where(test).collect()])
    share = (counts + 0.5) / (counts + 0.5).sum()
    assert got[1] == len(ids) and got[0] / got[1] > np.log(share[ids]).mean() + 0.7
    assert (counts > 0).sum() > 2000 and net.size == len(counts)


def test_what_training_gathers_follows_the_corpus(spark, sample):
    """Every document is in one shard of one round, and about each MASK-th of its tokens is predicted."""
    toks, counts = pseudolikelihood.prepared(sample)
    rows = toks.where("length(ids) > 0").collect()
    flat, first, size = pseudolikelihood.padded(np.arange(len(counts)), [bytes(r.ids) for r in rows], 2, len(counts))
    assert size.sum() == counts.sum() and (np.bincount(flat)[: len(counts)] == counts).all()
    at = pseudolikelihood.masked(first, size, np.array([r.tie for r in rows]), 6)
    assert len(set(at.tolist())) == len(at) and (flat[at] < len(counts)).all()
    assert abs(len(at) - size.sum() / 6) < len(rows)


def test_scores_of_edge_texts(spark, docs, empty):
    toks, counts = pseudolikelihood.prepared(docs)
    got = pseudolikelihood.score(toks, pseudolikelihood.train(toks, counts)).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        text = next(t for i, t in TEXTS if i == r.doc_id)
        assert r.n_words == len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        assert (r.mean_log_likelihood is None) == (r.n_tokens == 0) and (r.n_tokens or r.log_likelihood == 0)
    same = [r.log_likelihood for r in got if r.doc_id in (10, 19)]
    assert same[0] == pytest.approx(same[1], rel=1e-7) and same[0] < 0
    none, counts = pseudolikelihood.prepared(empty)
    assert pseudolikelihood.score(none, pseudolikelihood.train(none, counts)).collect() == []


def test_gradients(rng=np.random.default_rng(3)):
    """With squares so large that a step is the gradient itself: against differences of the loss."""
    net = pseudolikelihood.Network.start(rng.integers(0, 50, 1500)).learn()
    flat = np.concatenate([np.full(3, 1500), rng.integers(0, 1500, 60), np.full(3, 1500)])
    at = np.arange(3, 63)
    loss = lambda: -net.ready().log_prob(flat).mean()
    before = net.copy()
    for k in net.squares:
        net.squares[k][:] = 1e16
    net.step(flat, at, rate=1e8)
    moved = {k: before.w[k] - net.w[k] for k in net.w}
    net.w = before.copy().w
    for k in net.w:
        top = np.argsort(-np.abs(moved[k]).ravel())[:3]
        for i in top.tolist():
            was = net.w[k].ravel()[i]
            net.w[k].ravel()[i] = was + 0.02
            up = loss()
            net.w[k].ravel()[i] = was - 0.02
            down = loss()
            net.w[k].ravel()[i] = was
            assert (up - down) / 0.04 == pytest.approx(moved[k].ravel()[i], rel=0.05, abs=2e-4), k


# ------------------------------------------------------------------------------------------- 2


def _cut_by_hand(rows, width=50):
    first = {}
    raw = [(i, (t or "").encode()) for i, t in rows]
    for i, b in raw:
        for k in range(len(b) - width + 1):
            w, me = b[k : k + width], float("inf") if i is None else i
            first[w] = min(first.get(w, me), me)
    out = []
    for i, b in raw:
        gone, me = bytearray(len(b)), float("inf") if i is None else i
        for k in range(len(b) - width + 1):
            if first[b[k : k + width]] < me:
                gone[k : k + width] = b"\1" * width
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def _cut(df, **kw):
    return _bag(suffixdedup.dedup(df, **kw).select("doc_id", "_n_bytes", "_n_removed", "_n_spans", "_kept_sha256").collect())


@pytest.mark.parametrize("kw", [{}, {"hot_docs": 1, "block_bytes": 2000}, {"hot_docs": 2, "block_bytes": 1}])
def test_repeated_passages(docs, kw):
    assert _cut(docs, **kw) == _cut_by_hand(TEXTS)


def test_repeated_passages_of_a_small_alphabet(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "".join(rng.choice(list("ab"), 40)) + "ab" * int(rng.integers(0, 60)) + "é" * int(rng.integers(0, 40)) + "".join(rng.choice(list("ab"), 30))) for i in range(60)]
    rows += [(100 + i, rows[i][1][5:]) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert _cut(df, block_bytes=1500) == _cut_by_hand(rows)


def test_repeated_passages_of_the_sample(sample, empty):
    assert _cut(sample) == _cut_by_hand([(r.doc_id, r.text) for r in sample.collect()])
    assert suffixdedup.dedup(empty).collect() == []


def test_index_gives_matching_statistics():
    rng = np.random.default_rng(1)
    texts = [rng.choice(list(b"abc"), rng.integers(5, 76)).astype(np.uint8).tobytes() for _ in range(60)]
    asked = [rng.choice(list(b"abcd"), 60).astype(np.uint8).tobytes() for _ in range(40)] + texts[:5]
    lay = lambda xs: (np.frombuffer(b"".join(xs), np.uint8), np.cumsum([len(x) for x in xs]) - [len(x) for x in xs], np.cumsum([len(x) for x in xs]))
    index = suffixdedup.RunLengthIndex(*lay(texts), np.arange(60), width=12)
    flat, starts, ends = lay(asked)
    for who, offset, match, _ in index.stream(flat, starts, ends):
        for w, o, m in zip(who.tolist(), offset.tolist(), match.tolist(), strict=True):
            p = asked[w][o:]
            longest = max((k for k in range(len(p) + 1) if any(p[:k] in t for t in texts)), default=0)
            # a stretch of the pattern ends where no text goes on with it
            assert m == longest
    assert len(index.run_start) < index.n


@pytest.mark.parametrize("index_bytes", [suffixdedup.INDEX_BYTES, 300])
def test_marks_need_no_index_of_lone_segments(monkeypatch, index_bytes):
    """Windows of segments are marked as by hand, and segments that have a key to themselves are never indexed."""
    rng = np.random.default_rng(7)
    pool = ["".join(rng.choice(list("abcdefgh "), 90)) for _ in range(12)]
    texts = ["".join(rng.choice(list("abcdefgh "), 40)) + "".join(p[k:] for p, k in zip(rng.choice(pool, 3), rng.integers(0, 30, 3), strict=True)) for _ in range(40)]
    texts += texts[:5]
    flat, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.append(0, np.cumsum([len(t) for t in texts]))
    first, count, keys, row = suffixdedup.window_keys(flat, offsets)
    ids, ends = rng.permutation(len(texts)), first + count + 49
    indexed, build = [], suffixdedup.RunLengthIndex.__init__
    monkeypatch.setattr(suffixdedup, "INDEX_BYTES", index_bytes)
    monkeypatch.setattr(suffixdedup.RunLengthIndex, "__init__", lambda self, flat, s, e, *a: (indexed.extend(flat[x:y].tobytes() for x, y in zip(s, e, strict=True)), build(self, flat, s, e, *a))[1])
    least, mask = suffixdedup.find_marks(keys, flat, first, ends, ids[row])
    segments = [flat[s:e].tobytes() for s, e in zip(first, ends, strict=True)]
    seg_least, win_least, of_key = {}, {}, {}
    for s, k, i in zip(segments, keys.tolist(), ids[row].tolist(), strict=True):
        seg_least[s] = min(i, seg_least.get(s, i))
        of_key.setdefault(k, set()).add(s)
    for s, i in seg_least.items():
        for k in range(len(s) - 49):
            win_least[s[k : k + 50]] = min(i, win_least.get(s[k : k + 50], i))
    assert least.tolist() == [seg_least[s] for s in segments]
    assert mask.tolist() == [sum(1 << k for k in range(len(s) - 49) if win_least[s[k : k + 50]] < seg_least[s]) for s in segments] and mask.any()
    assert Counter(indexed) == Counter(s for group in of_key.values() if len(group) > 1 for s in group) and 0 < len(indexed) < len(seg_least)


def test_keys_do_not_depend_on_pieces(monkeypatch):
    rng = np.random.default_rng(8)
    flat, offsets = rng.integers(97, 100, 3000).astype(np.uint8), np.array([0, 0, 49, 99, 1500, 1530, 3000])
    want = suffixdedup.window_keys(flat, offsets)
    for piece in (1, 7, 333):
        monkeypatch.setattr(suffixdedup, "PIECE", piece)
        assert all(np.array_equal(a, b) for a, b in zip(want, suffixdedup.window_keys(flat, offsets), strict=True))


# ------------------------------------------------------------------------------------------- 3


def _library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=wordbpe.default_vocabulary("piece_bpe_32k.model"))


def test_agenda_equals_the_library(docs, empty):
    lib, path = _library(), wordbpe.default_vocabulary("piece_bpe_32k.model")
    want = Counter()
    for i, t in TEXTS:
        ids = lib.encode(t or "", add_eos=True)
        want[(i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest())] += 1
    got = sentencepieces.encode(docs, path)
    assert _bag(got.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()) == want
    assert all(r.ids == lib.encode(dict(TEXTS)[r.doc_id] or "", add_eos=True) for r in got.where("doc_id is not null").collect())
    assert sentencepieces.encode(empty, path).collect() == []


def test_agenda_on_any_text():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    coder, lib = sentencepieces.Agenda(wordbpe.default_vocabulary("piece_bpe_32k.model")), _library()

    @settings(max_examples=300, deadline=None)
    @given(st.text(alphabet=st.one_of(st.sampled_from("  \n\t▁aeinrst.,'é日😀"), st.characters(codec="utf-8")), max_size=60))
    def check(text):
        ids, counts, joined = coder.encode(pa.array([text]))
        assert ids.tolist() == lib.encode(text) and counts.tolist() == [len(ids)] and joined == [" ".join(map(str, ids.tolist()))]

    check()


# ------------------------------------------------------------------------------------------- 4


def _word_ids(text, end):
    enc = wordbpe.encoder(wordbpe.default_vocabulary()).full
    return np.array([*enc.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_word_ids_on_any_text():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    enc = wordbpe.TokenEncoder(wordbpe.default_vocabulary())

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'sSlLtTaAéÉ.,!<|>0ßΣσİ́‍"), st.characters(codec="utf-8")), max_size=40), max_size=4))
    def check(texts):
        ids, counts = enc.encode(pa.array(texts, pa.string()))
        want = [e.ids for e in enc.full.encode_batch(texts, add_special_tokens=False)]
        assert ids.tolist() == [i for e in want for i in e] and counts.tolist() == [len(e) for e in want]

    check()


def test_word_ids_of_marks_after_letters():
    enc = wordbpe.TokenEncoder(wordbpe.default_vocabulary())
    bases = ["a", "Ab", "DON'T", "don't", "é", "É", "e\u0301", "İ", "\u0958", "\ufb1f", "Σ", "aΣ", "中", "12", "a1", "'s", "<b", "x<|endoftext|>", "_", ""]
    tails = ["", ".", ",", "'", "...", "!?", "<", "|>", "." * 8, "." * 9, "-" * 5000, ".a", ".A", ",1", "\t.", "\u0301."]
    texts = [b + t for b in bases for t in tails]
    texts += [" ".join(texts), "\n".join(reversed(texts)), None, ""]
    ids, counts = enc.encode(pa.array(texts, pa.string()))
    want = [e.ids for e in enc.full.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert counts.tolist() == [len(e) for e in want]
    assert ids.tolist() == [i for e in want for i in e]


def test_token_files(spark, docs, empty):
    rows = huffman.round_trip(docs, wordbpe.default_vocabulary(), 1, with_ids=True).collect()
    order = sorted(rows, key=lambda r: r.start)
    assert [r.doc_id for r in order] == sorted((i for i, _ in TEXTS), key=lambda i: (i is not None, i or 0))
    start, seen = 0, Counter()
    for r in order:
        ids = np.frombuffer(r.ids, "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(r.ids))
        start += len(ids)
        seen[(r.doc_id, r.ids_crc32)] += 1
    assert seen == Counter((i, zlib.crc32(_word_ids(t, 1).tobytes())) for i, t in TEXTS)
    assert huffman.round_trip(empty, wordbpe.default_vocabulary(), 1).collect() == []


def test_token_files_of_many_parts(spark, docs):
    """Small files and blocks, a third of the rows alike without an id; files go by the number of their part."""
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(None, BASE)] * 40 + [(i, _prose(i, 50)) for i in range(40, 80)], "doc_id long, text string"))
    end, path = 1, wordbpe.default_vocabulary()
    out = common.scratch_path(spark, "files")
    got = huffman.round_trip(more, path, end, out, with_ids=True, file_ids=2_000, block_tokens=300).collect()
    assert _bag((r.doc_id, repr(np.frombuffer(bytes(r.ids), "<u4").tolist())) for r in got) == _bag((r.doc_id, repr(_word_ids(r.text, end).tolist())) for r in more.collect())
    order = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in order] == sorted((r.doc_id for r in got), key=lambda i: (i is not None, i))
    assert [r.start for r in order] == [0, *np.cumsum([r.n_tokens for r in order])[:-1].tolist()]
    files = [r.size for r in spark.read.format("binaryFile").load(out).selectExpr("length(content) as size").collect()]
    assert len(files) > 20
    assert sorted(["part-100000-x", "part-99999-x", "part-00002"], key=huffman.part_number) == ["part-00002", "part-99999-x", "part-100000-x"]


def test_huffman_codes():
    import heapq

    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 50, 700):
        counts = (rng.pareto(0.5, n) * 5).astype(np.int64) + 1
        lengths = huffman.code_lengths(counts, 30)
        heap, total = list(counts.tolist()), 0
        heapq.heapify(heap)
        while len(heap) > 1:
            a = heapq.heappop(heap) + heapq.heappop(heap)
            total += a
            heapq.heappush(heap, a)
        assert (counts * lengths).sum() == (total if n > 1 else counts[0])
        short = huffman.code_lengths(counts, 10)
        assert short.max() <= 10 and (0.5 ** short.astype(float)).sum() <= 1
        ids = rng.integers(0, n, 3000)
        block = huffman.encode_block(np.array([5, 6]), np.array([1000, 2000]), ids, False, huffman.canonical(short), short)
        more = huffman.encode_block(np.array([6, 7]), np.array([10, 2]), ids[:12], True, huffman.canonical(short), short)
        doc_ids, sizes, back = huffman.decode_file(block + b"\n" + more + b"\n", short)
        assert doc_ids.tolist() == [5, 6, 7] and sizes.tolist() == [1000, 2010, 2] and (back == np.concatenate([ids, ids[:12]])).all()


# ------------------------------------------------------------------------------------------- 5


def test_archives(spark, tmp_path):
    big, same = "<p>" + "é x" * 40_000, "s" * 100
    rows = [(5, "http://a/b c\r\nX: y", same, 1), (3, None, same, 1), (3, "u", same, 1), (9, "u", big, 1), (8, "u", big, 1), (7, "u", "t" * 99, 1), (6, "u", "t" * 99, 1), (1, "u", None, 1), (2, "u", "", 1), (None, "u", same, 1), (None, "u", "lonely" * 50, 1), (4, "u", "a\r\n\r\nWARC/1.1\r\n0\r\n\r\n" * 20, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int").repartition(3)
    warc.write(pages, f"file://{tmp_path}/w", segment=10_000)
    got = warc.read_pages(spark, f"file://{tmp_path}/w").collect()
    want = Counter()
    for i, _, html, _ in rows:
        raw = (html or "").encode()
        ids = [j for j, _, h, _ in rows if (h or "").encode() == raw and j is not None]
        first = min(ids) if ids and len(raw) >= 100 else None
        refers = first if first is not None and first != i else None
        want[(i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if refers is not None else "response", refers)] += 1
    assert _bag((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert all(r.payload.decode() == (dict((i, h) for i, _, h, _ in rows)[r.page_id] or "") for r in got if r.payload is not None and r.page_id is not None)
    _valid_archives(tmp_path / "w", len(rows))
    none = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write(none, f"file://{tmp_path}/none")
    assert warc.read_pages(spark, f"file://{tmp_path}/none").collect() == []


def _valid_archives(folder, pages):
    """A member per record, the headers that every record needs, ids that are unique, and references that lead somewhere."""
    ids, refers, kinds = [], [], Counter()
    for f in folder.glob("part-*"):
        raw = f.read_bytes()
        for member in warc.members(raw):
            (headers, _), = warc.records(member)
            assert {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"} <= headers.keys()
            ids.append(headers["WARC-Record-ID"])
            refers += [headers[k] for k in ("WARC-Refers-To", "WARC-Segment-Origin-ID") if k in headers]
            kinds[headers["WARC-Type"]] += 1
        assert raw == b"".join(gzip.compress(m, 6, mtime=0) for m in warc.members(raw))
    assert len(set(ids)) == len(ids) and set(refers) <= set(ids) and refers and kinds["response"] + kinds["revisit"] == pages


def test_archives_of_one_payload(spark, tmp_path, monkeypatch):
    """Half of all rows have one payload, with ids and without: they are dealt over tasks, and files are rolled."""
    monkeypatch.setattr(warc, "FILE_RECORDS", 50)
    rows = [(None if i % 4 == 1 else i, "u", "hot" * 50 if i % 2 else f"cold {i}" * 30) for i in range(3, 1203)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    warc.write(pages, f"file://{tmp_path}/w")
    got = _bag((r.page_id, r.record_type, r.refers_to) for r in warc.read_pages(spark, f"file://{tmp_path}/w").collect())
    assert got == Counter((i, "revisit" if "hot" in h and i != 3 else "response", 3 if "hot" in h and i != 3 else None) for i, _, h in rows)
    assert len(list((tmp_path / "w").glob("part-*"))) >= 24
    _valid_archives(tmp_path / "w", len(rows))
    left, right = pages.select("html"), pages.groupBy("html").agg(F.count(F.lit(1)).alias("n"))
    dealt = common.spread_join(left, right, "html", "n", 1200)
    assert dealt.count() == 1200 and dealt.where("n = 600").count() == 600


def test_chunks_and_damage():
    assert warc.dechunk(b"3;x=y\r\nabc\r\n2\r\nde\r\n0\r\nTrailer: 1\r\n\r\n") == b"abcde"
    assert warc.dechunk(warc.chunked(b"q" * 20_000)) == b"q" * 20_000
    with pytest.raises(ValueError):
        warc.dechunk(b"2\r\nabc\r\n0\r\n\r\n")


def test_missing_segments_are_found(spark, tmp_path):
    parts = warc.page_records(1, "u", b"z" * 50_000, hashlib.sha256(b"z" * 50_000).hexdigest(), None, "urn:x", 10_000)
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a").write_bytes(b"".join([*parts[:2], *parts[3:]]))
    with pytest.raises(Exception, match="segments of page 1"):
        warc.read_pages(spark, f"file://{tmp_path}/w").collect()


# ------------------------------------------------------------------------------------------- 6


def test_toxicity(spark, sf):
    docs, labels = common.table(spark, "/root/testdata/sf0.01", "documents"), common.table(spark, "/root/testdata/sf0.01", "labels")
    rows = toxicity.score(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").collect()
    held = [(r.score, r.toxic) for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)
    bad, good = [s for s, t in held if t], [s for s, t in held if not t]
    assert np.mean([[a > b for b in good] for a in bad]) > 0.85
    assert np.mean([s >= 0.7 for s in good]) < 0.03 and np.mean([s >= 0.7 for s in bad]) >= 0.7


def test_toxic_documents_are_found(spark):
    """Recall and false alarms at the cut on the held-out fold of 10,000 documents."""
    d = "/root/testdata/sf0.1"
    docs, labels = common.table(spark, d, "documents"), common.table(spark, d, "labels")
    held = toxicity.score(docs.join(labels.select("doc_id"), "doc_id"), toxicity.fit(docs, labels)).where("held_out").join(labels, "doc_id").collect()
    bad, good = [r.predicted for r in held if r.toxic], [r.predicted for r in held if not r.toxic]
    assert len(bad) > 50 and np.mean(bad) >= 0.85 and np.mean(good) < 0.01


def test_terms_are_whole_words():
    """Words of any length are terms as they are: two that differ after 40 bytes are two."""
    a, b = "x" * 60 + "a", "x" * 60 + "b"
    bad, good = toxicity.term_counts(pa.array([a, b]), np.array([True, False]))
    assert bad[a.encode()] == good[b.encode()] == 1 and a.encode() not in good and bad[b"xxxx*"] == 1


def test_toxicity_edges(spark, docs, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.score == 0.0 and r.predicted == 0 for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect())
    some = spark.createDataFrame([(i, 1, i % 2) for i, _ in TEXTS if i] + [(10, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, some)
    assert toxicity.score(docs, model).count() == len(TEXTS) and toxicity.score(empty, model).count() == 0
    assert toxicity.drop_toxic(docs, toxicity.Model({}, None, None, 0.0)).columns == docs.columns


def test_trees_and_calibration():
    rng = np.random.default_rng(0)
    x = rng.random((2000, len(toxicity.FEATURES)))
    y = ((x[:, 1] > 0.5) ^ (x[:, 3] > 0.7)).astype(float)
    model = toxicity.boost(x, y, rounds=40)
    assert ((toxicity.raw_score(model, x) > 0) == (y > 0)).mean() > 0.97
    centre, share = toxicity.isotonic(np.array([1.0, 2, 3, 4, 4, 5]), np.array([0.0, 1, 0, 1, 0, 1]))
    assert (np.diff(centre) > 0).all() and (np.diff(share) >= 0).all() and share[-1] == 1


# ------------------------------------------------------------------------------------------- 7


def _top_by_hand(rows, k):
    sound = [(i, [int(np.floor(1024.0 * x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for i, q in sound:
        if i % 100 == 0:
            near = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in sound if j != i and len(v) == len(q))[:k]
            out |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(near)}
    return out


def test_top_k(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(450)]
    rows += [(i, [0.5] * 6) for i in range(500, 650)]  # very many equal vectors, and ties
    rows += [(700, [1.0, 2.0]), (701, [3.0, 1.0]), (702, None), (703, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (704, [float("nan")] * 6), (705, [float("inf")] * 6), (706, []), (None, [1.0] * 6)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, score int").repartition(3)
    exact = [(i, [None if x is None else float(np.float32(x)) for x in v] if v is not None else None) for i, v in rows]
    for kw in ({}, {"pack": 3, "chunk": 50}):
        assert {tuple(r) for r in covertree.top_k(df, F.col("vec_id") % 100 == 0, 10, **kw).select("query_id", "rank", "vec_id", "score").collect()} == _top_by_hand(exact, 10)
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert covertree.top_k(none, F.col("vec_id") % 100 == 0).collect() == []


def test_top_k_of_repeated_queries_among_equal_vectors(spark):
    """A query's own id may occur often in a large group of equal vectors without taking others' places."""
    for ids in ([100, 100, *range(101, 120)], [100] * 9 + [*range(101, 120)], [100] * 30 + [101] * 30 + [102], [*range(90, 99)] * 2 + [100] * 4 + [*range(101, 120)]):
        rows = [(i, [1.0, 2.0]) for i in ids] + [(i, [0.5, 0.25]) for i in range(201, 215)] + [(200, [0.25, 0.5])]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
        got = _bag(covertree.top_k(df, F.col("vec_id") % 100 == 0).select("query_id", "rank", "vec_id", "score").collect())
        assert got == Counter(_top_by_hand(rows, 10))


def test_trees_leave_out_pairs():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(20, 8)) * 3000
    ints = np.floor(centres[rng.integers(0, 20, 4000)] + rng.normal(size=(4000, 8)) * 20).astype(np.int64)
    q = ints[:64]
    best = covertree.Best(np.arange(64), 5)
    tree, asked = covertree.CoverTree(ints).ready(), covertree.CoverTree(q, covertree.ASKED_LEAF).ready()
    best.own = asked.order
    scored, met = covertree.search(asked, tree, tree.order, np.ones(4000, np.int64), best)
    dots = q @ ints.T
    dots[np.arange(64), np.arange(64)] = np.iinfo(np.int64).min
    assert (best.score == np.sort(dots, 1)[asked.order, ::-1][:, :5]).all()
    assert scored < tree.leaves() * asked.leaves() / 2 and met < dots.size / 2


@pytest.mark.parametrize("spread", [0.0, 0.01, 1.0, 30.0])
def test_cover_trees_halve_their_radii(spread):
    """Whatever the points: clusters, equal ones, or hardly any two near each other."""
    rng = np.random.default_rng(9)
    points = np.floor(100 * (rng.normal(size=(12, 24))[rng.integers(0, 12, 700)] + spread * rng.normal(size=(700, 24)))).astype(np.int64)
    tree = covertree.CoverTree(points, 4).ready()
    assert (np.sort(tree.order) == np.arange(700)).all() and (tree.points == points[tree.order]).all()
    for node in range(len(tree.radius)):
        here = tree.points[tree.lo[node] : tree.hi[node]].astype(float)
        assert np.linalg.norm(here - tree.at[node], axis=1).max() <= tree.radius[node] * (1 + 1e-9)
        kids = np.arange(tree.first[node], tree.first[node] + tree.kids[node])
        assert len(kids) or len(here) <= 4 or tree.radius[node] == 0
        if len(kids):
            assert (tree.radius[kids] <= tree.radius[node] / 2 * (1 + 1e-9)).all()
            assert tree.lo[kids[0]] == tree.lo[node] and tree.hi[kids[-1]] == tree.hi[node] and (tree.lo[kids[1:]] == tree.hi[kids[:-1]]).all()
    again, extra = covertree.CoverTree.unpacked(tree.packed({"ids": tree.order}), 24)
    assert (again.points == tree.points).all() and (again.radius == tree.radius).all() and (extra["ids"] == tree.order).all()


def test_top_k_prunes_clusters_and_goes_in_rounds(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(25, 10))
    vs = centres[rng.integers(0, 25, 3000)] + 0.01 * rng.normal(size=(3000, 10))
    vs /= np.linalg.norm(vs, axis=1, keepdims=True)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for kw in ({"chunk": 150}, {"chunk": 150, "pack": 5, "round_bytes": 1}):
        work = {}
        got = covertree.top_k(df, F.col("vec_id") % 100 == 0, work=work, **kw)
        assert {tuple(r) for r in got.collect()} == _top_by_hand(rows, 10)
        assert 0 < work["pairs"] < work["all_pairs"] / 3


# ------------------------------------------------------------------------------------------- 8


def _stats_by_hand(text):
    s = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", s)
    wins = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    many, cover = Counter(wins), set()
    for i, x in enumerate(wins):
        if many[x] > 1:
            cover |= {i, i + 1, i + 2}
    lines = [x for x in s.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in s), len(lines) - len(set(lines)), len(cover)


def test_statistics(spark, docs, sample, empty):
    again = spark.createDataFrame([(1, "a b c a b c a b"), (2, "a a a a a"), (3, "x y z q x y z"), (4, "a\x0bb\x0cc\rd"), (5, "\n\n a \n a \nb")], "doc_id long, text string")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for df in (docs.select("doc_id", "text"), sample.select("doc_id", "text"), again):
        rows = quality_rules.judge(df, []).collect()
        assert len(rows) == df.count()
        for r in rows:
            want = _stats_by_hand(r.text)
            assert tuple(r[n] for n in names) == want
            assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and r.kept == (not r.base_failed)
    assert quality_rules.judge(empty, []).collect() == []


def test_rules_are_learned(spark, sf, empty):
    rows = [{"a": i / 100, "b": (i * 37 % 100) / 100} for i in range(1000)]
    bad = [r["a"] % 1 >= 0.8 or (r["b"] < 0.1 and r["a"] < 0.3) for r in rows]
    rules = quality_rules.learn([{**r, "a": r["a"] % 1} for r in rows], bad, ("a", "b"))
    hit = [any(all(quality_rules._holds(c, {**r, "a": r["a"] % 1}) for c in rule) for rule in rules) for r in rows]
    assert np.mean([h == b for h, b in zip(hit, bad, strict=True)]) > 0.95
    d = "/root/testdata/sf0.01"
    docs, labels = common.table(spark, d, "documents"), common.table(spark, d, "labels")
    learned = quality_rules.fit(docs, labels)
    got = quality_rules.judge(docs.select("doc_id", "text"), learned).join(labels, "doc_id").where("not base_failed").collect()
    assert np.mean([r.kept for r in got if r.quality == 1]) > 0.97 and np.mean([r.kept for r in got if r.quality == 0]) < 0.3
    plan = quality_rules.judge(docs, learned)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    assert quality_rules.fit(empty, labels) == [] and quality_rules.learn([], []) == []


# ------------------------------------------------------------------------------------------- 9


def _check_packs(rows, texts, end, window):
    ids = defaultdict(list)
    for i, t in texts:
        ids[i].append(_word_ids(t, end))
    by_seq = defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append((r.offset, r.length))
        assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in ids[r.doc_id])
    assert sum(r.length for r in rows) == sum(len(x) for v in ids.values() for x in v)
    for v in by_seq.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at and length > 0
            at += length
        assert at <= window
    assert sorted(by_seq) == list(range(len(by_seq)))
    for i, v in ids.items():
        mine = sorted((r.start, r.length) for r in rows if r.doc_id == i)
        assert mine == sorted((k, min(window, len(x) - k)) for x in v for k in range(0, len(x), window))
    return len(by_seq)


def test_packs(docs, sample, empty):
    path = wordbpe.default_vocabulary()
    _check_packs(packing.pack(docs, path, 2).collect(), TEXTS, 2, 4096)
    texts = [(r.doc_id, r.text) for r in sample.collect()]
    rows = packing.pack(sample, path, 2).collect()
    assert _check_packs(rows, texts, 2, 4096) <= 1.03 * sum(r.length for r in rows) / 4096 + 1
    small = packing.pack(docs, path, 2, window=16, with_ids=True).collect()
    _check_packs(small, TEXTS, 2, 16)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in small)
    assert packing.pack(empty, path, 2).collect() == []


def test_shortest_pack_first():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    @settings(max_examples=200, deadline=None)
    @given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=30))
    def check(histogram):
        packs = packing.shortest_pack_first(histogram, 64)
        placed = Counter()
        for n, parts in packs:
            assert n > 0 and sum(k * m for k, m in parts) <= 64
            for k, m in parts:
                placed[k] += n * m
        assert placed == Counter(histogram)

    check()


# ------------------------------------------------------------------------------------------- 10


def _print_by_hand(text, width=3):
    from xxhash import xxh64_intdigest

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hashes = [xxh64_intdigest(" ".join(w[k : k + width]).encode(), 42) for k in range(max(1, len(w) - width + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components_by_hand(prints, tau=3):
    values = sorted(set(prints))
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(values):
        for b in values[k + 1 :]:
            if (a ^ b).bit_count() <= tau:
                root[find(b)] = find(a)
    return {v: find(v) for v in values}


def test_near_copies(docs, sample, empty):
    for df, rows in ((docs, TEXTS), (sample, [(r.doc_id, r.text) for r in sample.collect()])):
        prints = [(i, _print_by_hand(t)) for i, t in rows]
        root = _components_by_hand([p for _, p in prints])
        least = {}
        for i, p in prints:
            if i is not None:
                least[root[p]] = min(i, least.get(root[p], i))
        got = simhash.near_duplicates(df).select("doc_id", F.hex("fp"), "component_id").collect()
        assert _bag((r[0], int(r[1], 16), r[2]) for r in got) == Counter((i, p, least.get(root[p])) for i, p in prints)
        kept = simhash.keep_one(df, simhash.near_duplicates(df), simhash.SHINGLE)
        assert kept.columns == df.columns and kept.count() == len(set(root.values()))
    assert simhash.near_duplicates(empty).collect() == simhash.similar(empty).collect() == []
    assert simhash.keep_one(empty, simhash.similar(empty), simhash.WORDS).collect() == []


@pytest.mark.parametrize("group", [2, 10**6])
def test_dense_fingerprints_link_as_by_hand(spark, monkeypatch, group):
    """Chains and balls of near fingerprints, also where every value is dealt again."""
    rng = np.random.default_rng(8)
    values = set()
    for _ in range(6):
        v = int(rng.integers(0, 2**63))
        for _ in range(60):
            v ^= 1 << int(rng.integers(0, 64))
            if rng.random() < 0.5:
                v ^= (1 << int(rng.integers(0, 64))) ^ (1 << int(rng.integers(0, 64)))
            values.add(v)
    values = sorted(values)
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    nodes = spark.createDataFrame([(v, i, 0) for i, v in enumerate(signed)], "fp long, least long, more long")
    monkeypatch.setattr(simhash, "GROUP", group)
    monkeypatch.setattr(simhash, "DENSE", 16)
    total, both = simhash.bit_counts(nodes)
    assert total == len(values)
    halves, quarters = simhash.group_bits(total, both, 2), simhash.group_bits(total, both, 4)
    plans = {2: (simhash.plan(total, both), [(p, 1) for p in halves]), 10**6: ([(p, 0) for p in quarters], [(halves[0], 2), (halves[1], 0)])}
    for parts in plans[group]:
        edges = simhash.links(nodes, total, parts)
        roots = {r.fp: r.root for r in simhash.components(edges).collect()}
        want = _components_by_hand(values)
        by_root = defaultdict(set)
        for s, v in zip(signed, values, strict=True):
            by_root[roots.get(s, s)].add(want[v])
        assert all(len(x) == 1 for x in by_root.values()) and len(by_root) == len(set(want.values()))


def _sets_by_hand(rows, width=5):
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[i] = frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()
    return out


def similar_by_hand(rows, least=0.8):
    """The pairs of unlike sets that reach the similarity, and the smallest id of the component of each id."""
    sets = _sets_by_hand(rows)
    where, alike, common = defaultdict(list), defaultdict(list), Counter()
    for i, s in sets.items():
        alike[s].append(i)
    for s, ids in alike.items():
        for x in s:
            where[x].append(min(ids))
    for ids in where.values():
        for k, a in enumerate(ids):
            for b in ids[k + 1 :]:
                common[min(a, b), max(a, b)] += 1
    pairs = [(a, b) for (a, b), n in common.items() if n >= least * (len(sets[a]) + len(sets[b]) - n)]
    root = {i: min(ids) for ids in alike.values() for i in ids}
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return pairs, {i: find(i) for i in sets}


@pytest.mark.parametrize("block", [simhash.BLOCK_TEXTS, 7])
def test_similar_texts(spark, monkeypatch, block):
    """Chains and a dense group of near copies with a third of the rows, next to texts of their own."""
    monkeypatch.setattr(simhash, "FEW_IDS", 0 if block == 7 else simhash.FEW_IDS)
    rng = np.random.default_rng(5)
    vocabulary = np.array([f"w{k}" for k in range(3000)])
    rows, base = [(i, " ".join(rng.choice(vocabulary, rng.integers(1, 300)))) for i in range(120)], rng.choice(vocabulary, 150)
    for i in range(120, 200):
        one = base.copy()
        one[rng.integers(0, 150, 2)] = "other"
        rows.append((i, " ".join(one)))
    chain = rng.choice(vocabulary, 150)
    for i in range(200, 230):
        chain = chain.copy()
        chain[rng.integers(0, 150, 3)] = f"c{i}"
        rows.append((i, " ".join(chain).upper()))
    rows += [(230, ""), (231, None), (232, rows[125][1]), (233, "a b"), (234, "A  b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    pairs, root = similar_by_hand(rows)
    got = {r.doc_id: r.component_id for r in simhash.similar(df, block_texts=block).collect()}
    assert got.keys() == root.keys() and len(pairs) > 300
    for i, c in got.items():  # what is linked is similar, through a chain at most
        assert root[c] == root[i]
    together = np.mean([got[a] == got[b] for a, b in pairs])
    assert together > 0.95, together


def test_similar_trees_are_exact():
    rng = np.random.default_rng(2)
    for _ in range(30):
        pool = rng.integers(0, 60, 40).astype(np.uint64)
        sets = [np.unique(rng.choice(pool, rng.integers(0, 20))) for _ in range(40)]
        a, b = simhash.similar_trees(sets, 0.6)
        trees = simhash.Trees(40)
        trees.join(a, b)
        by_hand = simhash.Trees(40)
        near = [(i, j) for i in range(40) for j in range(i) if (n := len(np.intersect1d(sets[i], sets[j]))) and n / (len(sets[i]) + len(sets[j]) - n) >= 0.6]
        by_hand.join(np.array([i for i, _ in near], np.int64), np.array([j for _, j in near], np.int64))
        every = np.arange(40)
        assert (trees.find(every) == by_hand.find(every)).all()


def _peak(run):
    """Result of a call, and the most bytes that it held at once."""
    tracemalloc.start()
    try:
        return run(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_comparisons_hold_little_at_once():
    """Sets are held about three times over at most, pairs of nodes a small piece at a time."""
    rng = np.random.default_rng(3)
    common_part = rng.integers(0, 1 << 63, 5000).astype(np.uint64)
    sets = [np.unique(np.append(common_part, rng.integers(0, 1 << 63, 100).astype(np.uint64))) for _ in range(400)]
    (child, _), held = _peak(lambda: simhash.similar_trees(sets, 0.8))
    assert len(child) == 399
    assert held < 3.5 * sum(x.nbytes for x in sets), held
    n = 20_000
    keys, fps = rng.integers(0, 10, n).astype(np.uint64), rng.integers(0, 1 << 63, n).astype(np.uint64)
    fps[1::2] = fps[::2] ^ np.uint64(5)
    keys[1::2] = keys[::2]
    (a, b), held = _peak(lambda: simhash._meet(keys, fps, fps.view(np.int64), rng.random(n) < 2, 3, 6))
    assert sorted(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), strict=True)) == sorted(zip(np.minimum(fps[::2], fps[1::2]).tolist(), np.maximum(fps[::2], fps[1::2]).tolist(), strict=True))
    assert held < 32 << 20, held


def test_similarity_on_the_table(spark):
    """All copies alike, and most of those that differ, against brute force over 1,000 documents."""
    rows = [(r.doc_id, r.text) for r in common.table(spark, "/root/testdata/sf0.01", "documents").collect()]
    pairs, root = similar_by_hand(rows)
    got = {r.doc_id: r.component_id for r in simhash.similar(common.table(spark, "/root/testdata/sf0.01", "documents")).collect()}
    sets = _sets_by_hand(rows)
    first = {}
    for i in sorted(sets):
        assert got[first.setdefault(sets[i], i)] == got[i]
        assert root[got[i]] == root[i]
    assert np.mean([got[a] == got[b] for a, b in pairs]) >= 0.85


def test_plan_covers_the_radius():
    both = np.full((64, 64), 250.0)
    np.fill_diagonal(both, 500.0)
    for total in (10, 10**5, 10**8, 10**11):
        parts = simhash.plan(total, both)
        bits = [b for p, _ in parts for b in p]
        assert len(set(bits)) == len(bits)
        assert sum(t + 1 for _, t in parts) == simhash.TAU + 1


def test_caches_are_bounded_by_bytes(monkeypatch):
    """Texts without a blank, and caches that begin anew at every batch, give the same ids."""
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("abcdeé. "), 300)) for _ in range(30)] + ["x" * 3000, "a b c"]
    enc, agenda = wordbpe.TokenEncoder(wordbpe.default_vocabulary()), sentencepieces.Agenda(wordbpe.default_vocabulary("piece_bpe_32k.model"))
    want = [enc.encode(pa.array([t])) for t in texts]
    pieces = [agenda.encode(pa.array([t])) for t in texts]
    monkeypatch.setattr(wordbpe, "CACHE_BYTES", 2000)
    monkeypatch.setattr(sentencepieces, "CACHE_BYTES", 2000)
    for t, (ids, _), (parts, _, _) in zip(texts, want, pieces, strict=True):
        assert enc.encode(pa.array([t]))[0].tolist() == ids.tolist() and agenda.encode(pa.array([t]))[0].tolist() == parts.tolist()
        assert enc.held < 2000 + 200_000
    assert len(enc.known) < 200
