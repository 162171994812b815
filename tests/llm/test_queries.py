"""The registered queries themselves, over their whole tables, against brute force; very long texts; the pipeline's edges."""

import hashlib
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from loomgrid.llm import common, huffman, packing, pseudolikelihood, queries, sentencepieces, simhash, suffixdedup, wordbpe
from test_llm import TEXTS, _bag, _check_packs, _components_by_hand, _cut_by_hand, _library, _log_probs_by_hand, _print_by_hand, _ranks, _stats_by_hand, _word_ids


@pytest.fixture(scope="module")
def texts(spark, sf):
    return [(r.doc_id, r.text) for r in common.table(spark, sf, "documents").collect()]


def _run(spark, sf, name):
    return queries.queries()[name](spark, sf)


def test_op1(spark, sf, texts):
    df = _run(spark, sf, "op1_pseudo_likelihood")
    assert df.columns == ["doc_id", "n_words", "n_tokens", "log_likelihood", "mean_log_likelihood"]
    rank, net = pseudolikelihood.train(*pseudolikelihood.prepared(common.table(spark, sf, "documents")))
    got = {r.doc_id: r for r in df.collect()}
    assert len(got) == len(texts)
    for i, t in texts:
        if len(t or "") < 1500:
            want = _log_probs_by_hand(net, _ranks(t, rank))
            assert got[i].n_tokens == len(want) and got[i].log_likelihood == pytest.approx(want.sum(), rel=1e-4, abs=1e-3)


def test_op2(spark, sf, texts):
    df = _run(spark, sf, "op2_suffix_dedup")
    assert df.dtypes == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_removed", "bigint"), ("n_spans", "bigint"), ("kept_sha256", "string")]
    assert _bag(df.collect()) == _cut_by_hand(texts)


@pytest.mark.parametrize("table_", ["sf", "/root/testdata/sf0.01"])
def test_op3(spark, sf, table_):
    d = sf if table_ == "sf" else table_
    lib, want = _library(), Counter()
    for r in common.table(spark, d, "documents").collect():
        ids = lib.encode(r.text or "", add_eos=True)
        want[(r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest())] += 1
    df = _run(spark, d, "op3_sentencepiece")
    assert df.columns[:4] == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and _bag(df.select(*df.columns[:4]).collect()) == want


@pytest.mark.parametrize("table_", ["sf", "/root/testdata/sf0.01"])
def test_op4(spark, sf, table_):
    d = sf if table_ == "sf" else table_
    start, want = 0, Counter()
    for r in sorted(common.table(spark, d, "documents").collect(), key=lambda r: r.doc_id):
        ids = _word_ids(r.text, 1)
        want[(r.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))] += 1
        start += len(ids)
    assert _bag(_run(spark, d, "op4_huffman").select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == want


def test_op6(spark, sf, texts):
    df = _run(spark, sf, "op6_toxicity")
    assert df.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    rows = df.collect()
    assert sorted(r.doc_id for r in rows) == sorted(i for i, _ in texts)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)


def test_op8(spark, sf, texts):
    df = _run(spark, sf, "op8_quality_rules")
    assert {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"} <= set(df.columns)
    by_id, rows = dict(texts), df.collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = _stats_by_hand(by_id[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.kept and r.base_failed)


def test_op8_on_rows_that_it_was_not_fitted_on(spark):
    from loomgrid.llm import quality_rules

    d = "/root/testdata/sf0.1"
    docs, labels = common.table(spark, d, "documents"), common.table(spark, d, "labels")
    labels = labels.withColumn("fold", common.crc_fold(labels["doc_id"]))
    rules = quality_rules.fit(docs, labels.where("fold <> 2").drop("fold"))
    held = docs.select("doc_id", "text").join(labels.where("fold = 2"), "doc_id")
    rows = quality_rules.judge(held, rules).where("not base_failed").collect()
    good, bad = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert len(good) > 300 and len(bad) > 20 and np.mean(good) > 0.97 and np.mean(bad) < 0.2


def test_op9(spark, sf, texts):
    df = _run(spark, sf, "op9_packing")
    assert df.columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    rows = df.collect()
    assert _check_packs(rows, texts, 2, 4096) <= 1.03 * sum(r.length for r in rows) / 4096 + 1


def test_op10(spark, sf, texts):
    prints = [(i, _print_by_hand(t)) for i, t in texts]
    root, least = _components_by_hand([p for _, p in prints]), {}
    for i, p in prints:
        least[root[p]] = min(i, least.get(root[p], i))
    df = _run(spark, sf, "op10_simhash")
    assert df.columns == ["doc_id", "fingerprint", "component_id"]
    assert _bag(df.collect()) == Counter((i, f"{p:016x}", least[root[p]]) for i, p in prints)


def test_texts_beyond_slices_and_blocks(spark):
    """Texts of over 4 MB, the bound of a slice and of a block, next to short ones."""
    rng = np.random.default_rng(11)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 19))
    pool = [word() for _ in range(5000)]
    a = " ".join(w + str(k) for k, w in enumerate(rng.choice(pool, 190_000)))
    b = a[1_000_000:3_000_000] + " ".join(word() for _ in range(200))
    rows = [(1, a), (2, b), (3, "short one"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert len(a) > suffixdedup.BLOCK_BYTES
    cut = {r.doc_id: r for r in suffixdedup.dedup(df).collect()}
    assert (cut[1]._n_removed, cut[2]._n_removed, cut[2]._n_spans) == (0, 2_000_000, 1) and cut[2].text == b[2_000_000:] and cut[4].text is None
    by_id = dict(rows)
    lib = _library()
    for r in sentencepieces.encode(df, wordbpe.default_vocabulary("piece_bpe_32k.model")).collect():
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, lib.encode(by_id[r.doc_id] or "", add_eos=True))).encode()).hexdigest()
    ids = {i: _word_ids(t, 1) for i, t in rows}
    assert len(ids[1]) > huffman.BLOCK_TOKENS
    for r in huffman.round_trip(df, wordbpe.default_vocabulary(), 1).collect():
        assert (r.n_tokens, r.ids_crc32) == (len(ids[r.doc_id]), zlib.crc32(ids[r.doc_id].tobytes()))
    _check_packs(packing.pack(df, wordbpe.default_vocabulary(), 2).collect(), rows, 2, 4096)
    assert {r.doc_id: r.fp % 2**64 for r in simhash.fingerprints(df).collect()} == {i: _print_by_hand(t) for i, t in rows}


def test_stages_keep_edges_whole(spark, sf):
    """Null, empty and very long texts, null ids, ties and repeated rows, null columns, and columns whose names the
    operators use themselves: each stage runs on them and keeps the columns."""
    rows = [(i, t, None if k % 3 else "en", None, len(t) if t else None, k, "x", -1.0, b"z", None) for k, (i, t) in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp int, tie string, score double, value binary, part string").repartition(3)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = common.materialise(stage(spark, docs, sf), name)
        kept[name] = out.count()
        if name == "packing":
            assert sum(r.length for r in out.collect()) == sum(len(_word_ids(t, 2)) for _, t in TEXTS)
            continue
        assert out.dtypes == docs.dtypes and kept[name] <= len(TEXTS)
        assert _bag(r for r in out.drop("text", "n_chars").collect()) <= _bag(r for r in docs.drop("text", "n_chars").collect())
    assert kept["toxicity"] == kept["suffix_array_dedup"] == len(TEXTS)
    assert 0 < kept["simhash_near_dedup"] < len(TEXTS)


def test_nothing_else_imports_the_subpackage():
    import pathlib
    import re

    root = pathlib.Path(corpus_pipeline.__file__).parent
    for f in (root / "loomgrid").rglob("*.py"):
        if "llm" not in f.parts:
            assert not re.search(r"\bllm\b|corpus_pipeline", f.read_text()), f
