"""The pipeline's stages, each against its operator's brute force, and whole-pipeline properties."""

import corpus_pipeline
import pytest
from loomgrid.llm import common, queries, quality_rules, toxicity


@pytest.fixture(scope="module")
def stages(spark):
    d = "/root/testdata/sf0.001"
    docs, out = common.table(spark, d, "documents"), {"input": common.table(spark, d, "documents")}
    for name, stage in corpus_pipeline.STAGES:
        path = common.scratch_path(spark, name)
        stage(spark, docs, d).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "simhash_near_dedup", "suffix_array_dedup", "packing"]
    for name in ("toxicity", "quality_rules", "simhash_near_dedup", "suffix_array_dedup"):
        assert stages[name].dtypes == stages["input"].dtypes


def test_rejections_take_effect(spark, stages):
    d = "/root/testdata/sf0.001"
    labels = common.table(spark, d, "labels")
    scores = toxicity.score(stages["input"], toxicity.fit(stages["input"], labels))
    assert {r.doc_id for r in stages["toxicity"].collect()} == {r.doc_id for r in scores.where("predicted = 0").collect()}
    rules = quality_rules.fit(stages["toxicity"], labels)
    kept = quality_rules.judge(stages["toxicity"].select("doc_id", "text"), rules).where("kept")
    assert {r.doc_id for r in stages["quality_rules"].collect()} == {r.doc_id for r in kept.collect()}


def test_near_copies_and_passages(stages):
    from test_llm import similar_by_hand

    rows = [(r.doc_id, r.text) for r in stages["quality_rules"].collect()]
    _, root = similar_by_hand(rows)
    kept = {r.doc_id for r in stages["simhash_near_dedup"].collect()}
    first = set(root.values())
    # nothing goes but copies, and hardly any copy stays (one of these differs in too many bits of its fingerprint)
    assert first <= kept and len(kept - first) <= 1 < len(rows) - len(first)
    seen = {}
    before = {r.doc_id: r.text.encode() for r in stages["simhash_near_dedup"].collect()}
    for i, b in before.items():
        for k in range(len(b) - 49):
            seen[b[k : k + 50]] = min(i, seen.get(b[k : k + 50], i))
    for r in stages["suffix_array_dedup"].collect():
        b = before[r.doc_id]
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if seen[b[k : k + 50]] < r.doc_id:
                gone[k : k + 50] = b"\1" * 50
        assert r.text == bytes(x for x, g in zip(b, gone, strict=True) if not g).decode(errors="ignore") and r.n_chars == len(r.text)


def test_run_and_registry(spark, stages):
    out = queries.queries()["pipeline"](spark, "/root/testdata/sf0.001")
    assert out.count() == stages["packing"].count()
    names = list(queries.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert set(queries.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, duck, sf, name):
    df = queries.queries()[name](spark, sf)
    got = duck.execute(queries.oracle_sql()[name])
    cols = [c[0] for c in got.description]
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == sorted(got.fetchall(), key=repr)


def test_empty_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.collect() == []
