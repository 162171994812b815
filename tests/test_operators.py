"""Pairs of variants, edges and plans of the engine's own operators."""

import math

import pytest
from pyspark.sql import functions as F

from loomgrid import config, session
from loomgrid.operators import aggregates, batch, features, joins, partitioning, predicates
from loomgrid.plans import explain
from loomgrid.plans.cache import CacheManager, cached
from loomgrid.sources import tables

AS_OF = tables.AS_OF


@pytest.fixture(scope="module")
def pair(spark):
    left = spark.createDataFrame([(k, i) for i, k in enumerate([1, 1, 1, 2, 3, None, None, 5])], "k long, id long")
    right = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "n"), (9, "z")], "k long, v string")
    return left, right


@pytest.mark.parametrize("variant", [
    lambda s, a, b: joins.broadcast_join(a, b, "k"), lambda s, a, b: joins.broadcast_join(a, b, "k", most=0), lambda s, a, b: joins.sort_merge_join(a, b, "k"), lambda s, a, b: joins.shuffle_hash_join(a, b, "k"),
    lambda s, a, b: joins.safe_join(a, b, "k", "broadcast"), lambda s, a, b: joins.salted_join(a, b, "k", ["id"], 5), lambda s, a, b: joins.hot_cold_join(a, b, "k", [1]), lambda s, a, b: joins.hot_cold_join(a, b, "k", []), lambda s, a, b: joins.null_safe_join(a, b, "k"),
])
def test_left_joins_agree(spark, pair, same, variant):
    left, right = pair
    same(joins.auto_join(left, right, "k"), variant(spark, left, right))


def test_join_edges(spark, pair):
    left, right = pair
    with pytest.raises(TypeError):
        joins.safe_join(left, right.withColumn("k", F.col("k").cast("string")), "k")
    with pytest.raises(ValueError):
        joins.hot_cold_join(left, right, "k", [None, 1])
    assert [tuple(r) for r in joins.top_hot_keys(left, "k", 2).collect()] == [(1, 3), (2, 1)]
    assert joins.lookup(left, right, "k", "v").count() == left.count()
    assert joins.join_without_null_keys(left, right, "k").count() == 9
    assert {(r.label, r.rows) for r in joins.benchmark_joins(left, right, "k").collect()} == {(x, 11) for x in ("broadcast", "merge", "shuffle_hash")}
    text = right.select(F.col("k").cast("string").alias("t"), "v").union(spark.createDataFrame([("x", "y")], "t string, v string"))
    assert joins.aligned_join(left, text, "k", "t").count() == joins.auto_join(left, right, "k").count()


def test_join_plans(pair):
    left, right = pair
    small = right.sparkSession.range(3).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    assert "BroadcastHashJoin" in explain.plan_text(joins.broadcast_join(left, small, "k"))
    assert "SortMergeJoin" in explain.plan_text(joins.broadcast_join(left, right, "k"))  # of unknown size
    assert "SortMergeJoin" in explain.plan_text(joins.sort_merge_join(left, right, "k"))
    assert "ShuffledHashJoin" in explain.plan_text(joins.shuffle_hash_join(left, right, "k"))


def test_salted_copies_are_not_broadcast(spark, same):
    """The copies are many times the optimizer's estimate, with adaptive execution and without."""
    left = spark.range(1000).select((F.col("id") % 40).alias("k"), "id")
    right = spark.range(30).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    for adaptive in (True, False):
        with session.conf(spark, {"spark.sql.autoBroadcastJoinThreshold": 64 * session.MB, "spark.sql.adaptive.enabled": adaptive}):
            joined = joins.salted_join(left, right, "k", ["id"], 16)
            same(joins.auto_join(left, right, "k"), joined)
            assert "SortMergeJoin" in explain.plan_text(joined) and "BroadcastHashJoin" not in explain.plan_text(joined)


def test_bucketed_join_has_no_exchange(spark, sf):
    with session.conf(spark, {"spark.sql.autoBroadcastJoinThreshold": -1, "spark.sql.adaptive.enabled": False}):
        joins.write_bucketed(tables.transactions(spark, sf).select("user_id", "cents"), "b_left", "user_id", 4)
        joins.write_bucketed(tables.users(spark, sf), "b_right", "user_id", 4)
        assert "Exchange" not in explain.plan_text(joins.bucketed_join(spark, "b_left", "b_right", "user_id"))
        assert "Exchange" in explain.plan_text(joins.path_join(spark, "b_left", "b_right", "user_id"))


def test_partitions_are_pruned_while_running(spark, sf, tmp_path):
    path = f"file://{tmp_path}/facts"
    tables.transactions(spark, sf).select("dt", "cents").write.partitionBy("dt").parquet(path)
    df = joins.calendar_join(spark.read.parquet(path), tables.calendar(spark, "2024-01-31", 35), "2024-01-25")
    assert "dynamicpruning" in explain.plan_text(df, "extended").lower()


def test_stages_agree(spark, sf, same):
    t = tables.transactions(spark, sf)
    same(aggregates.totals(t, "null_user", "cents"), aggregates.totals_in_stages(t, "null_user", "cents", ["txn_id"]))
    same(aggregates.top_rows(t, "hot_user", "cents", "txn_id"), aggregates.top_rows_in_stages(t, "hot_user", "cents", "txn_id"))
    same(predicates.wide_projection(t, "cents", 30), predicates.wide_projection_in_steps(t, "cents", 30, 7))


def test_predicates(spark):
    xs = [-2.5, -1.0, -0.5, 0.0, 0.5, 1.0, 4.9, 5.0, 5.7, 6.0]
    df = spark.createDataFrame([(x,) for x in [*xs, float("nan"), None]], "x double")
    for n in range(-3, 7):
        got = sorted(r.x for r in df.where(predicates.truncated_gt("x", n)).collect())
        assert got == [x for x in xs if math.trunc(x) > n]


def test_pushdown(spark, sf):
    events = tables.read(spark, sf, "events")
    assert "GreaterThan(value" in explain.plan_text(events.where(F.col("value") > 400))
    assert "GreaterThan(value" not in explain.plan_text(events.where(predicates.opaque_gt("value", 400.0)))
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint>" in explain.plan_text(tables.scan(spark, f"{sf}/events.parquet", ("event_id", "user_id")))


def _hand_made(spark):
    rows = [
        (1, 1, "2024-01-31 00:00:00", 10.0, "d1", "purchase"), (2, 1, "2024-01-30 00:00:00", 20.0, None, "error"), (3, 1, "2024-01-29 23:59:59.999999", 30.0, "d2", "view"),
        (4, 1, "2024-01-31 00:00:00.000001", 40.0, "d3", "view"), (5, 2, "2023-01-01 00:00:00", 50.0, "d4", "view"), (6, 3, "2024-01-30 12:00:00", 60.0, None, "view"),
    ]
    df = spark.createDataFrame(rows, "txn_id long, user_id long, t string, amount double, device_id string, status string")
    return df.select("txn_id", "user_id", F.col("t").cast("timestamp_ntz").alias("ts"), "amount", F.round(F.col("amount") * 100).cast("long").alias("cents"), "device_id", "status", F.lit("c").alias("channel"), F.lit("g").alias("geo_hash"), F.lit("i").alias("ip"), F.lit(1).alias("merchant_id"))


def test_feature_windows(spark):
    wide = {r.user_id: r for r in features.feature_pipeline(_hand_made(spark), AS_OF).collect()}
    assert (wide[1].txn_cnt_1d, wide[1].txn_cnt_7d, wide[1].txn_succ_cnt_1d, wide[1].txn_fail_cnt_1d) == (2, 3, 1, 1)
    assert (wide[1].amt_sum_1d, wide[1].amt_max_7d) == (30.0, 30.0) and wide[1].amt_std_1d == pytest.approx(math.sqrt(50))
    assert (wide[1].first_device_30d, wide[1].last_device_30d, wide[1].distinct_devices_7d) == ("d2", "d1", 2)
    assert wide[2].txn_cnt_30d == 0 and wide[2].amt_sum_30d is None and wide[2].distinct_devices_30d == 0 and wide[2].first_device_30d is None
    assert wide[3].txn_cnt_1d == 1 and wide[3].amt_std_1d is None and wide[3].distinct_devices_1d is None
    assert len(features.feature_pipeline(_hand_made(spark), AS_OF).columns) == 1 + 3 * 17 + 2 + 1


def test_approximate_features_are_near(spark, sf):
    t = tables.transactions(spark, sf)
    exact = {r.user_id: r for r in features.frequency_features(t, AS_OF).collect()}
    for r in features.frequency_features(t, AS_OF, approximate=True).collect():
        assert abs(r.distinct_ips_30d - exact[r.user_id].distinct_ips_30d) <= 0.1 * exact[r.user_id].distinct_ips_30d + 1
    plain = {r.user_id: r for r in features.amount_features(t, AS_OF).collect()}
    for r in features.amount_features_exact(t, AS_OF).collect():
        assert r.amt_sum_30d == pytest.approx(plain[r.user_id].amt_sum_30d)
        assert r.amt_std_30d == pytest.approx(plain[r.user_id].amt_std_30d, rel=1e-6)


def test_hot_keys_have_their_own_partition(spark):
    df = spark.createDataFrame([(k,) for k in [7, 7, 7, None, 1, 2, -(2**63)]], "k long")
    rows = partitioning.deal_hot_keys(df, "k", [7], 4).withColumn("p", F.spark_partition_id()).collect()
    assert all((r.p == 4) == (r.k == 7) and 0 <= r.p <= 4 for r in rows)
    assert sum(r.rows for r in partitioning.partition_sizes(partitioning.deal_hot_keys(df, "k", [7], 4), 5).collect()) == 7
    with pytest.raises(ValueError):
        partitioning.partition_of("k", [7], 0)


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257])
def test_batches_agree(spark, same, n):
    df = spark.range(n, numPartitions=1)
    same(batch.score_rows(df, "id"), batch.score_batches(df, "id"))


def test_counters(spark):
    df = spark.range(100)
    assert batch.count_naively(df) == batch.count_once(df) == 100
    assert batch.observed_count(df, lambda x: x.write.format("noop").mode("overwrite").save()) == 100


def test_settings_come_back(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with pytest.raises(RuntimeError), session.conf(spark, {"spark.sql.shuffle.partitions": 3, "loomgrid.none": 1}):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
        raise RuntimeError
    assert spark.conf.get("spark.sql.shuffle.partitions") == before and spark.conf.get("loomgrid.none", None) is None
    session.apply_preset(spark, "laptop")
    assert spark.conf.get("spark.sql.shuffle.partitions") == "16" and session.dump_confs(spark).count() > 5
    session.apply_preset(spark, "baseline")
    assert spark.conf.get("spark.sql.adaptive.enabled") == "false"
    spark.conf.unset("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_config(monkeypatch):
    monkeypatch.setenv("LOOMGRID_USERS", "7")
    assert config.load().users == 7 and config.load(users=9).users == 9
    with pytest.raises(ValueError):
        config.load(nothing=1)
    with pytest.raises(ValueError):
        config.load(hot_share=2.0)


def test_cache_and_plans(spark, tmp_path):
    manager = CacheManager(spark)
    df = manager.persist(spark.range(10), "ten", "small")
    assert df.is_cached and manager.report().count() >= 1
    with pytest.raises(ValueError):
        manager.persist(df, "ten")
    manager.unpersist_all()
    with cached(spark.range(5)) as held:
        assert held.is_cached
    assert manager.truncate_lineage(spark.range(3)).count() == 3
    path = explain.dump_plan(spark.range(3), f"file://{tmp_path}", "three").removeprefix("file://")
    assert "Range" in open(path).read()
    assert [r.rows for r in explain.compare(spark, {"a": lambda: spark.range(4)}).collect()] == [4]


def test_joins_meet_whole_tables(spark, sf):
    """All events, with a hot key and null keys, and all customers."""
    from loomgrid.plans import catalogue

    assert catalogue._dim(spark, sf).count() == spark.read.parquet(f"{sf}/customer.parquet").count()
    keys = catalogue._fact(spark, sf).groupBy("null_user").count().collect()
    assert sum(r["count"] for r in keys) == spark.read.parquet(f"{sf}/events.parquet").count()
    assert None in {r.null_user for r in keys} and max(r["count"] for r in keys) > 0.25 * sum(r["count"] for r in keys)


def test_skew_join_splits_a_partition(spark):
    """With skew joins off in the session, on while the operator runs, and off again after it."""
    left = spark.range(60_000).select(F.when(F.col("id") % 10 < 8, F.lit(1)).otherwise(F.col("id")).alias("k"), F.concat(F.lit("x" * 50), F.xxhash64("id").cast("string")).alias("x")).repartition(16)
    right = spark.range(60_000).select(F.col("id").alias("k"), F.xxhash64("id").alias("v"))
    small = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": 20_000, "spark.sql.adaptive.advisoryPartitionSizeInBytes": 20_000}

    def run(df):
        df.write.format("noop").mode("overwrite").save()
        df.collect()
        return df.count(), df._jdf.queryExecution().executedPlan().toString()

    with session.conf(spark, {"spark.sql.adaptive.skewJoin.enabled": False, "spark.sql.autoBroadcastJoinThreshold": -1, "spark.sql.shuffle.partitions": 8}):
        n, plan = joins.adaptive_skew_join(spark, left, right, "k", small, run)
        assert n == 60_000 and "skew=true" in plan
        assert spark.conf.get("spark.sql.adaptive.skewJoin.enabled") == "False"
        assert joins.adaptive_skew_join(spark, left, right, "k", small).count() == n


def test_plans_differ_as_the_operators_say(spark, sf, tmp_path, same):
    left = tables.transactions(spark, sf).select("user_id", "txn_id")
    right = tables.users(spark, sf).select("user_id", "user_name")
    with session.conf(spark, {"spark.sql.autoBroadcastJoinThreshold": -1}):
        assert "BroadcastHashJoin" in explain.plan_text(joins.forced_broadcast(left, right, "user_id"))
        mapped = joins.mapped_lookup(left, right, "user_id", "user_name")
        assert "Join" not in explain.plan_text(mapped) and "ArrowEvalPython" in explain.plan_text(mapped)
        assert "Join" in explain.plan_text(joins.mapped_lookup(left, right, "user_id", "user_name", most=0))
        same(mapped, joins.lookup(left, right, "user_id", "user_name"))
    # a barrier leaves the last step alone in the plan
    t = tables.transactions(spark, sf).select("txn_id", "cents")
    one, steps = (f(t, "cents", 40) for f in (predicates.wide_projection, lambda *x: predicates.wide_projection_in_steps(*x, step=10)))
    with session.conf(spark, {"spark.sql.debug.maxToStringFields": 1000}):
        assert explain.plan_text(one, "simple").count("CASE WHEN") == 40 and explain.plan_text(steps, "simple").count("CASE WHEN") == 10
    same(one, steps)
    # a vectorised predicate, and a row-wise one
    assert "ArrowEvalPython" in explain.plan_text(left.where(predicates.vector_gt("txn_id", 5.0))) and "BatchEvalPython" in explain.plan_text(left.where(predicates.opaque_gt("txn_id", 5.0)))
    path = f"file://{tmp_path}/facts"
    tables.transactions(spark, sf).select("dt", "cents").write.partitionBy("dt").parquet(path)
    days = tables.calendar(spark, "2024-01-31", 35)
    pruned, whole = joins.pruned_days(spark, path, days, "2024-01-25"), joins.pruned_days(spark, path, days, "2024-01-25", prune=False)
    assert "dynamicpruning" in explain.plan_text(pruned, "extended").lower()
    same(pruned, whole)
    assert len(pruned.select("dt").distinct().collect()) < 30


def test_feature_plans(spark, sf):
    """One scan for all counts and amounts and one for first and last devices; no row is copied for each distinct count."""
    t = tables.transactions(spark, sf)
    for df in (features.frequency_features(t, AS_OF), features.amount_features_exact(t, AS_OF), features.device_features(t, AS_OF), features.feature_pipeline(t, AS_OF)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Expand" not in plan and "collect_set" not in plan and "percentile" not in plan
    assert plan.count("FileScan parquet") == 2 and plan.count("Exchange hashpartitioning") <= 5


def test_partitions(spark, sf):
    df = tables.transactions(spark, sf).select("hot_user", "txn_id")
    parts = partitioning.cluster(df, ["hot_user"], 4).withColumn("p", F.spark_partition_id()).groupBy("hot_user").agg(F.count_distinct("p").alias("n"))
    assert parts.where("n > 1").isEmpty()
    assert "Rebalance" in partitioning.cluster(df, ["hot_user"])._jdf.queryExecution().analyzed().toString()
    hot = df.where("hot_user = 0").count()
    top = partitioning.largest_partitions(partitioning.deal_hot_keys(df, "hot_user", [0], 8), 2).collect()
    assert (top[0].part, top[0].rows) == (8, hot) and len(top) == 2
    found = {r.label: r for r in partitioning.compare_partitioners(df, "hot_user", [0], 4).collect()}
    assert found["hash"].mixed == 1 and found["hot keys apart"].mixed == 0 and found["hash"].largest > found["hot keys apart"].largest >= hot
    assert partitioning.numbered(df).select("row_id").distinct().count() == df.count()
    few = spark.range(10).select(F.lit(0).cast("long").alias("k"))
    assert [r.rows for r in partitioning.partition_sizes(partitioning.deal_hot_keys(few, "k", [0], 8), 9).orderBy("part").collect()] == [0] * 8 + [10]


def test_session_parts(spark):
    built = session.build_session("again", preset="recommended", extra={"loomgrid.x": "1"}, catalog="in-memory")
    assert built.conf.get("loomgrid.x") == "1"
    session.apply_preset(spark, "recommended")
    for k in session.RECOMMENDED:
        spark.conf.unset(k)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    with session.set_codegen_limit(spark, 123):
        assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "123"
    assert session.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_approximate_devices_are_near(spark, sf):
    t = tables.transactions(spark, sf)
    exact = {r.user_id: r for r in features.device_features(t, AS_OF).collect()}
    for r in features.device_features(t, AS_OF, approximate=True).collect():
        for c in ("distinct_devices_30d", "distinct_channels_30d", "distinct_geos_7d"):
            assert abs(r[c] - exact[r.user_id][c]) <= 0.1 * exact[r.user_id][c] + 1
        assert r.first_device_30d == exact[r.user_id].first_device_30d


def test_percentiles_of_a_large_group_are_exact(spark):
    """One user with far more distinct amounts than a sketch keeps."""
    from loomgrid.operators import features
    from pyspark.sql import functions as F

    n = 60_001
    cents = F.pmod(F.col("id") * 7919, F.lit(n))
    df = spark.range(n).select(F.lit(1).alias("user_id"), cents.alias("cents"), F.lit("2024-01-30 12:00:00").cast("timestamp_ntz").alias("ts")).repartition(7)
    got = features.amount_features_exact(df, "2024-01-31 00:00:00").first()
    for k in (50, 95, 99):
        assert got[f"amt_p{k}_1d"] == (-(-n * k // 100) - 1) / 100
