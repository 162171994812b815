"""Sinks, file sizes, compaction, generators, metrics, streaming and the command line."""

import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from loomgrid import cli, config
from loomgrid.plans import catalogue, explain, metrics
from loomgrid.sources import layout, synthetic, tables, writer
from loomgrid.streaming.features import windowed_frequency

AS_OF = tables.AS_OF


def _files(path):
    return [f for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")]


def _files_of(spark, sizes):
    return spark.createDataFrame([(f"f{k}", "d", n) for k, n in enumerate(sizes)], "path string, folder string, length long")


def test_sizes(spark):
    assert writer.partitions_for_bytes(0) == 1 and writer.partitions_for_bytes(192 << 20) == 1 and writer.partitions_for_bytes((192 << 20) + 1) == 2
    assert writer.partitions_for_rows(1000, 1 << 20, 100) == 10
    s = layout.stats_of(_files_of(spark, [1, 2, 3, 40 << 20]))
    assert (s.files, s.small_files, s.p50, s.p95, s.least, s.most, s.small_ratio) == (4, 3, 3, 40 << 20, 1, 40 << 20, 0.75)
    assert layout.stats_of(_files_of(spark, [32 << 20])).small_files == 0 and "files=4" in s.pretty()
    for n in (1, 2, 3, 19, 20, 21, 40, 100):
        s = layout.stats_of(_files_of(spark, range(1, n + 1)))
        assert (s.p50, s.p95) == (min(n // 2, n - 1) + 1, min(n * 95 // 100, n - 1) + 1), n
    assert not layout.needs_compaction(layout.stats_of(_files_of(spark, []))) and not layout.needs_compaction(layout.stats_of(_files_of(spark, [100 << 20])))


def test_target_sizes_of_frames_of_unknown_size(spark, sf, tmp_path):
    """Rows in memory and joins are counted and measured, not guessed."""
    rows = spark.createDataFrame([(i, "x" * 100) for i in range(2000)], "id long, x string")
    assert 150_000 < writer.size_of(rows) < 400_000 and writer.write_with_target_size(rows, f"{tmp_path}/a") == 1
    joined = tables.read(spark, sf, "orders").join(tables.read(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    assert writer.write_with_target_size(joined, f"{tmp_path}/b") == 1 and spark.read.parquet(f"{tmp_path}/b").count() == joined.count()
    assert writer.size_of(spark.createDataFrame([], "a int")) == 0


def test_partitioned_writes(spark, sf, tmp_path, same):
    t = tables.transactions(spark, sf).select("txn_id", "cents", "dt").repartition(4)
    writer.write_fanned_out(t, f"{tmp_path}/fan", ["dt"])
    writer.write_clustered(t, f"{tmp_path}/one", ["dt"])
    writer.write_partitioned(t, f"{tmp_path}/two", ["dt"], files_per_partition=2)
    days = t.select("dt").distinct().count()
    assert len(_files(f"{tmp_path}/one")) == days < len(_files(f"{tmp_path}/fan"))
    assert days <= len(_files(f"{tmp_path}/two")) <= 2 * days
    same(t, spark.read.parquet(f"{tmp_path}/two"))
    with pytest.raises(ValueError):
        writer.repartition_for_write(t, [])
    assert writer.write_with_target_size(t, f"{tmp_path}/flat") == 1


def test_partitions_are_overwritten_alone(spark, tmp_path):
    path = f"{tmp_path}/days"
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "v int, day string")
    writer.write_overwriting_partitions(df, path, ["day"])
    writer.write_overwriting_partitions(spark.createDataFrame([(9, "b")], "v int, day string"), path, ["day"])
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [(1, "a"), (3, "c"), (9, "b")]


def test_compaction(spark, tmp_path, same):
    path = f"{tmp_path}/t"
    rows = spark.range(100).withColumn("p", F.col("id") % 2)
    rows.repartition(20).write.partitionBy("p").parquet(path)
    open(f"{path}/_hidden.parquet", "w").write("x")
    assert layout.analyze(spark, f"{tmp_path}/missing").files == 0 and layout.compact(spark, f"{tmp_path}/missing") is None
    os.remove(f"{path}/_hidden.parquet")
    done = layout.compact(spark, path, ["p"])
    assert done.after.files == 2 < done.before.files
    same(rows, spark.read.parquet(path))


def test_compaction_by_directory(spark, tmp_path, same):
    """Names of directories stay as they are, and a large directory gets several files."""
    path = f"{tmp_path}/t"
    rows = spark.range(60_000).select(F.when(F.col("id") % 10 == 0, "01").otherwise("a b").alias("p"), F.sha2(F.col("id").cast("string"), 256).alias("x"))
    rows.repartition(12).write.partitionBy("p").parquet(path)
    done = layout.compact(spark, path, ["p"], target_mb=1)
    found = sorted(os.listdir(path))
    assert "p=01" in found and done.after.files < done.before.files
    large = next(f for f in found if f.startswith("p=a"))
    assert len(_files(f"{path}/{large}")) >= 2 and len(_files(f"{path}/p=01")) == 1
    spark.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", "false")
    same(rows.select("x", "p"), spark.read.parquet(path))
    spark.conf.unset("spark.sql.sources.partitionColumnTypeInference.enabled")


def test_bucketed_joins_at_once(spark, sf, tmp_path, same):
    """Queries of one session that write their tables at the same time are not in each other's way."""
    os.symlink(sf, tmp_path / "in")
    query = catalogue.queries()["JN19_bucketed_join"]
    with ThreadPoolExecutor(4) as pool:
        found = list(pool.map(lambda _: query(spark, f"{tmp_path}/in"), range(4)))
    want = tables.transactions(spark, sf).select("user_id", "txn_id", "cents").join(tables.users(spark, sf), "user_id")
    for df in found:
        same(want, df)
        assert "SortMergeJoin" in explain.plan_text(df) and "Exchange" not in explain.plan_text(df)


def test_bucketed_write_beside_what_is_left(spark, sf, tmp_path):
    """Files that no catalog entry belongs to are not in the way, and other rows at the same path are written."""
    query, events, known = catalogue.queries()["SNK4_bucketed_write"], tables.read(spark, sf, "events"), {t.name for t in spark.catalog.listTables()}
    count = lambda df: sorted(((r.user_id, r.rows) for r in df.collect()), key=repr)
    want = lambda df: sorted(((r.user_id, r["count"]) for r in df.groupBy("user_id").count().collect()), key=repr)
    events.write.parquet(f"{tmp_path}/in/events.parquet")
    tables.read(spark, sf, "customer").write.parquet(f"{tmp_path}/in/customer.parquet")
    assert count(query(spark, f"{tmp_path}/in")) == want(events)
    for name in {t.name for t in spark.catalog.listTables()} - known:
        at = tables.table_path(spark, name).removeprefix("file:")
        os.rename(at, f"{tmp_path}/{name}")
        spark.sql(f"DROP TABLE {name}")
        os.rename(f"{tmp_path}/{name}", at)
    assert count(query(spark, f"{tmp_path}/in")) == want(events)
    for other in (events.where("event_id < 100").unionByName(events.limit(1).withColumn("user_id", F.lit(None).cast("long"))).cache(), events.where("false")):
        other.write.mode("overwrite").parquet(f"{tmp_path}/in/events.parquet")
        assert count(query(spark, f"{tmp_path}/in")) == want(other)


def test_swap_survives_a_crash(spark, tmp_path):
    path = f"{tmp_path}/t"
    spark.range(3).write.parquet(f"{path}._backup")  # the old table was renamed, then the job died
    assert layout.recover(spark, path) == "restored" and spark.read.parquet(path).count() == 3
    spark.range(5).write.parquet(f"{path}._backup")  # the new table was in place already
    assert layout.recover(spark, path) == "finished" and layout.recover(spark, path) == "nothing"
    with pytest.raises(FileNotFoundError):
        layout.swap(spark, path, f"{path}.none")


def test_generator(spark, tmp_path):
    s = config.Settings(base_path=str(tmp_path), users=1000, merchants=50, devices=100, transactions=20_000)
    paths = synthetic.generate_all(spark, s, AS_OF)
    t = spark.read.parquet(paths["fact_transactions"])
    assert t.count() == 20_000 and spark.read.parquet(paths["dim_mcc"]).count() == 100
    got = t.agg(F.avg((F.col("user_id") < 100).cast("int")), F.avg(F.col("device_id").isNull().cast("int")), F.min("amount"), F.max("amount"), F.count_distinct("dt")).first()
    assert got[0] == pytest.approx(0.30, abs=0.02) and got[1] == pytest.approx(0.02, abs=0.005) and 1 <= got[2] and got[3] < 148.42 and got[4] <= 36
    again = synthetic.fact_transactions(spark, s, AS_OF)
    assert again.agg(F.sum(F.xxhash64("user_id", "amount").cast("decimal(38,0)"))).first() == t.agg(F.sum(F.xxhash64("user_id", "amount").cast("decimal(38,0)"))).first()
    assert layout.compact_all(spark, str(tmp_path))["dim_users"] is not None


def test_stage_metrics(spark, tmp_path):
    import json

    task = lambda stage, ms, shuffled: json.dumps({"Event": "SparkListenerTaskEnd", "Stage ID": stage, "Stage Attempt ID": 0, "Task Metrics": {"Executor Run Time": ms, "Shuffle Read Metrics": {"Remote Bytes Read": 0, "Local Bytes Read": 1 << 20, "Total Records Read": shuffled}, "Input Metrics": {"Records Read": 1}}})
    (tmp_path / "log").write_text("\n".join([task(1, 10, 5), task(1, 30, 5), task(1, 10, 5), '{"Event": "other"}']))
    r = metrics.stage_metrics(spark, str(tmp_path)).first()
    assert (r.stage, r.tasks, r.median_ms, r.max_ms, r.skew, r.shuffle_read_mb, r.records) == (1, 3, 10.0, 30, 3.0, 3.0, 18)


def test_stream_equals_batch(spark, sf, tmp_path):
    events = tables.read(spark, sf, "events")
    want = {tuple(r) for r in windowed_frequency(events).collect()}
    stream = spark.readStream.schema(events.schema).parquet(f"{sf}/events*.parquet")
    q = windowed_frequency(stream).writeStream.outputMode("complete").format("memory").queryName("freq").option("checkpointLocation", str(tmp_path)).start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("freq").collect()} == want


def test_command_line(spark, tmp_path, sf):
    args = ["--base", str(tmp_path), "--transactions", "3000", "--users", "200"]
    assert cli.main(["gen", *args], spark) == 0
    for stage in ("features", "analyze", "compact"):
        assert cli.main([stage, *args], spark) == 0
    for case in cli.CASES:
        assert cli.main(["case", "--case", case, *args], spark) == 0
    for demo in cli.DEMOS:
        assert cli.main(["advanced", "--demo", demo, *args], spark) == 0
    with pytest.raises(SystemExit):
        cli.main(["nothing"], spark)
