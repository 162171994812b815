"""Per-stage metrics as a query over Spark's event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = """Event string, `Stage ID` int, `Stage Attempt ID` int,
  `Task Metrics` struct<`Executor Run Time`: long, `Shuffle Read Metrics`: struct<`Remote Bytes Read`: long, `Local Bytes Read`: long, `Total Records Read`: long>, `Input Metrics`: struct<`Records Read`: long>>"""


def stage_metrics(spark: SparkSession, event_log: str) -> DataFrame:
    """stage, attempt, tasks, median_ms, max_ms, skew (0 if the median is 0), shuffle_read_mb, records.

    Attempts are rows of their own, so a retried stage stays visible. Records: input and shuffled ones.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(event_log).where(F.col("value").contains('"SparkListenerTaskEnd"'))
    e = lines.select(F.from_json("value", SCHEMA).alias("e")).select("e.*").where("Event = 'SparkListenerTaskEnd'")
    m = F.col("`Task Metrics`")
    zero = lambda c: F.coalesce(c, F.lit(0))
    tasks = e.select(
        F.col("`Stage ID`").alias("stage"), F.col("`Stage Attempt ID`").alias("attempt"), zero(m["Executor Run Time"]).alias("ms"),
        (zero(m["Shuffle Read Metrics"]["Remote Bytes Read"]) + zero(m["Shuffle Read Metrics"]["Local Bytes Read"])).alias("bytes"),
        (zero(m["Input Metrics"]["Records Read"]) + zero(m["Shuffle Read Metrics"]["Total Records Read"])).alias("records"),
    )
    out = tasks.groupBy("stage", "attempt").agg(F.count(F.lit(1)).alias("tasks"), F.percentile("ms", 0.5).alias("median_ms"), F.max("ms").alias("max_ms"), (F.sum("bytes") / (1 << 20)).alias("shuffle_read_mb"), F.sum("records").alias("records"))
    return out.withColumn("skew", F.when(F.col("median_ms") > 0, F.col("max_ms") / F.col("median_ms")).otherwise(F.lit(0.0)))
