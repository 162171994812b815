"""Readers, and the transaction view over the event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The instant up to which features look back; an explicit parameter everywhere, never the clock.
AS_OF = "2024-01-31 00:00:00"
TXN_COLUMNS = ("txn_id", "user_id", "merchant_id", "device_id", "ip", "geo_hash", "amount", "channel", "status", "ts")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scan(spark: SparkSession, path: str, columns: tuple[str, ...] | None = None) -> DataFrame:
    """A Parquet scan, pruned to ``columns``."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events seen as transactions.

    ``hot_user`` puts three tenths of the rows on one key, ``null_user`` has about two per cent nulls, and ``cents``
    is the amount as an integer, whose sums are exact in any order.
    """
    k = F.get_json_object("props", "$.k")
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("txn_id"),
        "user_id",
        (k.cast("int") % 25).cast("long").alias("merchant_id"),
        F.nullif(k, F.lit("0")).alias("device_id"),
        (F.col("event_id") % 37).cast("string").alias("ip"),
        (F.col("event_id") % 11).cast("string").alias("geo_hash"),
        F.col("value").alias("amount"),
        F.col("event_type").alias("channel"),
        F.col("event_type").alias("status"),
        "ts",
        F.to_date("ts").alias("dt"),
        F.round(F.col("value") * 100).cast("long").alias("cents"),
        F.when(F.col("event_id") % 10 < 3, F.lit(0)).otherwise(F.col("user_id")).cast("long").alias("hot_user"),
        F.nullif(F.col("user_id") % 50, F.lit(0)).alias("null_user"),
    )


#: The same view for DuckDB, to be put in front of a query.
TX_SQL = """WITH tx AS (
  SELECT event_id AS txn_id, user_id,
    CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 25 AS BIGINT) AS merchant_id,
    nullif(json_extract_string(props, '$.k'), '0') AS device_id,
    CAST(event_id % 37 AS VARCHAR) AS ip, CAST(event_id % 11 AS VARCHAR) AS geo_hash,
    value AS amount, event_type AS channel, event_type AS status, ts, CAST(ts AS DATE) AS dt,
    CAST(round(value * 100) AS BIGINT) AS cents,
    CASE WHEN event_id % 10 < 3 THEN 0 ELSE user_id END AS hot_user,
    nullif(user_id % 50, 0) AS null_user
  FROM events)"""


def merchants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("merchant_id"), F.col("n_name").alias("merchant_name"), F.col("n_regionkey").cast("long").alias("mcc"))


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("mcc"), F.col("r_name").alias("mcc_desc"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("user_name"), F.col("c_mktsegment").alias("segment"))


def calendar(spark: SparkSession, last: str, days: int, recent: int = 7) -> DataFrame:
    """dt, is_recent: ``days`` days up to ``last``, the latest ``recent`` of them marked."""
    day = F.to_date(F.lit(last))
    return spark.range(1).select(F.explode(F.sequence(F.date_sub(day, days - 1), day)).alias("dt")).withColumn("is_recent", F.col("dt") > F.date_sub(day, recent))


def table_path(spark: SparkSession, name: str) -> str:
    """Where a catalog table lies; a scan of that path loses the table's bucketing."""
    rows = spark.sql(f"DESCRIBE FORMATTED {name}").where("col_name = 'Location'").select("data_type").collect()
    return rows[0][0]
