"""Aggregations, plain and in stages, and top rows per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def totals(df: DataFrame, key: str, value: str) -> DataFrame:
    """key, n, total; null keys are a group. Spark pre-aggregates before it shuffles, so a hot key is one row per task."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def totals_in_stages(df: DataFrame, key: str, value: str, spread: Sequence[str], salt: int = 16) -> DataFrame:
    """The same in two shuffles: by key and salt, then by key. For aggregates without a partial form."""
    first = df.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salt))).groupBy(key, "_salt").agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return first.groupBy(key).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def first_last_rows(df: DataFrame, key: str, ts: str, tie: str, columns: Sequence[str]) -> DataFrame:
    """first_<column> and last_<column> by time, ties by ``tie``, without a window."""
    at = F.struct(ts, tie)
    both = df.groupBy(key).agg(F.min_by(F.struct(*columns), at).alias("f"), F.max_by(F.struct(*columns), at).alias("l"))
    return both.select(key, *(F.col(f"f.{c}").alias(f"first_{c}") for c in columns), *(F.col(f"l.{c}").alias(f"last_{c}") for c in columns))


def top_rows(df: DataFrame, key: str, value: str, tie: str, k: int = 5) -> DataFrame:
    """The k rows of the greatest value per key, with their rank ``rn``; the optimizer limits groups before the shuffle."""
    w = Window.partitionBy(key).orderBy(F.desc(value), tie)
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)


def top_rows_in_stages(df: DataFrame, key: str, value: str, tie: str, k: int = 5, salt: int = 16) -> DataFrame:
    """The same through the k best of each salt."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(tie), F.lit(salt)))
    w = Window.partitionBy(key, "_salt").orderBy(F.desc(value), tie)
    best = salted.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).drop("rn", "_salt")
    return top_rows(best, key, value, tie, k)


def first_by_window(df: DataFrame, key: str, value: str, ts: str, tie: str) -> DataFrame:
    """Every row with the first value of its key so far, in time order."""
    return df.withColumn(f"first_{value}", F.first(value).over(Window.partitionBy(key).orderBy(ts, tie)))


def last_by_window(df: DataFrame, key: str, value: str, ts: str, tie: str) -> DataFrame:
    """Every row with the last value of its whole key."""
    w = Window.partitionBy(key).orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumn(f"last_{value}", F.last(value).over(w))
