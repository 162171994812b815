"""Where rows go: explicit partitions for hot keys, and what each partition holds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def partition_of(key: str, hot: Sequence, cold: int) -> Column:
    """The partition of a key: ``cold`` (the last one) for hot keys, a hash below it for others and for null."""
    if cold < 1:
        raise ValueError("at least one cold partition is needed")
    spread = F.pmod(F.xxhash64(key), F.lit(cold)).cast("int")
    return F.when(F.coalesce(F.col(key).isin(*hot), F.lit(False)), F.lit(cold)).otherwise(spread) if hot else spread


def deal_hot_keys(df: DataFrame, key: str, hot: Sequence, cold: int | None = None) -> DataFrame:
    """``df`` over cold + 1 partitions by ``partition_of``."""
    cold = cold or max(8, df.sparkSession.sparkContext.defaultParallelism)
    return df.repartitionById(cold + 1, partition_of(key, list(hot), cold))


def partition_sizes(df: DataFrame, n: int) -> DataFrame:
    """part, rows for each of the n partitions; empty ones have 0."""
    counted = df.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("rows"))
    return df.sparkSession.range(n).select(F.col("id").cast("int").alias("part")).join(counted, "part", "left").fillna(0, ["rows"])


def largest_partitions(df: DataFrame, n: int = 5) -> DataFrame:
    return df.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "part").limit(n)


def cluster(df: DataFrame, cols: Sequence[str], n: int | None = None) -> DataFrame:
    """Rows of equal columns together; without n, adaptive execution sizes the partitions and splits large ones."""
    return df.repartition(n, *cols) if n else df.hint("rebalance", *cols)


def compare_partitioners(df: DataFrame, key: str, hot: Sequence, n: int = 8) -> DataFrame:
    """label, rows, largest (rows of the largest partition), mixed (partitions in which a hot key meets another key),
    of dealing by the hash of the key and of giving hot keys a partition of their own."""
    is_hot = F.coalesce(F.col(key).isin(*hot), F.lit(False))
    out = None
    for label, dealt in (("hash", df.repartition(n, key)), ("hot keys apart", deal_hot_keys(df, key, hot, n - 1))):
        parts = dealt.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n"), F.bool_or(is_hot).alias("hot"), F.bool_or(~is_hot).alias("cold"))
        one = parts.agg(F.sum("n").alias("rows"), F.max("n").alias("largest"), F.count_if(F.col("hot") & F.col("cold")).alias("mixed")).select(F.lit(label).alias("label"), "rows", "largest", "mixed")
        out = one if out is None else out.unionByName(one)
    return out


def round_robin(df: DataFrame, n: int) -> DataFrame:
    """Rows over n partitions of nearly equal size, whatever they hold."""
    return df.repartition(n)


def numbered(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Rows with an increasing, not consecutive number. It depends on the layout: a label of a row, never a join key."""
    return df.withColumn(name, F.monotonically_increasing_id())
