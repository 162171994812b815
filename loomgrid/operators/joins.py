"""Join strategies and ways around skew. All give the relation of the plain left join; only the plan differs."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import MB, conf, materialise

#: Estimated bytes up to which a side is broadcast; beyond them the join is dealt by key.
BROADCAST_BYTES = 64 * MB
HINTS = ("broadcast", "merge", "shuffle_hash", "auto")


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the size of a relation."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_join(left: DataFrame, right: DataFrame, key: str, most: int = BROADCAST_BYTES) -> DataFrame:
    """Left join with the right side broadcast while its estimated size allows, else by sort and merge."""
    if estimated_bytes(right) > most:
        return sort_merge_join(left, right, key)
    return left.join(F.broadcast(right), key, "left")


def sort_merge_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.hint("merge").join(right, key, "left")


def shuffle_hash_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right.hint("shuffle_hash"), key, "left")


def auto_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right, key, "left")


def safe_join(left: DataFrame, right: DataFrame, key: str, hint: str = "auto") -> DataFrame:
    """Refuses keys of different types, which would be cast row by row; an unknown hint means auto."""
    a, b = left.schema[key].dataType, right.schema[key].dataType
    if a != b:
        raise TypeError(f"join key {key} is {a.simpleString()} on the left and {b.simpleString()} on the right")
    return {"broadcast": broadcast_join, "merge": sort_merge_join, "shuffle_hash": shuffle_hash_join}.get(hint, auto_join)(left, right, key)


def forced_broadcast(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join with the right side broadcast whatever its size: for sides whose bound the caller knows and the
    optimizer does not."""
    return left.join(F.broadcast(right), key, "left")


#: Adaptive execution splits a partition that is so many times the median and has so many bytes.
SKEW = {"spark.sql.adaptive.enabled": True, "spark.sql.adaptive.skewJoin.enabled": True, "spark.sql.adaptive.skewJoin.skewedPartitionFactor": 5, "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": 256 * MB}


def adaptive_skew_join(spark: SparkSession, left: DataFrame, right: DataFrame, key: str, settings: dict | None = None, run=None) -> object:
    """The sort-merge join, computed with adaptive splitting of skewed partitions on, and read back.

    Settings hold only while a query runs, so the join has to run before they are put back: by default its result is
    written to the shared folder. ``run``: another action on the join, whose value is returned.
    """
    with conf(spark, SKEW | (settings or {})):
        return (run or (lambda df: materialise(df, "skew")))(sort_merge_join(left, right, key))


def salted_join(left: DataFrame, right: DataFrame, key: str, spread: Sequence[str], buckets: int = 16) -> DataFrame:
    """Deals each key over ``buckets`` tasks: a salt from the ``spread`` columns left, every salt right.

    The salt is a second join column, so null keys match nothing, as in the plain join; it is a hash, so a task that
    runs again salts alike. Always sorted and merged: the optimizer does not count the copies of the right side, so it
    would broadcast ``buckets`` times what it takes for small.
    """
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(buckets)))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))))
    return salted.hint("merge").join(copies, [key, "_salt"], "left").drop("_salt")


def hot_cold_join(left: DataFrame, right: DataFrame, key: str, hot: Sequence) -> DataFrame:
    """Rows of hot keys meet a broadcast of those keys' dimension rows; the rest, nulls too, is sorted and merged."""
    if any(k is None for k in hot):
        raise ValueError("null is no hot key: it matches nothing")
    if not hot:
        return sort_merge_join(left, right, key)
    is_hot = F.coalesce(F.col(key).isin(*hot), F.lit(False))
    return broadcast_join(left.where(is_hot), right.where(F.col(key).isin(*hot)), key).unionByName(sort_merge_join(left.where(~is_hot), right.where(~is_hot), key))


def top_hot_keys(df: DataFrame, key: str, n: int = 50) -> DataFrame:
    """key, count of the n most frequent keys, nulls left out, ties to the smaller key."""
    return df.where(F.col(key).isNotNull()).groupBy(key).count().orderBy(F.desc("count"), key).limit(n)


def join_without_null_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows with a null key are dropped, on purpose."""
    return auto_join(left.where(F.col(key).isNotNull()), right, key)


def null_safe_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Only rows with a key are shuffled; rows without are added back, so no task gathers them."""
    return auto_join(left.where(F.col(key).isNotNull()), right, key).unionByName(left.where(F.col(key).isNull()), allowMissingColumns=True)


def mixed_type_join(left: DataFrame, right: DataFrame, key: str, text_key: str) -> DataFrame:
    """Joins a number to its text and keeps both columns; the text side is cast for every row."""
    return left.join(right, left[key] == right[text_key], "left")


def aligned_join(left: DataFrame, right: DataFrame, key: str, text_key: str) -> DataFrame:
    """Casts the dimension's key once, before the join; text that is no number matches nothing."""
    return left.join(right.withColumn(key, F.col(text_key).try_cast(left.schema[key].dataType)).drop(text_key) if text_key != key else right.withColumn(key, F.col(key).try_cast(left.schema[key].dataType)), key, "left")


def lookup(df: DataFrame, dim: DataFrame, key: str, value: str, most: int = BROADCAST_BYTES) -> DataFrame:
    """Adds ``value`` by key without multiplying rows: of equal keys the greatest value counts; a miss is null."""
    return broadcast_join(df, dim.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(value).alias(value)), key, most)


def mapped_lookup(df: DataFrame, dim: DataFrame, key: str, value: str, most: int = BROADCAST_BYTES) -> DataFrame:
    """``lookup`` as a vectorised function over a broadcast map, for a dimension of at most ``most`` estimated bytes;
    beyond that, the join."""
    one = dim.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(value).alias(value))
    if estimated_bytes(dim) > most:
        return lookup(df, dim, key, value, most)
    table = one.toPandas()
    shared = df.sparkSession.sparkContext.broadcast(dict(zip(table[key], table[value], strict=True)))

    @F.pandas_udf(one.schema[value].dataType)
    def find(keys: pd.Series) -> pd.Series:
        return keys.map(shared.value.get)

    return df.withColumn(value, F.when(F.col(key).isNotNull(), find(key)))


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int = 32, path: str | None = None) -> None:
    writer = df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
    (writer.option("path", path) if path else writer).saveAsTable(name)


def bucketed_join(spark: SparkSession, left: str, right: str, key: str) -> DataFrame:
    """Inner join of two tables bucketed alike: neither is shuffled, nor broadcast, which would make nothing of the
    buckets."""
    return spark.table(left).hint("merge").join(spark.table(right), key)


def path_join(spark: SparkSession, left: str, right: str, key: str) -> DataFrame:
    """The same join over the tables' files, where the buckets are not known and both sides are shuffled."""
    from ..sources.tables import table_path

    return spark.read.parquet(table_path(spark, left)).join(spark.read.parquet(table_path(spark, right)), key)


def calendar_join(facts: DataFrame, days: DataFrame, since: str) -> DataFrame:
    """Facts of the calendar days from ``since`` on.

    The comparison, unlike a bare boolean column, makes the calendar selective to the optimizer, so partitions of
    ``facts`` by dt are pruned while it runs.
    """
    return facts.join(F.broadcast(days.where(F.col("dt") >= F.lit(since).cast("date"))), "dt")


def pruned_days(spark: SparkSession, path: str, days: DataFrame, since: str, prune: bool = True) -> DataFrame:
    """``calendar_join`` over a fact table written by dt; without ``prune`` it reads every directory.

    The setting holds while the join runs, so the result without pruning is written to the shared folder.
    """
    joined = calendar_join(spark.read.parquet(path), days, since)
    if prune:
        return joined
    with conf(spark, {"spark.sql.optimizer.dynamicPartitionPruning.enabled": False}):
        return materialise(calendar_join(spark.read.parquet(path), days, since), "unpruned")


def benchmark_joins(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """label, rows, ms of the three strategies, each computed whole."""
    from ..plans.explain import compare

    strategies = {"broadcast": broadcast_join, "merge": sort_merge_join, "shuffle_hash": shuffle_hash_join}
    return compare(left.sparkSession, {name: lambda join=join: join(left, right, key) for name, join in strategies.items()})
