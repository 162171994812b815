"""Parquet sinks that size their files, and the arithmetic behind them."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MB = 1 << 20
TARGET_MB = 192
MAX_RECORDS = 5_000_000
#: Estimates from which on bytes are counted, rows that are measured, bytes of a row if there are none, tasks at most.
MOST_BYTES, SAMPLE, ROW_BYTES, MOST_FILES = 1 << 50, 1_000, 256, 1_000_000


def partitions_for_bytes(total: int, target_mb: int = TARGET_MB) -> int:
    return max(1, math.ceil(total / (target_mb * MB)))


def partitions_for_rows(rows: int, bytes_per_row: int, target_mb: int = TARGET_MB) -> int:
    return partitions_for_bytes(rows * bytes_per_row, target_mb)


def repartition_for_write(df: DataFrame, cols: Sequence[str], files_per_partition: int = 1) -> DataFrame:
    """Rows of a partition directory together, in at most ``files_per_partition`` tasks."""
    if not cols:
        raise ValueError("partition columns are needed")
    if files_per_partition < 1:
        raise ValueError("files_per_partition must be positive")
    if files_per_partition == 1:
        return df.repartition(*cols)
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(files_per_partition))
    return df.repartition(*cols, salt)


def write_parquet(df: DataFrame, path: str, compression: str = "snappy") -> None:
    df.write.mode("overwrite").option("compression", compression).parquet(path)


def write_fanned_out(df: DataFrame, path: str, cols: Sequence[str]) -> None:
    """No clustering before a partitioned write: up to tasks x directories files. Kept to compare."""
    df.write.mode("overwrite").partitionBy(*cols).parquet(path)


def write_clustered(df: DataFrame, path: str, cols: Sequence[str], max_records: int = MAX_RECORDS) -> None:
    """Clustered by directory; adaptive execution splits large directories and joins small ones."""
    df.hint("rebalance", *cols).write.mode("overwrite").option("maxRecordsPerFile", max_records).partitionBy(*cols).parquet(path)


def write_overwriting_partitions(df: DataFrame, path: str, cols: Sequence[str]) -> None:
    """Replaces the directories that ``df`` has rows for and leaves the others; a setting of this write alone."""
    df.hint("rebalance", *cols).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*cols).parquet(path)


def write_partitioned(df: DataFrame, path: str, cols: Sequence[str], target_mb: int = TARGET_MB, max_records: int = MAX_RECORDS, compression: str = "zstd", files_per_partition: int = 1) -> None:
    """Clustered partitioned write with row groups of the target size."""
    rows = repartition_for_write(df, cols, files_per_partition)
    rows.write.mode("overwrite").option("compression", compression).option("parquet.block.size", target_mb * MB).option("maxRecordsPerFile", max_records).partitionBy(*cols).parquet(path)


def size_of(df: DataFrame) -> int:
    """Bytes of a frame: the optimizer's estimate where it rests on files alone; a join multiplies its sides there, and
    rows in memory are of unknown size, so these are counted and a sample of them measured."""
    from ..operators.joins import estimated_bytes

    plan = df._jdf.queryExecution().optimizedPlan().toString()
    guess = estimated_bytes(df)
    if guess < MOST_BYTES and "Join" not in plan and "LogicalRDD" not in plan and "Generate" not in plan:
        return guess
    width = df.limit(SAMPLE).select(F.length(F.to_json(F.struct("*"))).alias("w")).agg(F.avg("w")).first()[0] if df.columns else None
    return int(df.count() * (width or ROW_BYTES))


def write_with_target_size(df: DataFrame, path: str, target_mb: int = TARGET_MB, compression: str = "zstd") -> int:
    """Unpartitioned write in files of about ``target_mb``; returns how many tasks wrote."""
    n = min(partitions_for_bytes(size_of(df), target_mb), MOST_FILES)
    df.repartition(n).write.mode("overwrite").option("compression", compression).parquet(path)
    return n


def write_features(df: DataFrame, path: str) -> None:
    """The wide feature table by the day it was computed for."""
    write_partitioned(df, path, ["compute_dt"], compression="zstd")
