"""How a table's files are sized, and compaction that a crash cannot lose data in."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import conf
from .writer import MB, partitions_for_bytes


@dataclass(frozen=True)
class FileStats:
    """Sizes of a table's data files; percentiles are sizes that occur."""

    files: int
    total_bytes: int
    small_files: int
    small_bytes: int
    p50: int
    p95: int
    least: int
    most: int

    @property
    def small_ratio(self) -> float:
        return self.small_files / self.files if self.files else 0.0

    @property
    def total_mb(self) -> float:
        return self.total_bytes / MB

    @property
    def avg_mb(self) -> float:
        return self.total_mb / self.files if self.files else 0.0

    def pretty(self) -> str:
        return f"files={self.files} total={self.total_mb:.2f}MB avg={self.avg_mb:.2f}MB small={self.small_files} ({self.small_ratio:.0%}) p50={self.p50} p95={self.p95} min={self.least} max={self.most}"


@dataclass(frozen=True)
class Compaction:
    path: str
    before: FileStats
    after: FileStats


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def goes_at_exit(spark: SparkSession, path: str) -> None:
    """What a lazy result may still read is deleted when the driver's file systems are closed."""
    fs, at = _fs(spark, path)
    fs.deleteOnExit(at)


def listing(spark: SparkSession, path: str) -> DataFrame:
    """path, folder, length of the data files below ``path``; no empty ones, none with a name that Spark takes for
    hidden. Only the files' metadata is read, and long lists are made by tasks, not file by file on the driver."""
    fs, at = _fs(spark, path)
    if not fs.exists(at):
        return spark.createDataFrame([], "path string, folder string, length long")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0")
    path_ = F.col("_metadata.file_path")
    return files.select(path_.alias("path"), F.regexp_replace(path_, "/[^/]*$", "").alias("folder"), "length")


def stats_of(files: DataFrame, small_mb: int = 32) -> FileStats:
    """The sizes of a ``listing`` as one aggregation.

    The percentile p is the least size that more than a share of p of the files do not exceed, which is the greatest
    size that a share of 1 - p or more reach.
    """
    small = F.when(F.col("length") < small_mb * MB, F.col("length"))
    at = lambda p: F.expr(f"percentile_disc({round(1 - p, 4)}) within group (order by length desc)")
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    parts = (F.count("length"), F.sum("length"), F.count(small), F.sum(small), at(0.50), at(0.95), F.min("length"), F.max("length"))
    return FileStats(*files.agg(*(none(c).alias(f"c{k}") for k, c in enumerate(parts))).first())


def analyze(spark: SparkSession, path: str, small_mb: int = 32) -> FileStats:
    return stats_of(listing(spark, path), small_mb)


def needs_compaction(stats: FileStats, small_ratio: float = 0.30, good_avg_mb: float = 64) -> bool:
    return stats.files > 0 and not (stats.small_ratio < small_ratio and stats.avg_mb > good_avg_mb)


def swap(spark: SparkSession, path: str, staging: str) -> None:
    """Puts ``staging`` in the place of ``path``. The old table is renamed first and deleted last, so at every moment
    one whole copy stands at ``path``, or at ``path + '._backup'`` for ``recover`` to bring back."""
    fs, at = _fs(spark, path)
    backup, new = _fs(spark, f"{path}._backup")[1], _fs(spark, staging)[1]
    if not fs.exists(new):
        raise FileNotFoundError(staging)
    if fs.exists(backup):
        raise FileExistsError(f"{backup.toString()}: an earlier swap did not end; recover it first")
    if fs.exists(at) and not fs.rename(at, backup):
        raise OSError(f"{path} could not be renamed")
    if not fs.rename(new, at):
        fs.rename(backup, at)
        raise OSError(f"{staging} could not be put in place")
    fs.delete(backup, True)


def recover(spark: SparkSession, path: str) -> str:
    """After a crash within ``swap``: 'restored' the old table, 'finished' the new one, or there was 'nothing' to do."""
    fs, at = _fs(spark, path)
    backup = _fs(spark, f"{path}._backup")[1]
    if not fs.exists(backup):
        return "nothing"
    if fs.exists(at):
        fs.delete(backup, True)
        return "finished"
    fs.rename(backup, at)
    return "restored"


def compact(spark: SparkSession, path: str, partition_cols: Sequence[str] = (), small_ratio: float = 0.30, target_mb: int = 192) -> Compaction | None:
    """Rewrites a table of small files; None if it has no files or is in good order."""
    recover(spark, path)
    before = analyze(spark, path)
    if not needs_compaction(before, small_ratio):
        return None
    staging = f"{path}._staging"
    with conf(spark, {"spark.sql.sources.partitionColumnTypeInference.enabled": False}):  # "01" stays "01"
        rows = spark.read.parquet(path)
    if partition_cols:
        # as many tasks a directory as its bytes need; rows are dealt to them by their hash
        need = listing(spark, path).groupBy("folder").agg(F.sum("length").alias("b"))
        need = need.select("folder", F.greatest(F.ceil(F.col("b") / (target_mb * MB)), F.lit(1)).cast("long").alias("_files"))
        folder = F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "")
        dealt = rows.withColumn("_folder", folder).join(need, F.col("_folder") == F.col("folder"), "left")
        salt = F.coalesce(F.pmod(F.xxhash64(*rows.columns), F.col("_files")), F.lit(0).cast("long"))
        out = dealt.withColumn("_salt", salt).repartition(*partition_cols, "_salt").select(*rows.columns).write.partitionBy(*partition_cols)
    else:
        out = rows.repartition(partitions_for_bytes(before.total_bytes, target_mb)).write
    out.mode("overwrite").option("compression", "zstd").parquet(staging)
    swap(spark, path, staging)
    spark.catalog.refreshByPath(path)
    return Compaction(path, before, analyze(spark, path))


def compact_all(spark: SparkSession, base: str) -> dict[str, Compaction | None]:
    """The facts by date, and the dimensions."""
    tables = {"fact_transactions": ("dt",), "dim_users": (), "dim_merchants": (), "dim_devices": (), "dim_mcc": ()}
    return {name: compact(spark, f"{base}/{name}", cols) for name, cols in tables.items()}
