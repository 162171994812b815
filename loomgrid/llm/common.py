"""Shared pieces of the llm operators: scratch tables in the cluster's shared folder, and table readers."""

from __future__ import annotations

import ctypes
import functools

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, shared_dir


#: Keys that are dealt over several tasks at most, and rows of a key that are never dealt further.
HOT_KEYS, FEW = 10_000, 100


def materialise(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts the lineage and survives lost executors.

    The table goes when the session ends, or earlier by ``drop``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    goes_at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._loom_path = path
    return out


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def goes_at_exit(spark: SparkSession, path: str) -> None:
    """Scratch that a lazy result may still read is deleted when the driver's file systems are closed."""
    fs, target = _file_system(spark, path)
    fs.deleteOnExit(target)


def drop(*tables: DataFrame) -> None:
    """Deletes tables of ``materialise`` that nothing reads any more."""
    for df in tables:
        fs, target = _file_system(df.sparkSession, df._loom_path)
        fs.delete(target, True)


def tidy(run):
    """A function of ``mapInArrow`` that gives free memory back to the system when its task ends: workers live on, and
    what one stage has left unused should not add up with what the next one needs."""

    @functools.wraps(run)
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc
                trim(0)

    return tidied


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text (null text: empty), so that no other column can clash."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def crc_fold(col) -> object:
    """crc32 of the id as text, mod 3."""
    return F.crc32(col.cast("string").cast("binary")) % 3


def spread_join(left: DataFrame, right: DataFrame, key: str, n: str, total: int, how: str = "left") -> DataFrame:
    """``left`` with the one row of its key in ``right``, whose column ``n`` has the rows of ``left`` with that key.

    Keys with more than a share of 1 / HOT_KEYS of the ``total`` rows are HOT_KEYS at most, so these and the parts they
    are dealt to can be broadcast; no task gathers more than such a share (or FEW rows) of a key.
    """
    limit = max(FEW, -(-total // HOT_KEYS))
    parts = F.greatest(F.ceil(F.col(n) / limit), F.lit(1)).cast("long")
    hot = right.where(F.col(n) > limit).select(key, parts.alias("_parts"))
    dealt = left.join(F.broadcast(hot), key, "left").withColumn("_salt", F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("_parts")), F.lit(0).cast("long"))).drop("_parts")
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    return dealt.join(copies, [key, "_salt"], how).drop("_salt")


__all__ = ["crc_fold", "drop", "goes_at_exit", "id_text", "materialise", "scratch_path", "shared_dir", "spread_join", "table", "tidy"]
