"""Plans as text, and timing of whole results."""

from __future__ import annotations

import io
import time
from collections.abc import Callable, Mapping
from contextlib import redirect_stdout

from pyspark.sql import DataFrame, SparkSession


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain(mode=mode)
    return out.getvalue()


def dump_plan(df: DataFrame, base: str, name: str, mode: str = "formatted") -> str:
    """Writes the plan to <base>/_plans/<name>.txt in the base's file system; returns the path."""
    spark = df.sparkSession
    path = f"{base}/_plans/{name}.txt"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(at, True)
    try:
        out.write(bytearray(plan_text(df, mode).encode()))
    finally:
        out.close()
    return path


def timed(df: DataFrame) -> float:
    """Seconds to compute every row and column; nothing is pruned, as a count would."""
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def compare(spark: SparkSession, variants: Mapping[str, Callable[[], DataFrame]]) -> DataFrame:
    """label, rows, ms of each variant."""
    rows = []
    for label, make in variants.items():
        df = make()
        s = timed(df)
        rows.append((label, df.count(), int(s * 1000)))
    return spark.createDataFrame(rows, "label string, rows long, ms long")
