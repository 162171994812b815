"""Named caches that are filled at once, reported and released."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

#: MEMORY_AND_DISK keeps serialized rows in Python sessions.
LEVELS = {"wide": StorageLevel.MEMORY_AND_DISK, "small": StorageLevel.MEMORY_ONLY, "disk": StorageLevel.DISK_ONLY}


class CacheManager:
    def __init__(self, spark: SparkSession):
        self.spark, self.held = spark, {}

    def persist(self, df: DataFrame, name: str, kind: str = "wide") -> DataFrame:
        if name in self.held:
            raise ValueError(f"{name} is cached already")
        df = df.persist(LEVELS[kind])
        df.count()
        self.held[name] = df
        return df

    def truncate_lineage(self, df: DataFrame) -> DataFrame:
        """A checkpoint in the folder of ``spark.checkpoint.dir``, which executors share."""
        if not self.spark.sparkContext.getCheckpointDir():
            folder = self.spark.conf.get("spark.checkpoint.dir", None)
            if not folder:
                raise ValueError("spark.checkpoint.dir names no folder for checkpoints")
            self.spark.sparkContext.setCheckpointDir(folder)
        return df.checkpoint(eager=True)

    def unpersist(self, name: str) -> None:
        self.held.pop(name).unpersist(blocking=True)

    def unpersist_all(self) -> None:
        for name in list(self.held):
            self.unpersist(name)

    def report(self) -> DataFrame:
        """name, partitions, memory_bytes, disk_bytes of what is stored."""
        rows = [(str(i.name())[:200], i.numCachedPartitions(), i.memSize(), i.diskSize()) for i in self.spark._jsc.sc().getRDDStorageInfo()]
        return self.spark.createDataFrame(rows, "name string, partitions int, memory_bytes long, disk_bytes long")


@contextmanager
def cached(df: DataFrame, kind: str = "wide") -> Iterator[DataFrame]:
    df = df.persist(LEVELS[kind])
    try:
        df.count()
        yield df
    finally:
        df.unpersist(blocking=True)
