"""Sessions, tuning presets, and settings that are put back after use."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

MB = 1 << 20

#: The recommended settings for adaptive execution, reads and joins.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 * MB),
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": str(MB),
    "spark.sql.shuffle.partitions": "200",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(256 * MB),
    "spark.sql.autoBroadcastJoinThreshold": str(32 * MB),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * MB),
    "spark.sql.files.maxPartitionBytes": str(128 * MB),
    "spark.sql.files.openCostInBytes": str(4 * MB),
    "spark.sql.files.maxRecordsPerFile": "5000000",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.dynamicPartitionPruning.enabled": "true",
}
#: The settings without adaptive execution, those of one machine, and speculation (below).
BASELINE = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "200", "spark.sql.autoBroadcastJoinThreshold": str(10 * MB)}
LAPTOP = {**RECOMMENDED, "spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(32 * MB)}
PRESETS: Mapping[str, Mapping[str, str]] = {"recommended": RECOMMENDED, "baseline": BASELINE, "laptop": LAPTOP}
#: Speculation can only be set while a session is built.
SPECULATION = {"spark.speculation": "true", "spark.speculation.interval": "100ms", "spark.speculation.multiplier": "1.5", "spark.speculation.quantile": "0.9"}
DUMPED = ("spark.sql.adaptive", "spark.sql.shuffle", "spark.sql.files", "spark.sql.autoBroadcastJoinThreshold")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only on one machine (a local master, as in tests) a folder of our own is made and set where the session names none.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="loomgrid-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/loomgrid-{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: a barrier that survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def build_session(app: str = "loomgrid", master: str | None = None, preset: str = "laptop", speculation: bool = False, warehouse: str | None = None, catalog: str | None = None, extra: Mapping[str, str] | None = None) -> SparkSession:
    """A session in UTC with a preset; ``speculation`` adds its four settings, which a running session refuses.

    ``catalog``: "hive" for a persistent metastore, "in-memory" for none; unset, Spark's default.
    """
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.serializer", "org.apache.spark.serializer.KryoSerializer")
    if master or "SPARK_MASTER" in os.environ:
        builder = builder.master(master or os.environ["SPARK_MASTER"])
    if warehouse:
        builder = builder.config("spark.sql.warehouse.dir", warehouse)
    if catalog:
        builder = builder.config("spark.sql.catalogImplementation", catalog)
    for k, v in {**PRESETS[preset], **(SPECULATION if speculation else {}), **(extra or {})}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def apply_preset(spark: SparkSession, name: str) -> None:
    """Sets a preset; what only other presets manage goes back to its default first."""
    for k in {k for p in PRESETS.values() for k in p}:
        spark.conf.unset(k)
    for k, v in PRESETS[name].items():
        spark.conf.set(k, v)


@contextmanager
def conf(spark: SparkSession, settings: Mapping[str, object]) -> Iterator[SparkSession]:
    """Settings for a block; earlier values come back afterwards, unset ones are unset again."""
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, str(v))
        yield spark
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def dump_confs(spark: SparkSession, prefixes: tuple[str, ...] = DUMPED) -> DataFrame:
    """key, value of the settings under the prefixes, in order."""
    rows = sorted((k, v) for k, v in spark.conf.getAll.items() if k.startswith(prefixes))
    return spark.createDataFrame(rows, "key string, value string")


def set_codegen_limit(spark: SparkSession, limit: int = 8000):
    """Generated methods above ``limit`` bytes of byte code run interpreted; a block, as ``conf``."""
    return conf(spark, {"spark.sql.codegen.hugeMethodLimit": limit})
