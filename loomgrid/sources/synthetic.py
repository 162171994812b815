"""Reproducible synthetic card transactions: every value is a hash of the row's number and a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings

#: Fixed values.
CHANNELS = ("online", "pos", "atm", "mobile")
STATUSES = ("approved", "approved", "approved", "declined", "error")


def _unit(seed: int, what: str) -> Column:
    """A number of [0, 1) that depends on the row's id, the seed and the purpose."""
    return F.pmod(F.xxhash64("id", F.lit(seed), F.lit(what)), F.lit(1 << 40)).cast("double") / float(1 << 40)


def _pick(unit: Column, values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (unit * len(values)).cast("int") + 1)


def dim_users(spark: SparkSession, s: Settings) -> DataFrame:
    return spark.range(s.users).select(F.col("id").alias("user_id"), F.concat(F.lit("user_"), "id").alias("user_name"), (F.col("id") % 5).cast("string").alias("segment"))


def dim_merchants(spark: SparkSession, s: Settings) -> DataFrame:
    return spark.range(s.merchants).select(F.col("id").alias("merchant_id"), F.concat(F.lit("merchant_"), "id").alias("merchant_name"), (F.col("id") % 100).alias("mcc"))


def dim_devices(spark: SparkSession, s: Settings) -> DataFrame:
    return spark.range(s.devices).select(F.col("id").cast("string").alias("device_id"), F.concat(F.lit("device_"), "id").alias("device_name"), (F.col("id") % 3).cast("string").alias("platform"))


def dim_mcc(spark: SparkSession) -> DataFrame:
    return spark.range(100).select(F.col("id").alias("mcc"), F.concat(F.lit("mcc_"), "id").alias("mcc_desc"))


def fact_transactions(spark: SparkSession, s: Settings, as_of: str) -> DataFrame:
    """Whole-second times of the last ``days`` days before ``as_of``; a hot share of rows on few users."""
    u = lambda what: _unit(s.seed, what)
    spread = lambda what, n: (u(what) * n).cast("long")
    user = F.when(u("hot") < s.hot_share, spread("user", s.hot_users)).otherwise(s.hot_users + spread("user", max(1, s.users - s.hot_users)))
    octet = lambda k, low: (spread(f"ip{k}", 255 - low) + low).cast("string")
    letter = lambda k: _pick(u(f"geo{k}"), tuple("bcdefghjkmnpqrstuvwxyz"))
    digit = lambda k: spread(f"geo{k}", 10).cast("string")
    ts = F.timestamp_seconds(F.unix_timestamp(F.lit(as_of)) - spread("ts", s.days * 86_400))
    return spark.range(s.transactions).select(
        F.col("id").alias("txn_id"), user.alias("user_id"), spread("merchant", s.merchants).alias("merchant_id"),
        F.when(u("no device") >= s.null_device_share, spread("device", s.devices).cast("string")).alias("device_id"),
        F.concat_ws(".", octet(0, 10), octet(1, 0), octet(2, 0), octet(3, 0)).alias("ip"),
        F.concat(letter(0), letter(1), digit(2), letter(3), digit(4)).alias("geo_hash"),
        F.exp(u("amount") * 5.0).alias("amount"), _pick(u("channel"), CHANNELS).alias("channel"), _pick(u("status"), STATUSES).alias("status"),
        ts.alias("ts"), F.to_date(ts).alias("dt"),
    )


def generate_all(spark: SparkSession, s: Settings, as_of: str) -> dict[str, str]:
    """Writes all tables below ``base_path``; facts by date. Returns their paths."""
    from .writer import write_parquet, write_partitioned

    paths = {}
    for name, df in (("dim_users", dim_users(spark, s)), ("dim_merchants", dim_merchants(spark, s)), ("dim_devices", dim_devices(spark, s)), ("dim_mcc", dim_mcc(spark))):
        paths[name] = f"{s.base_path}/{name}"
        write_parquet(df, paths[name])
    paths["fact_transactions"] = f"{s.base_path}/fact_transactions"
    write_partitioned(fact_transactions(spark, s, as_of), paths["fact_transactions"], ["dt"], compression="snappy")
    return paths
