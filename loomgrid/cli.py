"""Command line: python -m loomgrid.cli STAGE [--case NAME] [--demo NAME] [--preset NAME] [--base PATH]."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config
from .operators import aggregates, batch, features, joins, partitioning, predicates
from .plans.explain import compare, dump_plan
from .session import PRESETS, SPECULATION, apply_preset, build_session, conf, dump_confs, set_codegen_limit
from .sources import layout, synthetic, writer

AS_OF = "2024-01-31 00:00:00"


class Run:
    """The tables below a base path, and what the stages do with them."""

    def __init__(self, spark: SparkSession, settings: config.Settings):
        self.spark, self.settings = spark, settings

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.settings.base_path}/{name}")

    @property
    def txns(self) -> DataFrame:
        t = self.table("fact_transactions")
        return t.withColumn("ts", F.col("ts").cast("timestamp_ntz")).withColumn("cents", F.round(F.col("amount") * 100).cast("long"))

    def gen(self) -> None:
        synthetic.generate_all(self.spark, self.settings, AS_OF)

    def features(self) -> None:
        rich = features.enrich(self.txns, self.table("dim_merchants"), self.table("dim_mcc"))
        dump_plan(rich, self.settings.base_path, "enriched")
        writer.write_features(features.feature_pipeline(self.txns, AS_OF), f"{self.settings.base_path}/user_wide")

    def analyze(self) -> None:
        for name in ("fact_transactions", "dim_users", "dim_merchants", "dim_devices", "dim_mcc"):
            print(name, layout.analyze(self.spark, f"{self.settings.base_path}/{name}", self.settings.small_file_mb).pretty())

    def compact(self) -> None:
        for name, done in layout.compact_all(self.spark, self.settings.base_path).items():
            print(name, "unchanged" if done is None else f"{done.before.files} -> {done.after.files} files")

    # cases: variants of one relation, timed side by side

    def nullkey(self) -> DataFrame:
        t, dim = self.txns, self.table("dim_devices")
        return compare(self.spark, {"plain": lambda: joins.auto_join(t, dim, "device_id"), "without nulls": lambda: joins.join_without_null_keys(t, dim, "device_id"), "nulls aside": lambda: joins.null_safe_join(t, dim, "device_id")})

    def cast(self) -> DataFrame:
        t, dim = self.txns, self.table("dim_users").select(F.col("user_id").cast("string").alias("user_text"), "user_name")
        return compare(self.spark, {"mixed": lambda: joins.mixed_type_join(t, dim, "user_id", "user_text"), "aligned": lambda: joins.aligned_join(t, dim, "user_id", "user_text")})

    def twostage(self) -> DataFrame:
        return compare(self.spark, {"plain": lambda: aggregates.totals(self.txns, "user_id", "cents"), "stages": lambda: aggregates.totals_in_stages(self.txns, "user_id", "cents", ["txn_id"])})

    def pushdown(self) -> DataFrame:
        return compare(self.spark, {"opaque": lambda: self.txns.where(predicates.opaque_gt("amount", 100.0)), "pushed": lambda: self.txns.where(F.col("amount") > 100.0)})

    def window(self) -> DataFrame:
        return compare(self.spark, {"plain": lambda: aggregates.top_rows(self.txns, "user_id", "cents", "txn_id"), "stages": lambda: aggregates.top_rows_in_stages(self.txns, "user_id", "cents", "txn_id")})

    def broadcast(self) -> DataFrame:
        t, dim = self.txns, self.table("dim_users")
        return compare(self.spark, {"broadcast": lambda: joins.broadcast_join(t, dim, "user_id"), "merge": lambda: joins.broadcast_join(t, dim, "user_id", most=0), "lookup": lambda: joins.lookup(t, dim, "user_id", "user_name")})

    def codegen(self) -> DataFrame:
        with set_codegen_limit(self.spark):
            return compare(self.spark, {"one": lambda: predicates.wide_projection(self.txns, "cents", 400), "steps": lambda: predicates.wide_projection_in_steps(self.txns, "cents", 400)})

    def partitionwrite(self) -> DataFrame:
        base = f"{self.settings.base_path}/_case"
        writer.write_fanned_out(self.txns.repartition(8), f"{base}/fan", ["dt"])
        writer.write_clustered(self.txns, f"{base}/clustered", ["dt"])
        rows = [(k, layout.analyze(self.spark, f"{base}/{k}").files) for k in ("fan", "clustered")]
        return self.spark.createDataFrame(rows, "label string, files int")

    def speculation(self) -> DataFrame:
        return self.spark.createDataFrame(sorted(SPECULATION.items()), "key string, value string")

    # demonstrations

    def dpp(self) -> DataFrame:
        days = self.table("fact_transactions").select("dt").distinct().withColumn("is_recent", F.lit(True))
        facts = self.table("fact_transactions")
        out = {}
        for on in (True, False):
            with conf(self.spark, {"spark.sql.optimizer.dynamicPartitionPruning.enabled": on}):
                df = joins.calendar_join(facts, days, "2024-01-25")
                dump_plan(df, self.settings.base_path, f"dpp_{on}", "extended")
                out[f"pruning {on}"] = lambda df=df: df
        return compare(self.spark, out)

    def bucket(self) -> DataFrame:
        for name, df in (("loom_cli_txns", self.txns), ("loom_cli_users", self.table("dim_users"))):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            joins.write_bucketed(df, name, "user_id", 8, f"{self.settings.base_path}/{name}")
        return compare(self.spark, {"buckets": lambda: joins.bucketed_join(self.spark, "loom_cli_txns", "loom_cli_users", "user_id"), "paths": lambda: joins.path_join(self.spark, "loom_cli_txns", "loom_cli_users", "user_id")})

    def partitioner(self) -> DataFrame:
        hot = [r.user_id for r in joins.top_hot_keys(self.txns, "user_id", 10).collect()]
        partitioning.largest_partitions(partitioning.deal_hot_keys(self.txns, "user_id", hot, 8)).show()
        return partitioning.compare_partitioners(self.txns, "user_id", hot, 9)

    def batching(self) -> DataFrame:
        df = self.txns.select("txn_id")
        return compare(self.spark, {"rows": lambda: batch.score_rows(df, "txn_id"), "batches": lambda: batch.score_batches(df, "txn_id")})

    def accumulator(self) -> DataFrame:
        df = self.txns.select("txn_id")
        return self.spark.createDataFrame([("naive", batch.count_naively(df)), ("once", batch.count_once(df))], "label string, rows long")

    def catalyst(self) -> DataFrame:
        return compare(self.spark, {"cast": lambda: self.txns.where(F.col("amount").cast("long") > 100), "raw": lambda: self.txns.where(predicates.truncated_gt("amount", 100))})


STAGES = ("gen", "features", "compact", "analyze")
CASES = ("nullkey", "cast", "twostage", "pushdown", "window", "broadcast", "codegen", "partitionwrite", "speculation")
DEMOS = ("dpp", "bucket", "partitioner", "batching", "accumulator", "catalyst")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="loomgrid")
    parser.add_argument("stage", nargs="?", default="all", choices=[*STAGES, "case", "advanced", "all"])
    parser.add_argument("--case", choices=CASES)
    parser.add_argument("--demo", choices=DEMOS)
    parser.add_argument("--preset", choices=sorted(PRESETS))
    parser.add_argument("--base", default=config.Settings.base_path)
    parser.add_argument("--transactions", type=int, default=config.Settings.transactions)
    parser.add_argument("--users", type=int, default=config.Settings.users)
    args = parser.parse_args(argv)
    own = spark is None
    spark = spark or build_session(preset=args.preset or "laptop")
    if args.preset and not own:
        apply_preset(spark, args.preset)
    if args.preset:
        dump_confs(spark).show(100, False)
    run = Run(spark, config.load(base_path=args.base, transactions=args.transactions, users=args.users))
    names = list(STAGES) if args.stage == "all" else [args.stage]
    for name in names:
        if name == "case":
            for case in [args.case] if args.case else CASES:
                getattr(run, case)().show(50, False)
        elif name == "advanced":
            for demo in [args.demo] if args.demo else DEMOS:
                getattr(run, demo)().show(50, False)
        else:
            getattr(run, name)()
    if own:
        spark.stop()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
