"""The registry of the engine's own queries and their DuckDB SQL, by the survey's operator ids."""

from __future__ import annotations

import dataclasses
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions.scalar import number
from ..operators import aggregates, batch, features, joins, partitioning, predicates
from ..session import RECOMMENDED, apply_preset, dump_confs, scratch_path, set_codegen_limit, shared_dir
from ..sources import layout, synthetic, tables, writer
from .cache import CacheManager
from .explain import dump_plan
from .metrics import stage_metrics
from ..sources.tables import AS_OF, TX_SQL

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
TS = f"TIMESTAMP '{AS_OF}'"
WINDOWS = features.WINDOWS


def _query(name: str, sql: str | None = None):
    """Registers a query; ``sql`` that starts with SELECT may use the view tx."""

    def put(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            text = sql.strip()
            if text.startswith("SELECT") and ("tx" in text.replace("(", " ").replace(")", " ").replace(",", " ").split()):
                text = f"{TX_SQL}\n{text}"
            elif text.startswith("WITH") and " tx" in text:
                text = f"{TX_SQL},\n{text[4:].strip()}"
            _SQL[name] = text
        return f

    return put


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _tx(spark, d):
    return tables.transactions(spark, d)


# ---------------------------------------------------------------------------------------------- inputs with edges

#: All events, by a key with three tenths of the rows on one value (that no customer has) and with nulls, and all
#: customers. Repeated, missing and null keys of the dimension are fixtures of the tests.
_KEY = "CASE WHEN tx.txn_id % 50 = 1 THEN NULL ELSE tx.hot_user END"
LEFT_SQL = f"SELECT {_KEY} AS null_user, tx.txn_id, tx.cents, c_name AS name FROM tx LEFT JOIN customer ON c_custkey = {_KEY}"


def _fact(spark, d) -> DataFrame:
    key = F.when(F.col("txn_id") % 50 == 1, F.lit(None)).otherwise(F.col("hot_user")).cast("long")
    return _tx(spark, d).select(key.alias("null_user"), "txn_id", "cents")


def _dim(spark, d) -> DataFrame:
    return tables.users(spark, d).select(F.col("user_id").cast("long").alias("null_user"), F.col("user_name").alias("name"))


# ---------------------------------------------------------------------------------------------- sources


@_query("SRC1_parquet_scan", "SELECT * FROM orders")
def _(spark, d):
    return tables.scan(spark, f"{d}/orders.parquet")


@_query("SRC2_pruned_scan", "SELECT event_id, user_id FROM events")
def _(spark, d):
    return tables.scan(spark, f"{d}/events.parquet", ("event_id", "user_id"))


@_query("SRC3_range", "SELECT CAST(range AS BIGINT) AS id, CAST(range % 5 AS VARCHAR) AS segment FROM range(1000)")
def _(spark, d):
    return spark.range(1000).withColumn("segment", (F.col("id") % 5).cast("string"))


@_query("SRC4_calendar", "SELECT CAST(DATE '2024-01-31' - CAST(range AS INTEGER) AS DATE) AS dt, range < 7 AS is_recent FROM range(35)")
def _(spark, d):
    return tables.calendar(spark, "2024-01-31", 35)


def _bucketed(spark, rows: DataFrame, name: str) -> str:
    """A table bucketed on the user, written anew under a name that nothing else has: not queries that run at once, nor
    what another session left in the warehouse, nor other rows at the same path. Its files go at exit."""
    table = f"loom_{name}_{uuid.uuid4().hex}"
    joins.write_bucketed(rows, table, "user_id", 8)
    layout.goes_at_exit(spark, tables.table_path(spark, table))
    return table


def _bucketed_txns(spark, d) -> str:
    return _bucketed(spark, _tx(spark, d).select("txn_id", "user_id", "cents"), "txns")


def _bucketed_users(spark, d) -> str:
    return _bucketed(spark, tables.users(spark, d), "users")


@_query("SRC5_bucketed_table", "SELECT txn_id, user_id, cents FROM tx")
def _(spark, d):
    return spark.table(_bucketed_txns(spark, d))


@_query("SRC6_table_path", "SELECT txn_id, user_id, cents FROM tx")
def _(spark, d):
    return spark.read.parquet(tables.table_path(spark, _bucketed_txns(spark, d)))


# ---------------------------------------------------------------------------------------------- projections


@_query("PRJ1_select_alias", "SELECT txn_id, user_id AS customer FROM tx")
def _(spark, d):
    return _tx(spark, d).select("txn_id", F.col("user_id").alias("customer"))


@_query("PRJ2_with_column", "SELECT txn_id, cents, cents * 2 AS twice FROM tx")
def _(spark, d):
    return _tx(spark, d).select("txn_id", "cents").withColumn("twice", F.col("cents") * 2)


_WIDE = ", ".join(f"CASE WHEN cents > {i} THEN cents + {i} ELSE cents - {i} END AS cents_{i}" for i in range(400))


@_query("PRJ3_wide_projection", f"SELECT txn_id, cents, {_WIDE} FROM tx")
def _(spark, d):
    return predicates.wide_projection(_tx(spark, d).select("txn_id", "cents"), "cents", 400)


@_query("PRJ4_wide_projection_in_steps", f"SELECT txn_id, cents, {_WIDE} FROM tx")
def _(spark, d):
    return predicates.wide_projection_in_steps(_tx(spark, d).select("txn_id", "cents"), "cents", 400)


@_query("PRJ5_rename_drop_cast", "SELECT CAST(txn_id AS VARCHAR) AS id_text, user_id FROM tx")
def _(spark, d):
    return _tx(spark, d).select("txn_id", "user_id", "ip").withColumn("txn_id", F.col("txn_id").cast("string")).withColumnRenamed("txn_id", "id_text").drop("ip")


@_query("PRJ6_transform_chain", "SELECT txn_id, cents + 1 AS cents FROM tx WHERE cents > 100")
def _(spark, d):
    return _tx(spark, d).select("txn_id", "cents").transform(lambda x: x.where("cents > 100")).transform(lambda x: x.withColumn("cents", F.col("cents") + 1))


@_query("PRJ7_explode_copies", "SELECT n_nationkey, CAST(range AS BIGINT) AS copy FROM nation, range(4)")
def _(spark, d):
    return tables.read(spark, d, "nation").select("n_nationkey", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("copy"))


# ---------------------------------------------------------------------------------------------- filters

_FILTERS: dict[str, tuple[str, Callable[[], object]]] = {
    "FLT1_null_checks": ("device_id IS NOT NULL OR null_user IS NULL", lambda: F.col("device_id").isNotNull() | F.col("null_user").isNull()),
    "FLT2_lower_bound": (f"ts >= {TS} - INTERVAL 7 DAY", lambda: F.col("ts") >= F.lit(AS_OF).cast("timestamp_ntz") - F.make_dt_interval(F.lit(7))),
    "FLT3_closed_window": (f"ts BETWEEN {TS} - INTERVAL 7 DAY AND {TS}", lambda: features.in_window(AS_OF, 7)),
    "FLT4_comparison": ("amount > 400.0", lambda: F.col("amount") > 400.0),
    "FLT5_opaque_comparison": ("amount > 400.0", lambda: predicates.opaque_gt("amount", 400.0)),
    "FLT6_membership": ("user_id IN (1, 2, 3)", lambda: F.col("user_id").isin(1, 2, 3)),
    "FLT6_not_member": ("coalesce(null_user NOT IN (1, 2, 3), true)", lambda: ~F.coalesce(F.col("null_user").isin(1, 2, 3), F.lit(False))),
    "FLT9_starts_with": ("starts_with(channel, 'p')", lambda: F.col("channel").startswith("p")),
    "FLT10_and_equals_not": ("channel = 'view' AND NOT (cents < 1000)", lambda: (F.col("channel") == "view") & ~(F.col("cents") < 1000)),
    "FLT11_truncated_comparison": ("CAST(trunc(amount) AS BIGINT) > 400", lambda: predicates.truncated_gt("amount", 400)),
}
for _name, (_cond, _make) in _FILTERS.items():
    _query(_name, f"SELECT txn_id, user_id, cents FROM tx WHERE {_cond}")(lambda spark, d, make=_make: _tx(spark, d).where(make()).select("txn_id", "user_id", "cents"))


@_query("FLT7_boolean_column", "SELECT CAST(DATE '2024-01-31' - CAST(range AS INTEGER) AS DATE) AS dt FROM range(7)")
def _(spark, d):
    return tables.calendar(spark, "2024-01-31", 35).where("is_recent").select("dt")


@_query("FLT8_rank_filter", "SELECT * FROM (SELECT user_id, txn_id, cents, CAST(row_number() OVER (PARTITION BY user_id ORDER BY cents DESC, txn_id) AS INTEGER) AS rn FROM tx) WHERE rn <= 2")
def _(spark, d):
    return aggregates.top_rows(_tx(spark, d).select("user_id", "txn_id", "cents"), "user_id", "cents", "txn_id", 2)


# ---------------------------------------------------------------------------------------------- joins

_LEFT: dict[str, Callable] = {
    "JN1_broadcast_join": lambda s, a, b: joins.broadcast_join(a, b, "null_user"),
    "JN2_sort_merge_join": lambda s, a, b: joins.sort_merge_join(a, b, "null_user"),
    "JN3_shuffle_hash_join": lambda s, a, b: joins.shuffle_hash_join(a, b, "null_user"),
    "JN4_safe_join": lambda s, a, b: joins.safe_join(a, b, "null_user", "merge"),
    "JN5_auto_join": lambda s, a, b: joins.auto_join(a, b, "null_user"),
    "JN7_adaptive_skew_join": lambda s, a, b: joins.adaptive_skew_join(s, a, b, "null_user"),
    "JN8_salted_join": lambda s, a, b: joins.salted_join(a, b, "null_user", ["txn_id"], 16),
    "JN9_hot_cold_join": lambda s, a, b: joins.hot_cold_join(a, b, "null_user", [0, 1, 2]),
    "JN11_null_key_join": lambda s, a, b: joins.auto_join(a, b, "null_user"),
    "JN13_null_safe_join": lambda s, a, b: joins.null_safe_join(a, b, "null_user"),
    "JN16_forced_broadcast": lambda s, a, b: joins.forced_broadcast(a, b, "null_user"),
    "JN17_merge_fallback": lambda s, a, b: joins.broadcast_join(a, b, "null_user", most=0),
}
for _name, _join in _LEFT.items():
    _query(_name, LEFT_SQL)(lambda spark, d, join=_join: join(spark, _fact(spark, d), _dim(spark, d)).select("null_user", "txn_id", "cents", "name"))


@_query("JN10_top_hot_keys", "SELECT hot_user, count(*) AS count FROM tx WHERE hot_user IS NOT NULL GROUP BY hot_user ORDER BY count DESC, hot_user LIMIT 50")
def _(spark, d):
    return joins.top_hot_keys(_tx(spark, d), "hot_user", 50)


@_query("JN12_join_without_null_keys", f"{LEFT_SQL} WHERE {_KEY} IS NOT NULL")
def _(spark, d):
    return joins.join_without_null_keys(_fact(spark, d), _dim(spark, d), "null_user").select("null_user", "txn_id", "cents", "name")


def _text_users(spark, d):
    return tables.users(spark, d).select(F.col("user_id").cast("string").alias("user_text"), "user_name")


@_query("JN14_mixed_type_join", "SELECT tx.txn_id, tx.user_id, CAST(c_custkey AS VARCHAR) AS user_text, c_name AS user_name FROM tx LEFT JOIN customer ON c_custkey = tx.user_id")
def _(spark, d):
    return joins.mixed_type_join(_tx(spark, d).select("txn_id", "user_id"), _text_users(spark, d), "user_id", "user_text")


@_query("JN15_aligned_join", "SELECT tx.user_id, tx.txn_id, c_name AS user_name FROM tx LEFT JOIN customer ON c_custkey = tx.user_id")
def _(spark, d):
    return joins.aligned_join(_tx(spark, d).select("user_id", "txn_id"), _text_users(spark, d), "user_id", "user_text")


@_query("JN18_lookup", LEFT_SQL)
def _(spark, d):
    return joins.lookup(_fact(spark, d), _dim(spark, d), "null_user", "name").select("null_user", "txn_id", "cents", "name")


@_query("JN19_bucketed_join", "SELECT tx.user_id, tx.txn_id, tx.cents, c_name AS user_name, c_mktsegment AS segment FROM tx JOIN customer ON c_custkey = tx.user_id")
def _(spark, d):
    return joins.bucketed_join(spark, _bucketed_txns(spark, d), _bucketed_users(spark, d), "user_id")


@_query("JN20_path_join", "SELECT tx.user_id, tx.txn_id, tx.cents, c_name AS user_name, c_mktsegment AS segment FROM tx JOIN customer ON c_custkey = tx.user_id")
def _(spark, d):
    return joins.path_join(spark, _bucketed_txns(spark, d), _bucketed_users(spark, d), "user_id")


@_query("JN6_compared_joins", f"SELECT label, (SELECT count(*) FROM ({LEFT_SQL})) AS rows FROM (VALUES ('broadcast'), ('merge'), ('shuffle_hash')) AS l(label), (SELECT 1 FROM tx LIMIT 1) AS one")
def _(spark, d):
    return joins.benchmark_joins(_fact(spark, d), _dim(spark, d), "null_user").select("label", "rows")


_RECENT = "SELECT tx.dt, tx.txn_id, tx.cents, tx.dt > DATE '2024-01-24' AS is_recent FROM tx WHERE dt >= DATE '2024-01-20'"


def _daily(spark, d) -> str:
    """The events written by day; the path of the table."""
    path = scratch_path(spark, "daily")
    writer.write_partitioned(_tx(spark, d).select("dt", "txn_id", "cents"), path, ["dt"])
    return path


@_query("JN21_pruned_days", _RECENT)
def _(spark, d):
    return joins.pruned_days(spark, _daily(spark, d), tables.calendar(spark, "2024-01-31", 35), "2024-01-20").select("dt", "txn_id", "cents", "is_recent")


@_query("JN21_unpruned_days", _RECENT)
def _(spark, d):
    return joins.pruned_days(spark, _daily(spark, d), tables.calendar(spark, "2024-01-31", 35), "2024-01-20", prune=False).select("dt", "txn_id", "cents", "is_recent")


@_query("JN21_calendar_join", _RECENT)
def _(spark, d):
    return joins.calendar_join(_tx(spark, d).select("dt", "txn_id", "cents"), tables.calendar(spark, "2024-01-31", 35), "2024-01-20")


_ENRICH = "SELECT tx.txn_id, tx.merchant_id, n_name AS merchant_name, CAST(n_regionkey AS BIGINT) AS mcc, r_name AS mcc_desc FROM tx LEFT JOIN nation ON n_nationkey = tx.merchant_id LEFT JOIN region ON r_regionkey = n_regionkey"


@_query("JN22_snowflake", _ENRICH)
def _(spark, d):
    return features.enrich(_tx(spark, d).select("txn_id", "merchant_id"), tables.merchants(spark, d), tables.categories(spark, d))


# ---------------------------------------------------------------------------------------------- features


def _in(w: int) -> str:
    return f"ts BETWEEN {TS} - INTERVAL {w} DAY AND {TS}"


FREQUENCY = ", ".join(
    f"count(*) FILTER (WHERE {_in(w)}) AS txn_cnt_{w}d, count(*) FILTER (WHERE {_in(w)} AND status = 'purchase') AS txn_succ_cnt_{w}d, count(*) FILTER (WHERE {_in(w)} AND status = 'error') AS txn_fail_cnt_{w}d, "
    f"count(DISTINCT merchant_id) FILTER (WHERE {_in(w)}) AS distinct_merchants_{w}d, count(DISTINCT ip) FILTER (WHERE {_in(w)}) AS distinct_ips_{w}d"
    for w in WINDOWS
)
_AMOUNT_RAW = ", ".join(f"count(cents) FILTER (WHERE {_in(w)}) AS n{w}, CAST(sum(cents) FILTER (WHERE {_in(w)}) AS BIGINT) AS s{w}, CAST(sum(cents * cents) FILTER (WHERE {_in(w)}) AS BIGINT) AS q{w}, min(cents) FILTER (WHERE {_in(w)}) AS lo{w}, max(cents) FILTER (WHERE {_in(w)}) AS hi{w}, " + ", ".join(f"quantile_disc(cents, {p}) FILTER (WHERE {_in(w)}) AS p{k}_{w}" for k, p in ((50, "0.50"), (95, "0.95"), (99, "0.99"))) for w in WINDOWS)
_D = lambda x: f"CAST({x} AS DOUBLE)"
AMOUNT = ", ".join(
    f"{_D(f's{w}')} / 100 AS amt_sum_{w}d, CASE WHEN n{w} > 0 THEN {_D(f's{w}')} / 100 / {_D(f'n{w}')} END AS amt_avg_{w}d, {_D(f'lo{w}')} / 100 AS amt_min_{w}d, {_D(f'hi{w}')} / 100 AS amt_max_{w}d, "
    f"CASE WHEN n{w} > 1 THEN sqrt(({_D(f'q{w}')} - {_D(f's{w}')} * {_D(f's{w}')} / {_D(f'n{w}')}) / ({_D(f'n{w}')} - 1)) / 100 END AS amt_std_{w}d, " + ", ".join(f"{_D(f'p{k}_{w}')} / 100 AS amt_p{k}_{w}d" for k in (50, 95, 99))
    for w in WINDOWS
)
DEVICE = ", ".join(f"count(DISTINCT device_id) FILTER (WHERE {_in(w)}) AS distinct_devices_{w}d, count(DISTINCT geo_hash) FILTER (WHERE {_in(w)}) AS distinct_geos_{w}d, count(DISTINCT ip) FILTER (WHERE {_in(w)}) AS distinct_ips_dev_{w}d, count(DISTINCT channel) FILTER (WHERE {_in(w)}) AS distinct_channels_{w}d" for w in WINDOWS) + (
    f", arg_min(device_id, (ts, txn_id)) FILTER (WHERE {_in(30)}) AS first_device_30d, arg_max(device_id, (ts, txn_id)) FILTER (WHERE {_in(30)}) AS last_device_30d"
)
FREQUENCY_SQL = f"SELECT user_id, {FREQUENCY} FROM tx GROUP BY user_id"
AMOUNT_SQL = f"SELECT user_id, {AMOUNT} FROM (SELECT user_id, {_AMOUNT_RAW} FROM tx GROUP BY user_id)"
DEVICE_SQL = f"SELECT user_id, {DEVICE} FROM tx WHERE device_id IS NOT NULL GROUP BY user_id"
WIDE_SQL = f"WITH f AS ({FREQUENCY_SQL}), a AS ({AMOUNT_SQL}), v AS ({DEVICE_SQL}) SELECT *%s FROM f FULL JOIN a USING (user_id) FULL JOIN v USING (user_id)"


@_query("AG1_conditional_counts", "SELECT user_id, " + ", ".join(f"count(*) FILTER (WHERE {_in(w)}) AS txn_cnt_{w}d" for w in WINDOWS) + " FROM tx GROUP BY user_id")
def _(spark, d):
    return features.frequency_features(_tx(spark, d), AS_OF).select("user_id", *(f"txn_cnt_{w}d" for w in WINDOWS))


_DISTINCT_2 = ", ".join(f"count(DISTINCT merchant_id) FILTER (WHERE {_in(w)}) AS distinct_merchants_{w}d, count(DISTINCT ip) FILTER (WHERE {_in(w)}) AS distinct_ips_{w}d" for w in WINDOWS)
_COLS_2 = [c for w in WINDOWS for c in (f"distinct_merchants_{w}d", f"distinct_ips_{w}d")]


@_query("AG2_distinct_exact", f"SELECT user_id, {_DISTINCT_2} FROM tx GROUP BY user_id")
def _(spark, d):
    return features.frequency_features(_tx(spark, d), AS_OF).select("user_id", *_COLS_2)


@_query("AG2_distinct_approximate")
def _(spark, d):
    return features.frequency_features(_tx(spark, d), AS_OF, approximate=True).select("user_id", *_COLS_2)


_COLS_3 = [f"amt_{k}_{w}d" for w in WINDOWS for k in ("sum", "avg", "min", "max", "std")]
_COLS_4 = [f"amt_{k}_{w}d" for w in WINDOWS for k in ("p50", "p95", "p99")]


@_query("AG3_masked_amounts", f"SELECT user_id, {', '.join(_COLS_3)} FROM ({AMOUNT_SQL}) AS x, (SELECT 1 FROM tx LIMIT 1) AS one")
def _(spark, d):
    return features.amount_features_exact(_tx(spark, d), AS_OF).select("user_id", *_COLS_3)


@_query("AG4_percentiles", f"SELECT user_id, {', '.join(_COLS_4)} FROM ({AMOUNT_SQL}) AS x, (SELECT 1 FROM tx LIMIT 1) AS one")
def _(spark, d):
    return features.amount_features_exact(_tx(spark, d), AS_OF).select("user_id", *_COLS_4)


_COLS_5 = [f"distinct_{k}_{w}d" for w in WINDOWS for k in ("devices", "geos", "ips_dev")]
_COLS_6 = [f"distinct_channels_{w}d" for w in WINDOWS]


@_query("AG5_distinct_devices_exact", f"SELECT user_id, {', '.join(_COLS_5)} FROM ({DEVICE_SQL}) AS x, (SELECT 1 FROM tx LIMIT 1) AS one")
def _(spark, d):
    return features.device_features(_tx(spark, d), AS_OF).select("user_id", *_COLS_5)


@_query("AG5_distinct_devices_approximate")
def _(spark, d):
    return features.device_features(_tx(spark, d), AS_OF, approximate=True).select("user_id", *_COLS_5)


@_query("AG6_distinct_channels", f"SELECT user_id, {', '.join(_COLS_6)} FROM ({DEVICE_SQL}) AS x, (SELECT 1 FROM tx LIMIT 1) AS one")
def _(spark, d):
    return features.device_features(_tx(spark, d), AS_OF).select("user_id", *_COLS_6)


@_query("AG7_constant_of_group", "SELECT c_custkey, any_value(c_name) AS user_name FROM customer GROUP BY c_custkey")
def _(spark, d):
    return tables.read(spark, d, "customer").groupBy("c_custkey").agg(F.first("c_name").alias("user_name"))


_TOTALS = "SELECT hot_user, count(*) AS n, CAST(sum(cents) AS BIGINT) AS total FROM tx GROUP BY hot_user"


@_query("AG8_totals", _TOTALS)
def _(spark, d):
    return aggregates.totals(_tx(spark, d), "hot_user", "cents")


@_query("AG9_totals_in_stages", _TOTALS)
def _(spark, d):
    return aggregates.totals_in_stages(_tx(spark, d), "hot_user", "cents", ["txn_id"])


@_query("AG10_most_frequent", "SELECT merchant_id, count(*) AS count FROM tx GROUP BY merchant_id ORDER BY count DESC, merchant_id LIMIT 10")
def _(spark, d):
    return joins.top_hot_keys(_tx(spark, d), "merchant_id", 10)


_FIRST_LAST = "SELECT user_id, " + ", ".join(f"arg_{m}({c}, (ts, txn_id)) AS {n}_{c}" for n, m in (("first", "min"), ("last", "max")) for c in ("txn_id", "cents", "channel")) + " FROM tx GROUP BY user_id"


@_query("AG11_first_last_rows", _FIRST_LAST)
def _(spark, d):
    return aggregates.first_last_rows(_tx(spark, d), "user_id", "ts", "txn_id", ["txn_id", "cents", "channel"])


@_query("AG12_count", "SELECT count(*) AS n FROM lineitem")
def _(spark, d):
    return tables.read(spark, d, "lineitem").agg(F.count(F.lit(1)).alias("n"))


@_query("AG13_frequency_features", FREQUENCY_SQL)
def _(spark, d):
    return features.frequency_features(_tx(spark, d), AS_OF)


@_query("AG14_amount_features", f"SELECT x.* FROM ({AMOUNT_SQL}) AS x, (SELECT 1 FROM tx LIMIT 1) AS one")
def _(spark, d):
    return features.amount_features_exact(_tx(spark, d), AS_OF)


@_query("AG15_device_features", DEVICE_SQL)
def _(spark, d):
    return features.device_features(_tx(spark, d), AS_OF)


@_query("JN23_assemble_aspects", WIDE_SQL % "")
def _(spark, d):
    t = _tx(spark, d)
    return features.assemble(features.frequency_features(t, AS_OF), features.amount_features_exact(t, AS_OF), features.device_features(t, AS_OF))


@_query("JN24_device_join", f"SELECT x.* FROM ({DEVICE_SQL}) AS x, (SELECT 1 FROM tx LIMIT 1) AS one")
def _(spark, d):
    t = _tx(spark, d)
    return features.distinct_devices(t, AS_OF).join(features.first_last_devices(t, AS_OF), "user_id", "left")


@_query("AG16_feature_pipeline", WIDE_SQL % ", DATE '2024-01-31' AS compute_dt")
def _(spark, d):
    return features.feature_pipeline(_tx(spark, d), AS_OF)


# ---------------------------------------------------------------------------------------------- windows, sorts, sets


@_query("WN1_first_by_window", "SELECT user_id, txn_id, first_value(channel) OVER (PARTITION BY user_id ORDER BY ts, txn_id) AS first_channel FROM tx")
def _(spark, d):
    return aggregates.first_by_window(_tx(spark, d).select("user_id", "txn_id", "ts", "channel"), "user_id", "channel", "ts", "txn_id").select("user_id", "txn_id", "first_channel")


@_query("WN2_last_by_window", "SELECT user_id, txn_id, last_value(channel) OVER (PARTITION BY user_id ORDER BY ts, txn_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_channel FROM tx")
def _(spark, d):
    return aggregates.last_by_window(_tx(spark, d).select("user_id", "txn_id", "ts", "channel"), "user_id", "channel", "ts", "txn_id").select("user_id", "txn_id", "last_channel")


_TOP = "SELECT * FROM (SELECT hot_user, txn_id, cents, CAST(row_number() OVER (PARTITION BY hot_user ORDER BY cents DESC, txn_id) AS INTEGER) AS rn FROM tx) WHERE rn <= 5"


@_query("WN3_top_rows", _TOP)
def _(spark, d):
    return aggregates.top_rows(_tx(spark, d).select("hot_user", "txn_id", "cents"), "hot_user", "cents", "txn_id")


@_query("WN4_top_rows_in_stages", _TOP)
def _(spark, d):
    return aggregates.top_rows_in_stages(_tx(spark, d).select("hot_user", "txn_id", "cents"), "hot_user", "cents", "txn_id")


@_query("WN5_first_last_without_window", "SELECT user_id, arg_min(channel, (ts, txn_id)) AS first_channel, arg_max(channel, (ts, txn_id)) AS last_channel FROM tx GROUP BY user_id")
def _(spark, d):
    return aggregates.first_last_rows(_tx(spark, d), "user_id", "ts", "txn_id", ["channel"])


@_query("SL1_order_limit", "SELECT txn_id, cents FROM tx ORDER BY cents DESC, txn_id LIMIT 100")
def _(spark, d):
    return _tx(spark, d).select("txn_id", "cents").orderBy(F.desc("cents"), "txn_id").limit(100)


@_query("SO1_union_by_name", "SELECT user_id, cents FROM tx WHERE cents < 5000 UNION ALL SELECT user_id, cents FROM tx WHERE cents > 2000")
def _(spark, d):
    t = _tx(spark, d)
    return t.where("cents < 5000").select("user_id", "cents").unionByName(t.where("cents > 2000").select("cents", "user_id"))


@_query("PT3_hot_key_partitions", "SELECT hot_user, count(*) AS n FROM tx GROUP BY hot_user")
def _(spark, d):
    return partitioning.deal_hot_keys(_tx(spark, d).select("hot_user"), "hot_user", [0], 8).groupBy("hot_user").agg(F.count(F.lit(1)).alias("n"))


@_query("PT4_partition_sizes", "SELECT hot_user = 0 AS hot, count(*) AS rows FROM tx GROUP BY hot_user = 0")
def _(spark, d):
    sizes = partitioning.partition_sizes(partitioning.deal_hot_keys(_tx(spark, d), "hot_user", [0], 8), 9)
    return sizes.groupBy((F.col("part") == 8).alias("hot")).agg(F.sum("rows").alias("rows"))


@_query("PT5_partitioners_compared", "SELECT label, (SELECT count(*) FROM tx) AS rows, mixed FROM (VALUES ('hash', CAST(1 AS BIGINT)), ('hot keys apart', CAST(0 AS BIGINT))) AS l(label, mixed)")
def _(spark, d):
    return partitioning.compare_partitioners(_tx(spark, d).select("hot_user"), "hot_user", [0], 4).select("label", "rows", "mixed")


@_query("SL2_largest_partitions", "SELECT CAST(8 AS INTEGER) AS part, count(*) AS rows FROM tx WHERE hot_user = 0")
def _(spark, d):
    return partitioning.largest_partitions(partitioning.deal_hot_keys(_tx(spark, d).select("hot_user"), "hot_user", [0], 8), 1)


@_query("PT1_round_robin", "SELECT CAST(8 AS BIGINT) AS parts, count(*) AS rows FROM tx")
def _(spark, d):
    dealt = partitioning.round_robin(_tx(spark, d).select("txn_id"), 8)
    return dealt.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("rows"))


@_query("PT2_clustered", "SELECT hot_user, CAST(1 AS BIGINT) AS parts, count(*) AS rows FROM tx GROUP BY hot_user")
def _(spark, d):
    dealt = partitioning.cluster(_tx(spark, d).select("hot_user"), ["hot_user"], 8).withColumn("part", F.spark_partition_id())
    return dealt.groupBy("hot_user", "part").agg(F.count(F.lit(1)).alias("n")).groupBy("hot_user").agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("rows"))


@_query("FN_row_numbers", "SELECT count(*) AS rows, count(*) AS numbers FROM tx")
def _(spark, d):
    return partitioning.numbered(_tx(spark, d).select("txn_id")).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("row_id").alias("numbers"))


# ---------------------------------------------------------------------------------------------- sinks: written, and read back

_ROWS = "SELECT txn_id, cents, dt FROM tx"


def _day_rows(spark, d) -> DataFrame:
    return _tx(spark, d).select("txn_id", "cents", "dt")


def _sink(name: str, write, sql: str = _ROWS):
    """Registers a sink: ``write(spark, rows, path)``, then all that is found there."""

    def run(spark, d):
        path = scratch_path(spark, name.lower())
        write(spark, _day_rows(spark, d), path)
        return spark.read.parquet(path).select("txn_id", "cents", "dt")

    return _query(name, sql)(run)


def _again(df: DataFrame) -> DataFrame:
    """The rows of one day, a cent dearer."""
    return df.where("dt = date '2024-01-10'").withColumn("cents", F.col("cents") + 1)


def _overwrite(spark, rows, path):
    writer.write_parquet(_again(rows), path)
    writer.write_parquet(rows, path)


def _overwrite_day(spark, rows, path):
    writer.write_overwriting_partitions(rows, path, ["dt"])
    writer.write_overwriting_partitions(_again(rows), path, ["dt"])


def _compact(spark, rows, path):
    writer.write_fanned_out(rows.repartition(6), path, ["dt"])
    done = layout.compact(spark, path, ["dt"])
    if done is None or done.after.files >= done.before.files:
        raise AssertionError("compaction left as many files")


def _swap(spark, rows, path):
    writer.write_parquet(_again(rows), path)
    writer.write_parquet(rows, f"{path}._staging")
    layout.swap(spark, path, f"{path}._staging")


_sink("SNK1_overwrite", _overwrite)
_sink("SNK2_partitioned_snappy", lambda s, r, p: writer.write_partitioned(r, p, ["dt"], compression="snappy"))
_sink("SNK5_fanned_out", lambda s, r, p: writer.write_fanned_out(r, p, ["dt"]))
_sink("SNK6_clustered", lambda s, r, p: writer.write_clustered(r, p, ["dt"]))
_sink("SNK7_partition_overwrite", _overwrite_day, "SELECT txn_id, CASE WHEN dt = DATE '2024-01-10' THEN cents + 1 ELSE cents END AS cents, dt FROM tx")
_sink("SNK8_partitioned", lambda s, r, p: writer.write_partitioned(r, p, ["dt"], files_per_partition=3))
_sink("SNK9_target_size", lambda s, r, p: writer.write_with_target_size(r, p))
_sink("SNK14_compacted", _compact)
_sink("SNK15_swapped", _swap)


@_query("SNK3_feature_table", WIDE_SQL % ", DATE '2024-01-31' AS compute_dt")
def _(spark, d):
    path = scratch_path(spark, "features")
    writer.write_features(features.feature_pipeline(_tx(spark, d), AS_OF), path)
    return spark.read.parquet(path)


@_query("SNK4_bucketed_write", "SELECT user_id, count(*) AS rows FROM tx GROUP BY user_id")
def _(spark, d):
    return spark.table(_bucketed_txns(spark, d)).groupBy("user_id").agg(F.count(F.lit(1)).alias("rows"))


_SIZES = (0, 1, 192 << 20, (192 << 20) + 1, 1 << 40)


@_query("SNK10_partitions_for_bytes", f"SELECT bytes, CAST(greatest(1, ceil(bytes / {192 << 20}.0)) AS BIGINT) AS n FROM (VALUES {', '.join(f'(CAST({b} AS BIGINT))' for b in _SIZES)}) AS s(bytes)")
def _(spark, d):
    return spark.createDataFrame([(b, writer.partitions_for_bytes(b)) for b in _SIZES], "bytes long, n long")


@_query("SNK11_partitions_for_rows", f"SELECT rows, CAST(greatest(1, ceil(rows * 256 / {192 << 20}.0)) AS BIGINT) AS n FROM (SELECT count(*) AS rows FROM tx)")
def _(spark, d):
    n = _tx(spark, d).count()
    return spark.createDataFrame([(n, writer.partitions_for_rows(n, 256))], "rows long, n long")


@_query("SNK12_dealt_for_write", "SELECT dt, count(*) AS rows, true AS few FROM tx GROUP BY dt")
def _(spark, d):
    dealt = writer.repartition_for_write(_day_rows(spark, d), ["dt"], 3).withColumn("part", F.spark_partition_id())
    return dealt.groupBy("dt", "part").agg(F.count(F.lit(1)).alias("n")).groupBy("dt").agg(F.sum("n").alias("rows"), (F.count(F.lit(1)) <= 3).alias("few"))


@_query("SNK13_file_sizes", "SELECT CAST(5 AS BIGINT) AS files, CAST(5 AS BIGINT) AS small_files, 1.0::DOUBLE AS small_ratio, true AS ordered FROM (SELECT 1 FROM tx LIMIT 1)")
def _(spark, d):
    path = scratch_path(spark, "five")
    _day_rows(spark, d).repartition(5).write.parquet(path)
    s = layout.analyze(spark, path)
    ordered = 0 < s.least <= s.p50 <= s.p95 <= s.most and s.total_bytes >= s.files * s.least
    return spark.createDataFrame([(s.files, s.small_files, s.small_ratio, ordered)], "files long, small_files long, small_ratio double, ordered boolean")


_MADE = config.Settings(users=500, merchants=40, devices=60, transactions=4_000)
_MADE_ROWS = {"dim_users": 500, "dim_merchants": 40, "dim_devices": 60, "dim_mcc": 100, "fact_transactions": 4_000}
_MADE_SQL = f"SELECT * FROM (VALUES {', '.join(f'({n!r}, CAST({r} AS BIGINT))' for n, r in _MADE_ROWS.items())}) AS t(name, rows)"


def _made(spark) -> tuple[str, dict[str, str]]:
    base = scratch_path(spark, "made")
    return base, synthetic.generate_all(spark, dataclasses.replace(_MADE, base_path=base), AS_OF)


def _counted(spark, paths: dict[str, str]) -> DataFrame:
    out = None
    for name, path in paths.items():
        one = spark.read.parquet(path).agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("rows"))
        out = one if out is None else out.unionByName(one)
    return out


@_query("SRC7_generated", _MADE_SQL)
def _(spark, d):
    return _counted(spark, _made(spark)[1])


@_query("SNK16_all_compacted", _MADE_SQL)
def _(spark, d):
    base, paths = _made(spark)
    layout.compact_all(spark, base)
    return _counted(spark, paths)


@_query("SNK17_plan_file", "SELECT true AS scans, true AS joins FROM (SELECT 1 FROM tx LIMIT 1)")
def _(spark, d):
    path = dump_plan(joins.sort_merge_join(_fact(spark, d), _dim(spark, d), "null_user"), scratch_path(spark, "plans"), "join")
    text = F.concat_ws(" ", F.collect_list("value"))
    return spark.read.text(path).agg(text.contains("Scan parquet").alias("scans"), text.contains("SortMergeJoin").alias("joins"))


# ---------------------------------------------------------------------------------------------- operations


@_query("OPS1_recommended_settings", f"SELECT * FROM (VALUES {', '.join(f'({k!r}, {v!r})' for k, v in sorted(RECOMMENDED.items()))}) AS t(key, value)")
def _(spark, d):
    mine = spark.newSession()  # the caller's settings stay as they are
    apply_preset(mine, "recommended")
    found = [(r.key, r.value) for r in dump_confs(mine, ("spark.sql.",)).collect() if r.key in RECOMMENDED]
    return spark.createDataFrame(found, "key string, value string")


@_query("OPS5_cached", "SELECT count(*) AS rows, true AS held, false AS after FROM tx")
def _(spark, d):
    manager, name = CacheManager(spark), "rows"
    df = manager.persist(_day_rows(spark, d), name, "disk")
    rows, held = df.count(), df.storageLevel.useDisk
    manager.unpersist_all()
    return spark.createDataFrame([(rows, held, df.is_cached)], "rows long, held boolean, after boolean")


@_query("OPS7_lineage_cut", _ROWS)
def _(spark, d):
    shared_dir(spark)
    return CacheManager(spark).truncate_lineage(_day_rows(spark, d))


_TASKS = [(1, 10, 5), (1, 30, 5), (1, 10, 5), (2, 0, 0)]


@_query("OPS8_stage_metrics", "SELECT stage, count(*) AS tasks, CAST(max(ms) AS BIGINT) AS max_ms, CAST(sum(records) AS BIGINT) AS records FROM (VALUES (1, 10, 5), (1, 30, 5), (1, 10, 5), (2, 0, 0)) AS t(stage, ms, records) GROUP BY stage")
def _(spark, d):
    path = scratch_path(spark, "log")
    task = F.to_json(F.struct(F.lit("SparkListenerTaskEnd").alias("Event"), F.col("stage").alias("Stage ID"), F.lit(0).alias("Stage Attempt ID"), F.struct(F.col("ms").alias("Executor Run Time"), F.struct(F.col("records").alias("Records Read")).alias("Input Metrics")).alias("Task Metrics")))
    spark.createDataFrame(_TASKS, "stage int, ms long, records long").select(task.alias("value")).write.text(path)
    return stage_metrics(spark, path).select("stage", "tasks", "max_ms", "records")


@_query("OPS11_codegen_limit", "SELECT '8000' AS inside, true AS back FROM (SELECT 1 FROM tx LIMIT 1)")
def _(spark, d):
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name, None)
    with set_codegen_limit(spark, 8000):
        inside = spark.conf.get(name)
    return spark.createDataFrame([(inside, spark.conf.get(name, None) == before)], "inside string, back boolean")


@_query("UD5_counted_naively", "SELECT count(*) AS rows FROM tx")
def _(spark, d):
    return spark.createDataFrame([(batch.count_naively(_day_rows(spark, d)),)], "rows long")


@_query("UD6_counted_once", "SELECT count(*) AS rows FROM tx")
def _(spark, d):
    return spark.createDataFrame([(batch.count_once(_day_rows(spark, d)),)], "rows long")


@_query("UD7_observed", "SELECT count(*) AS rows FROM tx")
def _(spark, d):
    seen = batch.observed_count(_day_rows(spark, d), lambda df: df.write.format("noop").mode("overwrite").save())
    return spark.createDataFrame([(seen,)], "rows long")


# ---------------------------------------------------------------------------------------------- Python functions


@_query("UD1_predicate", "SELECT txn_id FROM tx WHERE amount > 250.0")
def _(spark, d):
    return _tx(spark, d).where(predicates.vector_gt("amount", 250.0)).select("txn_id")


@_query("UD2_lookup", LEFT_SQL)
def _(spark, d):
    return joins.mapped_lookup(_fact(spark, d), _dim(spark, d), "null_user", "name").select("null_user", "txn_id", "cents", "name")


_SCORES = "SELECT txn_id, 7 * txn_id + 3 AS score FROM tx"


@_query("UD3_score_rows", _SCORES)
def _(spark, d):
    return batch.score_rows(_tx(spark, d).select("txn_id"), "txn_id")


@_query("UD4_score_batches", _SCORES)
def _(spark, d):
    return batch.score_batches(_tx(spark, d).select("txn_id"), "txn_id")


@_query("FN_number_of_text", "SELECT txn_id, TRY_CAST(device_id AS BIGINT) AS device FROM tx")
def _(spark, d):
    return _tx(spark, d).select("txn_id", number("device_id").alias("device"))


__all__ = ["oracle_sql", "queries"]
