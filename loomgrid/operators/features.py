"""Behavioural features per user over trailing windows: each aspect is one aggregation, whatever the windows.

A window of w days holds the rows with as_of - w days <= ts <= as_of, both ends included, for every aspect. A user
without a row in a window keeps its line (counts 0, amounts null); users whose devices are all null have no line in
the device aspect.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import broadcast_join

WINDOWS = (1, 7, 30)
SUCCESS, FAIL = ("purchase",), ("error",)
RELATIVE_ERROR = 0.02
PERCENTS = (50, 95, 99)


def in_window(as_of: str, days: int, ts: str = "ts") -> Column:
    end = F.lit(as_of).cast("timestamp_ntz")
    return F.col(ts).between(end - F.make_dt_interval(F.lit(days)), end)


def values_of(txns: DataFrame, as_of: str, windows: Sequence[int], key: str, kinds: dict[str, Column]) -> DataFrame:
    """key, kind, value, n_<w>d: how often each value of each kind (a column, as text) occurs in each window.

    One narrow row per distinct value leaves a task, whatever the number of windows and of distinct counts asked for;
    a user without rows in any window keeps its rows with counts of 0.
    """
    pairs = F.array(*(F.struct(F.lit(k).alias("kind"), c.cast("string").alias("value")) for k, c in kinds.items()))
    rows = txns.select(key, "ts", F.explode(pairs).alias("_v")).select(key, "ts", "_v.kind", "_v.value")
    return rows.groupBy(key, "kind", "value").agg(*(F.count_if(in_window(as_of, w)).alias(f"n_{w}d") for w in windows))


# The columns below are written as SQL text: hundreds of small expressions cost a call to the JVM each otherwise.


def _of(kind: str, w: int) -> str:
    """Whether a row of ``values_of`` is a value of the kind that occurs in the window."""
    return f"kind = '{kind}' and value is not null and n_{w}d > 0"


def _among(values: Sequence[str]) -> str:
    return ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values) or "null"


def _times(condition: str, w: int) -> str:
    return f"sum(case when {condition} then n_{w}d else 0L end)"


FREQUENCY_KINDS = ("status", "merchant_id", "ip")
DEVICE_KINDS = {"distinct_devices": "device_id", "distinct_geos": "geo_hash", "distinct_ips_dev": "ip", "distinct_channels": "channel"}


def _frequency(windows: Sequence[int], success: Sequence[str], fail: Sequence[str]) -> list[Column]:
    out, status = [], "kind = 'status'"
    good, bad = (f"{status} and value in ({_among(x)})" for x in (success, fail))
    for w in windows:
        out += [
            f"{_times(status, w)} as txn_cnt_{w}d", f"{_times(good, w)} as txn_succ_cnt_{w}d", f"{_times(bad, w)} as txn_fail_cnt_{w}d",
            f"count_if({_of('merchant_id', w)}) as distinct_merchants_{w}d", f"count_if({_of('ip', w)}) as distinct_ips_{w}d",
        ]
    return [F.expr(x) for x in out]


def frequency_features(txns: DataFrame, as_of: str, windows: Sequence[int] = WINDOWS, success: Sequence[str] = SUCCESS, fail: Sequence[str] = FAIL, approximate: bool = False, key: str = "user_id") -> DataFrame:
    """Rows, successes, failures, distinct merchants and addresses per user and window."""
    if not approximate:
        return values_of(txns, as_of, windows, key, {k: F.col(k) for k in FREQUENCY_KINDS}).groupBy(key).agg(*_frequency(windows, success, fail))
    out = []
    for w in windows:
        here = in_window(as_of, w)
        out += [
            F.count_if(here).alias(f"txn_cnt_{w}d"),
            F.count_if(here & F.col("status").isin(*success)).alias(f"txn_succ_cnt_{w}d"),
            F.count_if(here & F.col("status").isin(*fail)).alias(f"txn_fail_cnt_{w}d"),
            F.approx_count_distinct(F.when(here, F.col("merchant_id")), RELATIVE_ERROR).alias(f"distinct_merchants_{w}d"),
            F.approx_count_distinct(F.when(here, F.col("ip")), RELATIVE_ERROR).alias(f"distinct_ips_{w}d"),
        ]
    return txns.groupBy(key).agg(*out)


def amount_features(txns: DataFrame, as_of: str, windows: Sequence[int] = WINDOWS, key: str = "user_id", amount: str = "amount") -> DataFrame:
    """Sum, mean, extremes, sample deviation and percentiles of the amount per user and window."""
    out = []
    for w in windows:
        x = F.when(in_window(as_of, w), F.col(amount))
        out += [
            F.sum(x).alias(f"amt_sum_{w}d"), F.avg(x).alias(f"amt_avg_{w}d"), F.min(x).alias(f"amt_min_{w}d"), F.max(x).alias(f"amt_max_{w}d"), F.stddev_samp(x).alias(f"amt_std_{w}d"),
            F.percentile_approx(x, [k / 100 for k in PERCENTS], 10_000).alias(f"_p{w}"),
        ]
    order = [f"amt_{k}_{w}d" for w in windows for k in ("sum", "avg", "min", "max", "std", *(f"p{p}" for p in PERCENTS))]
    return txns.groupBy(key).agg(*out).withColumns({f"amt_p{p}_{w}d": F.col(f"_p{w}")[k] for w in windows for k, p in enumerate(PERCENTS)}).select(key, *order)


def _ranked(values: DataFrame, windows: Sequence[int], key: str) -> DataFrame:
    """``values_of`` with the cents as a number, and for each window the occurrences up to it and of all cents."""
    cents = F.when(F.col("kind") == "cents", F.col("value").cast("long"))
    rows = values.withColumn("num", cents).withColumn("_some", F.col("num").isNotNull())
    upto = Window.partitionBy(key, "kind", "_some").orderBy("num").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(key, "kind", "_some")
    # by the key alone, so that neither the windows nor the aggregation after them shuffles again
    rows = rows.repartition(key)
    return rows.withColumns({f"up_{w}d": F.sum(f"n_{w}d").over(upto) for w in windows} | {f"of_{w}d": F.sum(f"n_{w}d").over(whole) for w in windows})


def _amounts(windows: Sequence[int]) -> list[Column]:
    out = []
    for w in windows:
        c = f"case when n_{w}d > 0 then num end"
        out += [f"sum(case when num is not null then n_{w}d end) as _n{w}", f"sum(n_{w}d * num) as _s{w}", f"sum(n_{w}d * num * num) as _q{w}", f"min({c}) as _lo{w}", f"max({c}) as _hi{w}"]
        out += [f"min(case when n_{w}d > 0 and up_{w}d * 100 >= of_{w}d * {p} then num end) as _p{p}_{w}" for p in PERCENTS]
    return [F.expr(x) for x in out]


def _amount_columns(windows: Sequence[int]) -> list[Column]:
    out = []
    for w in windows:
        n, s, q = (f"double(_{k}{w})" for k in "nsq")
        some = f"case when _n{w} > 0 then"
        out += [
            f"{some} {s} / 100 end as amt_sum_{w}d", f"{some} {s} / 100 / {n} end as amt_avg_{w}d", f"double(_lo{w}) / 100 as amt_min_{w}d", f"double(_hi{w}) / 100 as amt_max_{w}d",
            f"case when _n{w} > 1 then sqrt(({q} - {s} * {s} / {n}) / ({n} - 1)) / 100 end as amt_std_{w}d",
            *(f"double(_p{p}_{w}) / 100 as amt_p{p}_{w}d" for p in PERCENTS),
        ]
    return [F.expr(x) for x in out]


def amount_features_exact(txns: DataFrame, as_of: str, windows: Sequence[int] = WINDOWS, key: str = "user_id", cents: str = "cents") -> DataFrame:
    """The same features over integer cents: sums, and what follows from them, do not depend on the order of rows.

    Percentiles are exact, whatever the size of a group: they are read off the running counts of distinct cents.
    """
    values = values_of(txns, as_of, windows, key, {"cents": F.col(cents)})
    return _ranked(values, windows, key).groupBy(key).agg(*_amounts(windows)).select(key, *_amount_columns(windows))


def _devices(windows: Sequence[int]) -> list[Column]:
    """Distinct counts over rows with a device; null for users who have none."""
    some = "count_if(kind = 'dev_device_id' and value is not null) > 0"
    return [F.expr(f"case when {some} then count_if({_of(f'dev_{c}', w)}) end as {name}_{w}d") for w in windows for name, c in DEVICE_KINDS.items()]


def _device_kinds() -> dict[str, Column]:
    has = F.col("device_id").isNotNull()
    return {f"dev_{c}": F.when(has, F.col(c).cast("string")) for c in DEVICE_KINDS.values()}


def first_last_devices(txns: DataFrame, as_of: str, windows: Sequence[int] = WINDOWS, key: str = "user_id", tie: str = "txn_id") -> DataFrame:
    """The first and last device within the longest window, by ``min_by`` and ``max_by``: no window function, no sort of
    whole groups. Users without a device have no line."""
    longest = max(windows)
    when = F.when(in_window(as_of, longest), F.struct("ts", tie))
    rows = txns.where(F.col("device_id").isNotNull()).groupBy(key)
    return rows.agg(F.min_by("device_id", when).alias(f"first_device_{longest}d"), F.max_by("device_id", when).alias(f"last_device_{longest}d"))


def distinct_devices(txns: DataFrame, as_of: str, windows: Sequence[int] = WINDOWS, approximate: bool = False, key: str = "user_id") -> DataFrame:
    """Distinct devices, places, addresses and channels over rows with a device."""
    rows = txns.where(F.col("device_id").isNotNull())
    if not approximate:
        return values_of(rows, as_of, windows, key, _device_kinds()).groupBy(key).agg(*_devices(windows))
    out = []
    for w in windows:
        out += [F.approx_count_distinct(F.when(in_window(as_of, w), F.col(c)), RELATIVE_ERROR).alias(f"{name}_{w}d") for name, c in DEVICE_KINDS.items()]
    return rows.groupBy(key).agg(*out)


def device_features(txns: DataFrame, as_of: str, windows: Sequence[int] = WINDOWS, approximate: bool = False, key: str = "user_id", tie: str = "txn_id") -> DataFrame:
    """The distinct counts, and the first and last device joined to them; both sides are dealt by the key already."""
    return distinct_devices(txns, as_of, windows, approximate, key).join(first_last_devices(txns, as_of, windows, key, tie), key, "left")


def enrich(txns: DataFrame, merchants: DataFrame, categories: DataFrame) -> DataFrame:
    """Facts with their merchant and its category; rows without either stay."""
    return txns.transform(lambda df: broadcast_join(df, merchants, "merchant_id")).transform(lambda df: broadcast_join(df, categories, "mcc"))


def assemble(frequency: DataFrame, amount: DataFrame, device: DataFrame, key: str = "user_id") -> DataFrame:
    """Full outer join of the aspects; all are dealt by the key already."""
    return frequency.join(amount, key, "outer").join(device, key, "outer")


def feature_pipeline(txns: DataFrame, as_of: str, windows: Sequence[int] = WINDOWS, exact: bool = True, approximate: bool = False, key: str = "user_id", success: Sequence[str] = SUCCESS, fail: Sequence[str] = FAIL) -> DataFrame:
    """The wide table of a user's features as of an instant.

    Exact: all counts, sums and percentiles come from one aggregation of distinct values, read once.
    """
    if exact and not approximate:
        kinds = {k: F.col(k) for k in FREQUENCY_KINDS} | {"cents": F.col("cents")} | _device_kinds()
        rows = _ranked(values_of(txns, as_of, windows, key, kinds), windows, key)
        wide = rows.groupBy(key).agg(*_frequency(windows, success, fail), *_amounts(windows), *_devices(windows))
        names = [f"{n}_{w}d" for w in windows for n in ("txn_cnt", "txn_succ_cnt", "txn_fail_cnt", "distinct_merchants", "distinct_ips")]
        devices = [f"{n}_{w}d" for w in windows for n in DEVICE_KINDS]
        wide = wide.select(key, *names, *_amount_columns(windows), *devices).join(first_last_devices(txns, as_of, windows, key), key, "left")
    else:
        amount = amount_features_exact(txns, as_of, windows) if exact else amount_features(txns, as_of, windows)
        wide = assemble(frequency_features(txns, as_of, windows, success, fail, approximate), amount, device_features(txns, as_of, windows, approximate))
    return wide.withColumn("compute_dt", F.to_date(F.lit(as_of)))
