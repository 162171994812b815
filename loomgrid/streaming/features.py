"""An extension beyond the batch features: the frequency counts of a stream, in tumbling windows with late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.features import FAIL, SUCCESS


def windowed_frequency(events: DataFrame, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """user_id, window_start, txn_cnt, txn_succ_cnt, txn_fail_cnt; rows later than ``late`` are left out.

    The state is a row per user and open window; the same function takes a batch, where nothing is late.
    """
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark("ts", late)
    out = rows.groupBy("user_id", F.window("ts", window).alias("w")).agg(F.count(F.lit(1)).alias("txn_cnt"), F.count_if(F.col("event_type").isin(*SUCCESS)).alias("txn_succ_cnt"), F.count_if(F.col("event_type").isin(*FAIL)).alias("txn_fail_cnt"))
    return out.select("user_id", F.col("w.start").alias("window_start"), "txn_cnt", "txn_succ_cnt", "txn_fail_cnt")
