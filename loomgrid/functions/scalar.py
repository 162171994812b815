"""Small column functions shared by operators and queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cents(amount: str) -> Column:
    """An amount of two decimals as an integer."""
    return F.round(F.col(amount) * 100).cast("long")


def number(text: str, kind: str = "bigint") -> Column:
    """Text as a number; null where it is none."""
    return F.col(text).try_cast(kind)


def days_before(as_of: str, days: int) -> Column:
    return F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))
