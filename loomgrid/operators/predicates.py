"""Predicates that reach the Parquet scan."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise


def truncated_gt(col: str, n: int) -> Column:
    """``int(col) > n`` as a comparison on the raw double, which a scan can use.

    int(x) > n holds for x >= n + 1 if n >= 0, and for x > n otherwise. NaN is out, where a cast would raise.
    """
    x = F.col(col)
    return (x >= float(n + 1) if n >= 0 else x > float(n)) & ~F.isnan(x)


def opaque_gt(col: str, limit: float) -> Column:
    """The same comparison as a Python function: no scan can use it. Kept to compare plans."""
    return F.udf(lambda x: x is not None and x > limit, "boolean")(F.col(col))


def vector_gt(col: str, limit: float) -> Column:
    """The same as a vectorised function: batches of values cross to Python, not one at a time; null is not above."""

    @F.pandas_udf("boolean")
    def above(x: pd.Series) -> pd.Series:
        return x.gt(limit)

    return above(F.col(col))


def wide_projection(df: DataFrame, col: str, n: int) -> DataFrame:
    """n derived columns in one projection, not n nested ones."""
    x = F.col(col)
    return df.withColumns({f"{col}_{i}": F.when(x > i, x + i).otherwise(x - i) for i in range(n)})


def wide_projection_in_steps(df: DataFrame, col: str, n: int, step: int = 100, barrier: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The same columns in projections of ``step`` columns, each small enough to be compiled.

    Without a barrier the optimizer folds the steps into one again: by default each is written to the shared folder.
    """
    barrier = barrier or (lambda x: materialise(x, "step"))
    x = F.col(col)
    for lo in range(0, n, step):
        df = df.withColumns({f"{col}_{i}": F.when(x > i, x + i).otherwise(x - i) for i in range(lo, min(n, lo + step))})
        if lo + step < n:
            df = barrier(df)
    return df
