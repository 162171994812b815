"""Scoring by an outside client, a batch at a time, and counters that survive retries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import AccumulatorParam
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

BATCH = 256


class Client:
    """The scoring rule of the demonstration, 7 x + 3; stands for a connection that is costly to open."""

    def __init__(self):
        self.open = True

    def score(self, xs: list[int]) -> list[int]:
        if not self.open:
            raise RuntimeError("the client is closed")
        return [7 * x + 3 for x in xs]

    def close(self) -> None:
        self.open = False


def score_rows(df: DataFrame, col: str, name: str = "score") -> DataFrame:
    """Row values through an Arrow function, no client held."""

    @F.pandas_udf("long")
    def rule(x: pd.Series) -> pd.Series:
        return 7 * x + 3

    return df.withColumn(name, rule(col))


def score_batches(df: DataFrame, col: str, name: str = "score", size: int = BATCH, client: Callable[[], Client] = Client) -> DataFrame:
    """One client per partition, asked for ``size`` values at a time, closed once its partition has been read."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine = client()
        try:
            for frame in frames:
                found: list[int] = []
                values = frame[col].tolist()
                for k in range(0, len(values), size):
                    found += mine.score(values[k : k + size])
                yield frame.assign(**{name: pd.Series(found, index=frame.index, dtype="int64")})
        finally:
            mine.close()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(run, f"{fields}, `{name}` long")


class OncePerPartition(AccumulatorParam):
    """Sums of {(stage, partition): value}: a task that runs again overwrites its own entry, so it counts once."""

    def zero(self, value: dict) -> dict:
        return {}

    def addInPlace(self, a: dict, b: dict) -> dict:
        a.update(b)
        return a


def _counted(df: DataFrame, add: Callable[[int], None]) -> None:
    """Calls ``add`` with the rows of each partition: lengths of Arrow batches, no row is turned into an object."""

    def each(batches):
        add(sum(b.num_rows for b in batches))
        yield from ()

    df.select(F.lit(1).alias("one")).mapInArrow(each, "one int").write.format("noop").mode("overwrite").save()


def count_naively(df: DataFrame) -> int:
    """A counter in a transformation; rows of tasks that run twice count twice."""
    counter = df.sparkSession.sparkContext.accumulator(0)
    _counted(df, lambda n: counter.add(n))
    return counter.value


def count_once(df: DataFrame) -> int:
    """The same count, each partition once however often it runs."""
    from pyspark import TaskContext

    counter = df.sparkSession.sparkContext.accumulator({}, OncePerPartition())

    def add(n: int) -> None:
        task = TaskContext.get()
        counter.add({(task.stageId(), task.partitionId()): n})

    _counted(df, add)
    return sum(counter.value.values())


def observed_count(df: DataFrame, action: Callable[[DataFrame], object]) -> int:
    """Rows that ``action`` (which must read all of df) saw, as Spark's own metric."""
    seen = Observation("rows")
    action(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return seen.get["n"]
