"""Time-ordered splits and duplicate averaging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entitystats.skew import Timeline, whole_key


def _label(position: Column, n: Column, fractions: Sequence[float]) -> Column:
    """Half-even rounded sizes; what is left is the test part."""
    total = sum(fractions)
    if total == 0 or any(not 0.0 <= f <= 1.0 for f in fractions):
        raise ValueError("fractions must be between 0 and 1 and not all zero")
    train = F.bround(n * F.lit(fractions[0] / total), 0)
    val = F.bround(n * F.lit(fractions[1] / total), 0)
    return F.when(position <= train, "train").when(position <= train + val, "val").otherwise("test")


def entity_time_split(
    df: DataFrame, entity, ts: str, tie: Sequence[str] = (), fractions: Sequence[float] = (0.7, 0.15, 0.15),
    max_rows: int | None = None,
) -> DataFrame:
    """Oldest rows of each entity to train, then val, newest to test."""
    line = Timeline(df, entity, [ts, *tie], max_rows)
    line = line.running(__i=("count", F.lit(1), True)).totals(__n=("count", F.lit(1)))
    return line.with_column("split", _label(F.col("__i"), F.col("__n"), fractions)).drop("__i", "__n").result()


def global_time_split(
    df: DataFrame, ts: str, tie: Sequence[str] = (), fractions: Sequence[float] = (0.7, 0.15, 0.15), max_rows: int | None = None
) -> DataFrame:
    """The same over the whole table; slices keep it from being one sort task."""
    return entity_time_split(df.withColumn("__all", whole_key(ts)), "__all", ts, tie, fractions, max_rows).drop("__all")


def dedupe_mean(df: DataFrame, keys: Sequence[str], value: str, name: str | None = None) -> DataFrame:
    """One row per key with the mean value."""
    return df.groupBy(*keys).agg(F.avg(value).alias(name or value))
