"""Unions, ordered distinct values, differences and keyed upserts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entitystats.session import join_per_key
from entitystats.skew import Timeline, as_list


def union_all(*frames: DataFrame) -> DataFrame:
    """Union by column name; columns absent from one side are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def ordered_distinct(df: DataFrame, key: str | Sequence[str], position: str) -> DataFrame:
    """Distinct keys with the first position at which each occurs."""
    return df.groupBy(*as_list(key)).agg(F.min(position).alias(position))


def difference(left: DataFrame, right: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Rows of ``left`` whose key does not occur in ``right``."""
    return left.join(right.select(*as_list(key)).distinct(), as_list(key), "left_anti")


def subset(left: DataFrame, right: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Rows of ``left`` whose key occurs in ``right``."""
    return left.join(right.select(*as_list(key)).distinct(), as_list(key), "left_semi")


def upsert(current: DataFrame, incoming: DataFrame, key: str | Sequence[str], sequence: str | None = None) -> DataFrame:
    """Current rows replaced or extended by incoming ones, last put wins.

    ``sequence`` orders several incoming rows of one key. The choice is an
    aggregate per key, so copies combine before the shuffle.
    """
    key = as_list(key)
    rest = [c for c in current.columns if c not in key]
    order = F.struct(F.lit(0).alias("batch"), F.lit(None).cast("bigint").alias("seq"))
    new_order = F.struct(F.lit(1).alias("batch"), (F.col(sequence).cast("bigint") if sequence else F.lit(0).cast("bigint")).alias("seq"))
    both = current.select(*key, F.struct(*rest).alias("__row"), order.alias("__at")).unionByName(
        incoming.select(*key, F.struct(*rest).alias("__row"), new_order.alias("__at"))
    )
    return both.groupBy(*key).agg(F.max_by("__row", "__at").alias("__row")).select(*key, "__row.*")


def duplicate_groups(df: DataFrame, key: str | Sequence[str], ident: str, ts: str) -> DataFrame:
    """Repeated keys: number of rows, the id to keep (newest) and its time."""
    at = F.struct(F.col(ts), F.col(ident))
    return (
        df.groupBy(*as_list(key))
        .agg(F.count(F.lit(1)).alias("copies"), F.max_by(ident, at).alias("keep_id"))
        .filter("copies > 1")
    )


def surplus_rows(df: DataFrame, key: str | Sequence[str], ident: str, ts: str) -> DataFrame:
    """The rows to delete: every row of a repeated key except the newest."""
    groups = duplicate_groups(df, key, ident, ts).select(*as_list(key), "keep_id")
    return join_per_key(df, groups, as_list(key)).filter(F.col(ident) != F.col("keep_id")).drop("keep_id")


def keyset_page(df: DataFrame, ident: str, after: int, size: int) -> DataFrame:
    """Next page in id order: the filter reaches the scan, the order is a top-n."""
    return df.filter(F.col(ident) > after).orderBy(ident).limit(size)


def page(df: DataFrame, order: Sequence, offset: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """(page of rows, one-row total)."""
    return df.orderBy(*order).offset(offset).limit(limit), df.agg(F.count(F.lit(1)).alias("total"))


def keep_newest(df: DataFrame, group: str | Sequence[str], ts: str, keep: int, tie: Sequence[str] = (), max_rows: int | None = None) -> DataFrame:
    """Rows beyond the newest ``keep`` of each group (the ones to delete).

    A row goes if at least ``keep`` rows of its group come after it; a hot group
    is counted over slices.
    """
    one = F.lit(1)
    line = Timeline(df, group, [ts, *tie], max_rows).running(__upto=("count", one, True)).totals(__n=("count", one))
    return line.result().filter(F.col("__n") - F.col("__upto") >= keep).drop("__upto", "__n")


def common_columns(names: Sequence[str], df: DataFrame) -> list[str]:
    """Selected names that the table has, in the order of the selection."""
    return [n for n in names if n in df.columns]
