"""Helpers that several corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Hashable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


_KEPT: dict[Hashable, Any] = {}


def kept(key: Hashable, build: Callable[[], Any]) -> Any:
    """What ``build`` makes, kept by a Python worker until it needs something else.

    Workers live on from one job to the next; one model at a time bounds their
    memory whatever ran before.
    """
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = build()
    return _KEPT[key]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def col(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col(f"`{name.replace('`', '``')}`")


def any_text(name: str) -> Column:
    """The text of a column, empty where it is null."""
    return F.coalesce(col(name).cast("string"), F.lit(""))
