"""Tables written batch by batch that stay cheap to read.

Batch N lies in ``<table>/batch=N``. Whenever ``fold`` batches are complete they
are folded into one part that holds the last row per key, ``fold`` such parts
into one of the next level, and so on; the folded parts lie below
``<table>_levels``. A reader takes the largest complete parts first and opens at
most ``fold - 1`` folders a level, so what it opens grows with the logarithm of
the number of batches, and its rows with the number of keys.

Folding is derived from the batches and repeats them: it runs at the end of the
batch that completes a part, a part counts only once Spark has marked it
complete, and a batch that runs again writes the same part again. As in
Structured Streaming, only the newest batch may run again.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entitystats.skew import as_list

#: Batches, or parts of a level, that make one part of the next level.
FOLD = 8


def found(spark: SparkSession, pattern: str) -> list[str]:
    """Files and folders that fit a pattern."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = hadoop.Path(pattern)
    hits = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return [f.getPath().toString() for f in hits or []]


def write_batch(df: DataFrame, base: str, table: str, batch: int) -> None:
    """Write a batch in place of what an earlier run of it wrote."""
    df.write.mode("overwrite").parquet(f"{base}/{table}/batch={batch}")


def parts(spark: SparkSession, base: str, table: str, before: int | None = None, fold: int = FOLD) -> list[str]:
    """Folders that together hold every batch (before one, if given), the fewest there are."""
    numbers = {int(m[1]) for p in found(spark, f"{base}/{table}/batch=*") if (m := re.search(r"batch=(\d+)$", p))}
    numbers = {n for n in numbers if before is None or n < before}
    folded = set()
    for p in found(spark, f"{base}/{table}_levels/level=*/last=*/_SUCCESS"):
        level, last = map(int, re.search(r"level=(\d+)/last=(\d+)/_SUCCESS$", p).groups())
        folded.add((level, last))
    top = max((level for level, _ in folded), default=0)
    out, at = [], max(numbers, default=-1)
    while at >= 0:
        level = next((n for n in range(top, 0, -1) if (n, at) in folded), 0)
        if level:
            out.append(f"{base}/{table}_levels/level={level}/last={at}")
            at -= fold**level
        else:
            if at in numbers:
                out.append(f"{base}/{table}/batch={at}")
            at -= 1
    return out


def read_parts(spark: SparkSession, base: str, table: str, folders: Sequence[str]) -> DataFrame | None:
    """Rows of some folders, each with its ``batch``."""
    raw = [f for f in folders if "_levels/" not in f]
    folded = [f for f in folders if "_levels/" in f]
    rows = [spark.read.option("basePath", f"{base}/{table}").parquet(*raw).withColumn("batch", F.col("batch").cast("long"))] if raw else []
    rows += [spark.read.parquet(*folded)] if folded else []
    if len(rows) == 2:
        return rows[0].unionByName(rows[1])
    return rows[0] if rows else None


def batches(spark: SparkSession, base: str, table: str, before: int | None = None) -> DataFrame | None:
    """Every row of all batches (before one, if given); None when there are none."""
    folders = found(spark, f"{base}/{table}/batch=*")
    folders = [p for p in folders if before is None or int(p.rsplit("=", 1)[1]) < before]
    return read_parts(spark, base, table, folders)


def last_rows(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row per key, with its ``batch``."""
    rest = [c for c in rows.columns if c not in keys]
    at = F.struct(*[F.col(c) for c in order])
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), at).alias("r")).select(*keys, "r.*")


def current(spark: SparkSession, base: str, table: str, keys: str | Sequence[str], order: Sequence[str] = ("batch",), before: int | None = None) -> DataFrame:
    """Last written row per key."""
    rows = read_parts(spark, base, table, parts(spark, base, table, before))
    if rows is None:
        raise FileNotFoundError(f"{base}/{table} has no batches")
    return last_rows(rows, as_list(keys), order).drop("batch")


def fold(spark: SparkSession, base: str, table: str, keys: str | Sequence[str], batch: int, order: Sequence[str] = ("batch",), width: int = FOLD) -> None:
    """Fold the parts that this batch completes; call it when the batch is written."""
    level = 1
    while (batch + 1) % width**level == 0:
        below = width ** (level - 1)
        ends = [batch - i * below for i in range(width)]
        source = [f"{base}/{table}/batch={n}" if level == 1 else f"{base}/{table}_levels/level={level - 1}/last={n}" for n in ends]
        rows = last_rows(read_parts(spark, base, table, source), as_list(keys), order)
        rows.write.mode("overwrite").parquet(f"{base}/{table}_levels/level={level}/last={batch}")
        level += 1
