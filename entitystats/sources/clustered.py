"""Tables laid out for point and range reads.

Rows are written in ranges of their keys, sorted within each file, and a small
table beside them holds every file's smallest and largest keys. A read looks up
the files that can hold matching rows and opens only those; row groups inside
them are skipped by Spark's own statistics. The look-up table has a row a file.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entitystats.skew import as_list

#: Files that a read may list one by one; beyond, the whole folder is read with the same filter.
MAX_LISTED = 10_000


def write_clustered(df: DataFrame, path: str, keys: str | Sequence[str], files: int | None = None) -> None:
    """Write rows in ranges of ``keys`` with the table of files beside them.

    A key's rows may spread over many files, so a hot key is no obstacle.
    """
    keys = as_list(keys)
    ranged = df.repartitionByRange(files, *keys) if files else df.repartitionByRange(*keys)
    ranged.sortWithinPartitions(*keys).write.parquet(f"{path}/data")
    written = df.sparkSession.read.schema(df.schema).parquet(f"{path}/data")
    bounds = [f(F.col(k)).alias(f"{name}_{k}") for k in keys for name, f in (("low", F.min), ("high", F.max))]
    nulls = [F.max(F.col(k).isNull()).alias(f"null_{k}") for k in keys]
    written.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("rows"), *bounds, *nulls).coalesce(1).write.parquet(f"{path}/files")


def matching_files(spark: SparkSession, path: str, ranges: Mapping[str, tuple[Any, Any]]) -> DataFrame:
    """Files that can hold a row whose columns lie in the ranges; None leaves a side open."""
    files = spark.read.parquet(f"{path}/files")
    for column, (low, high) in ranges.items():
        if low is not None:
            files = files.filter(F.col(f"high_{column}") >= F.lit(low))
        if high is not None:
            files = files.filter(F.col(f"low_{column}") <= F.lit(high))
    return files


def read_range(spark: SparkSession, path: str, ranges: Mapping[str, tuple[Any, Any]]) -> DataFrame:
    """Rows whose columns lie in the closed ranges, from the files that can hold any."""
    schema = spark.read.parquet(f"{path}/data").schema
    found = [r["file"] for r in matching_files(spark, path, ranges).select("file").limit(MAX_LISTED + 1).collect()]
    if not found:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(*(found if len(found) <= MAX_LISTED else [f"{path}/data"]))
    for column, (low, high) in ranges.items():
        if low is not None:
            rows = rows.filter(F.col(column) >= F.lit(low))
        if high is not None:
            rows = rows.filter(F.col(column) <= F.lit(high))
    return rows
