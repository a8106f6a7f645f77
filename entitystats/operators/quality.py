"""Record checks, outliers and data-set checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entitystats.functions.dates import parse_timestamp
from entitystats.session import max_rows_per_task, settled_small
from entitystats.skew import heavy_keys, null_safe_join, quantiles, whole_key

#: Fields a record must have, outlier threshold and MAD scale - fixed values.
CRITICAL_FIELDS = ["game_date", "home_team", "away_team"]
Z_THRESHOLD = 3.0
MAD_SCALE = 0.6745


def is_missing(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit(True)
    if isinstance(df.schema[name].dataType, T.StringType):
        return F.col(name).isNull() | (F.trim(F.col(name)) == "")
    return F.col(name).isNull()


def missing_fields(df: DataFrame, required: Sequence[str] = tuple(CRITICAL_FIELDS)) -> Column:
    """Names of the required fields that are null, blank or absent."""
    return F.array_compact(F.array(*[F.when(is_missing(df, f), F.lit(f)) for f in required]))


def split_critical(df: DataFrame, required: Sequence[str] = tuple(CRITICAL_FIELDS)) -> tuple[DataFrame, DataFrame]:
    """(records that have all fields, rejected records with ``missing``)."""
    tagged = df.withColumn("missing", missing_fields(df, required))
    return tagged.filter(F.size("missing") == 0).drop("missing"), tagged.filter(F.size("missing") > 0)


def _fits(df: DataFrame, name: str, kind: str) -> Column:
    value, have = F.col(name), df.schema[name].dataType
    text = isinstance(have, T.StringType)
    if kind == "int":
        if text:
            return value.rlike(r"^\d+$")
        if isinstance(have, (T.FloatType, T.DoubleType)):
            return value == F.floor(value)
        return F.lit(isinstance(have, T.IntegralType))
    if kind == "float":
        return value.try_cast("double").isNotNull() if text else F.lit(isinstance(have, T.NumericType))
    if kind == "str":
        return F.lit(text)
    if kind == "timestamp":
        return parse_timestamp(value).isNotNull() if text else F.lit(isinstance(have, (T.TimestampType, T.TimestampNTZType, T.DateType)))
    raise ValueError(f"unknown type {kind}")


def type_errors(df: DataFrame, schema: dict[str, str]) -> Column:
    """Map field -> message for values that are present but not of the type."""
    entries = [
        F.when(F.col(f).isNotNull() & ~_fits(df, f, kind), F.struct(F.lit(f).alias("key"), F.lit(f"expected {kind}").alias("value")))
        for f, kind in schema.items()
        if f in df.columns
    ]
    return F.map_from_entries(F.array_compact(F.array(*entries)))


def record_errors(df: DataFrame, date: str = "game_date", numbers: Sequence[str] = ("home_score", "away_score", "value")) -> Column:
    """Messages of the record check: date missing or unreadable, numbers unreadable."""
    found = []
    if date in df.columns:
        found.append(
            F.when(F.col(date).isNull(), F.lit(f"{date} missing")).when(~_fits(df, date, "timestamp"), F.lit(f"{date} not parseable"))
        )
    for n in numbers:
        if n in df.columns:
            found.append(F.when(F.col(n).isNotNull() & ~_fits(df, n, "float"), F.lit(f"{n} not numeric")))
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def flag_outliers(
    df: DataFrame, value: str, by: Sequence[str] = (), z: float = Z_THRESHOLD, flag: str = "is_outlier", max_rows: int | None = None
) -> DataFrame:
    """Mark values far from the median, measured in median absolute deviations.

    With a zero MAD the distance is from the mean in population deviations.
    Groups with fewer than two numbers have no outliers. Statistics are one row
    per group; the rows themselves are not gathered.
    """
    by = list(by) or ["__all"]
    v = F.col(value).try_cast("double")
    rows = df.withColumn("__v", v) if "__all" not in by else df.withColumn("__v", v).withColumn("__all", whole_key("__v"))
    limit = max_rows or max_rows_per_task(df.sparkSession)
    heavy = heavy_keys(rows.filter(F.col("__v").isNotNull()), by, limit)
    med = settled_small(quantiles(rows, by, "__v", {"__med": 0.5}, limit, heavy))
    moments = rows.groupBy(*by).agg(F.count("__v").alias("__n"), F.avg("__v").alias("__mean"), F.stddev_pop("__v").alias("__sd"))
    centred = null_safe_join(rows.select(*by, "__v"), med, by, "inner").withColumn(
        "__dev", F.abs(F.col("__v") - F.col("__med"))
    )
    mad = quantiles(centred, by, "__dev", {"__mad": 0.5}, limit, heavy)
    stats = null_safe_join(null_safe_join(moments, med, by), mad, by)
    robust = F.abs(MAD_SCALE * (F.col("__v") - F.col("__med")) / F.col("__mad")) >= z
    plain = F.abs((F.col("__v") - F.col("__mean")) / F.col("__sd")) >= z
    hit = F.when(F.col("__n") < 2, F.lit(False)).when(F.col("__mad") != 0, robust).when(F.col("__sd") > 1e-9, plain)
    return (
        null_safe_join(rows, settled_small(stats), by)
        .withColumn(flag, F.coalesce(hit, F.lit(False)))
        .drop("__v", "__n", "__mean", "__sd", "__med", "__mad", "__all")
    )


def flag_records(
    df: DataFrame, required: Sequence[str] = tuple(CRITICAL_FIELDS), value: str = "value", max_rows: int | None = None
) -> DataFrame:
    """Adds ``missing``, ``errors`` and ``is_outlier``."""
    tagged = df.withColumns({"missing": missing_fields(df, required), "errors": record_errors(df)})
    if value not in df.columns:
        return tagged.withColumn("is_outlier", F.lit(False))
    return flag_outliers(tagged, value, max_rows=max_rows)


def batch_summary(flagged: DataFrame) -> DataFrame:
    """One row: records, and how many have missing fields, errors and outliers."""
    return flagged.agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(F.size("missing") > 0).alias("missing_count"),
        F.count_if(F.size("errors") > 0).alias("type_error_count"),
        F.count_if("is_outlier").alias("outlier_count"),
    )


def split_leakage(df: DataFrame, entity: str, ts: str, split: str = "split") -> DataFrame:
    """Per entity: rows and time range of each split, and whether they overlap."""
    wide = (
        df.groupBy(entity)
        .pivot(split, ["train", "val", "test"])
        .agg(F.count(F.lit(1)).alias("count"), F.min(ts).alias("min"), F.max(ts).alias("max"))
    )
    late = lambda a, b: F.coalesce(F.col(a) >= F.col(b), F.lit(False))
    counts = {f"{s}_count": F.coalesce(F.col(f"{s}_count"), F.lit(0).cast("bigint")) for s in ("train", "val", "test")}
    return wide.withColumns({**counts, "overlap": late("train_max", "val_min") | late("val_max", "test_min")})


def duplicate_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every row of a key that occurs more than once, with the number of rows.

    Keys are counted first and only repeated ones are joined back, so a hot key
    is never gathered in one window.
    """
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    return null_safe_join(df, settled_small(repeated), list(keys), "inner")


def split_ranges(df: DataFrame, ts: str, split: str = "split") -> DataFrame:
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("rows"), F.min(ts).alias("min"), F.max(ts).alias("max"))


def parity_totals(source: DataFrame, target: DataFrame, value: str) -> DataFrame:
    """One row comparing row count and sum of two tables, in a single aggregate."""
    tag = lambda d, is_source: d.select(F.col(value).alias("v"), F.lit(is_source).alias("s"))
    out = tag(source, True).unionByName(tag(target, False)).agg(
        F.count_if("s").alias("source_rows"),
        F.sum(F.when(F.col("s"), F.col("v"))).alias("source_sum"),
        F.count_if(~F.col("s")).alias("target_rows"),
        F.sum(F.when(~F.col("s"), F.col("v"))).alias("target_sum"),
    )
    return out.withColumn("matches", (F.col("source_rows") == F.col("target_rows")) & _close("source_sum", "target_sum"))


def _close(a: str, b: str) -> Column:
    both_empty = F.col(a).isNull() & F.col(b).isNull()
    near = F.abs(F.col(a) - F.col(b)) <= 1e-6 * F.greatest(F.lit(1.0), F.abs(F.col(a)))
    return both_empty | F.coalesce(near, F.lit(False))


def parity_by_entity(source: DataFrame, target: DataFrame, entity: str, value: str) -> DataFrame:
    """Entities whose row count or sum differs between two tables."""
    side = lambda d, n: d.groupBy(entity).agg(F.count(F.lit(1)).alias(f"{n}_rows"), F.sum(value).alias(f"{n}_sum"))
    both = side(source, "source").join(side(target, "target"), entity, "full")
    return both.filter(~(F.col("source_rows").eqNullSafe(F.col("target_rows")) & _close("source_sum", "target_sum")))
