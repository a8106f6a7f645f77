"""Per-entity history features.

All operators take column names. ``entity`` identifies the series, ``ts`` orders
it, ``tie`` lists columns that make the order total, ``value`` is the measure.
"History" of a row always means the rows strictly before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from entitystats.session import max_rows_per_task, settled_small
from entitystats.skew import HOT, SLICE, Timeline, as_list, heavy_keys, null_safe_join, quantiles

#: Smoothing and decay factors (fixed values).
EMA_ALPHA = 0.3
DECAY = 0.6
HISTORY_ROWS = 10


def _last(history: Column, k: int) -> list[Column]:
    """The last k elements of an array, newest first; null where missing."""
    return [F.try_element_at(history, F.lit(-i)) for i in range(1, k + 1)]


def _mean_last(history: Column, k: int) -> Column:
    total = F.lit(0.0)
    for element in _last(history, k):
        total = total + F.coalesce(element, F.lit(0.0))
    return F.when(F.size(history) > 0, total / F.least(F.size(history), F.lit(k)))


def _pstd_last(history: Column, k: int) -> Column:
    """Population deviation of the last k values; null with fewer than k."""
    elements = _last(history, k)
    mean = _mean_last(history, k)
    square = sum((F.pow(e - mean, F.lit(2.0)) for e in elements), F.lit(0.0))
    return F.when(F.size(history) >= k, F.sqrt(square / k))


def rest_days(ts: str, window: WindowSpec) -> Column:
    """Whole days between this row and the previous one, minus one, at least 0; null for the first."""
    gap = F.datediff(F.col(ts).cast("date"), F.lag(F.col(ts).cast("date"), 1).over(window)) - 1
    return F.when(gap.isNotNull(), F.greatest(gap, F.lit(0)))


def rest_features(df: DataFrame, entity, ts: str, tie: Sequence[str] = (), max_rows: int | None = None) -> DataFrame:
    """Rest days and the back-to-back flag (rest of zero days)."""

    def build(rows: DataFrame, w: WindowSpec) -> DataFrame:
        out = rows.withColumn("days_rest", rest_days(ts, w))
        return out.withColumn("is_back_to_back", F.coalesce((F.col("days_rest") == 0).cast("int"), F.lit(0)))

    return Timeline(df, entity, [ts, *tie], max_rows).trailing(1, build)


def training_rows(
    df: DataFrame,
    entity,
    ts: str,
    value: str,
    tie: Sequence[str] = (),
    season: str | None = None,
    season_label: Column | None = None,
    proxies: Sequence[str] = (),
    fallback: dict[str, str] | None = None,
    decay: float = DECAY,
    max_rows: int | None = None,
) -> DataFrame:
    """Lagged training rows: means over the last 3/5/10 values, deviation, rest.

    The frame is the ten previous rows; null values inside it are skipped but
    still use up a place. A row without a value, or with no value in its frame,
    is not emitted but stays part of the history of later rows.

    ``proxies`` adds a decay-weighted mean ``adv_<proxy>`` over the frame rows
    whose ``season`` equals the row's season. The row's season is ``season``
    or, where that is missing, ``season_label`` computed from the date; with
    neither, every frame row counts. ``fallback`` names a column to use when
    no frame row matches (else 0.0).
    """

    def build(rows: DataFrame, w: WindowSpec) -> DataFrame:
        frame = w.rowsBetween(-HISTORY_ROWS, -1)
        cols: dict[str, Column] = {
            "__hist": F.collect_list(F.col(value).cast("double")).over(frame),
            "days_rest": rest_days(ts, w),
        }
        if proxies:
            fields = [F.col(season).alias("season")] if season else [F.lit(None).cast("string").alias("season")]
            fields += [F.col(p).cast("double").alias(p) for p in proxies]
            cols["__games"] = F.collect_list(F.struct(*fields)).over(frame)
        out = rows.withColumns(cols)
        row_season = F.col(season) if season else F.lit(None).cast("string")
        if season_label is not None:
            row_season = F.coalesce(F.when(row_season != "", row_season), season_label)
        features = {
            "last_3_avg": _mean_last(F.col("__hist"), 3),
            "last_5_avg": _mean_last(F.col("__hist"), 5),
            "last_10_avg": _mean_last(F.col("__hist"), 10),
            "last_3_std": _pstd_last(F.col("__hist"), 3),
        }
        for p in proxies:
            same_season = F.filter(F.col("__games"), lambda g: row_season.isNull() | (g["season"] == row_season))
            weighted = decay_mean(F.transform(same_season, _field(p)), decay)
            other = F.col(fallback[p]) if fallback and p in fallback else F.lit(0.0)
            features[f"adv_{p}"] = F.coalesce(weighted, other, F.lit(0.0))
        out = out.withColumns(features).filter(F.col(value).isNotNull() & (F.size("__hist") > 0))
        return out.drop("__hist", "__games")

    return Timeline(df, entity, [ts, *tie], max_rows).trailing(HISTORY_ROWS, build)


def _field(name: str):
    return lambda row: row[name]


def decay_mean(values: Column, decay: float = DECAY) -> Column:
    """Weighted mean of an oldest-first array, weight decay^age, newest age 0."""
    present = F.filter(values, lambda v: v.isNotNull())
    # Horner form: every earlier value is multiplied by decay once more per step
    start = F.struct(F.lit(0.0).alias("num"), F.lit(0.0).alias("den"))
    fold = lambda acc, v: F.struct(
        (acc["num"] * decay + v).alias("num"), (acc["den"] * decay + 1.0).alias("den")
    )
    return F.aggregate(present, start, fold, lambda acc: F.when(acc["den"] > 0, acc["num"] / acc["den"]))


def impute_training_rows(
    df: DataFrame,
    entity,
    ts: str,
    tie: Sequence[str] = (),
    causal: bool = False,
    max_rows: int | None = None,
) -> DataFrame:
    """Fill training-row gaps: deviation 0, rest 2, home 0, adv 0, opp_def mean or 100.

    The default mean of ``opp_def`` is over the whole entity, future included;
    ``causal=True`` uses only earlier rows.
    """
    plain = {"last_3_std": F.lit(0.0), "days_rest": F.lit(2.0)}
    fills = {c: F.coalesce(F.col(c).cast("double"), v) for c, v in plain.items() if c in df.columns}
    if "is_home" in df.columns:
        fills["is_home"] = F.coalesce(F.col("is_home").cast("int"), F.lit(0))
    for c in df.columns:
        if c.startswith("adv_"):
            fills[c] = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    out = df.withColumns(fills)
    if "opp_def" not in df.columns:
        return out
    line = Timeline(out, entity, [ts, *tie], max_rows)
    x = F.col("opp_def").cast("double")
    if causal:
        line = line.running(__s=("sum", x, False), __n=("count", x, False))
    else:
        line = line.totals(__s=("sum", x), __n=("count", x))
    mean = F.when(F.col("__n") > 0, F.col("__s") / F.col("__n"))
    return line.result().withColumn("opp_def", F.coalesce(x, mean, F.lit(100.0))).drop("__s", "__n")


def ema_weight(rank_from_oldest: Column, n: Column, alpha: float = EMA_ALPHA) -> Column:
    """Weight of a value in the average that starts at the newest value and
    folds in older ones: the oldest value (rank 1) ends with weight alpha."""
    return F.when(rank_from_oldest == n, F.pow(F.lit(1 - alpha), n - 1)).otherwise(
        alpha * F.pow(F.lit(1 - alpha), rank_from_oldest - 1)
    )


def rolling_summary(
    df: DataFrame,
    entity,
    ts: str,
    value: str,
    tie: Sequence[str] = (),
    windows: Sequence[int] = (3, 5, 10),
    max_rows: int | None = None,
) -> DataFrame:
    """One row per entity over its newest values.

    For each window w: mean, deviation, minimum, maximum and median of the
    newest w values (fewer when there are not w). Also the exponential mean,
    linearly weighted means over 3 and 5, slope over 10 (newest first, so a
    rising series has a negative slope) and the newest value minus the mean of
    the newest five. Medians see the newest values only, so their buffers hold
    as many as the widest window.
    """
    entity = as_list(entity)
    v = F.col(value).cast("double")
    rows = df.select(*entity, ts, *tie, value)
    present = rows.filter(F.col(value).isNotNull())
    line = Timeline(present, entity, [ts, *tie], max_rows)
    ranked = line.running(__old=("count", F.lit(1), True)).totals(__n=("count", F.lit(1))).result()
    rn = F.col("__n") - F.col("__old") + 1  # 1 = newest
    aggs = []
    for w in windows:
        recent = F.when(rn <= w, v)
        aggs += [
            F.avg(recent).alias(f"last_{w}_avg"),
            F.stddev_pop(recent).alias(f"last_{w}_std"),
            F.min(recent).alias(f"last_{w}_min"),
            F.max(recent).alias(f"last_{w}_max"),
            F.percentile(recent, F.lit(0.5)).alias(f"last_{w}_median"),
        ]
    aggs.append(F.sum(v * ema_weight(F.col("__old"), F.col("__n"))).alias("exponential_moving_avg"))
    for w in (3, 5):
        weight = F.when(rn <= w, F.least(F.lit(w), F.col("__n")) + 1 - rn)
        aggs.append((F.sum(v * weight) / F.sum(weight)).alias(f"wma_{w}"))
    in_slope = rn <= 10
    aggs.append(
        F.coalesce(F.regr_slope(F.when(in_slope, v), F.when(in_slope, rn - 1)), F.lit(0.0)).alias("slope_10")
    )
    aggs.append((F.max(F.when(rn == 1, v)) - F.avg(F.when(rn <= 5, v))).alias("momentum_vs_5_avg"))
    return ranked.groupBy(*entity).agg(F.max("__n").alias("n_values"), *aggs)


def recent_stats(
    df: DataFrame,
    entity,
    ts: str,
    value: str,
    tie: Sequence[str] = (),
    newest_first: bool = True,
    upper_median: bool = False,
    max_rows: int | None = None,
) -> DataFrame:
    """Mean, median, population deviation, count, slope over position and the
    95 % interval of the mean, per entity over its whole history.

    ``upper_median`` takes the upper middle element instead of interpolating.
    """
    entity = as_list(entity)
    rows = df.select(*entity, ts, *tie, value).filter(F.col(value).isNotNull())
    heavy = heavy_keys(rows, entity, max_rows or max_rows_per_task(rows.sparkSession))
    line = Timeline(rows, entity, [ts, *tie], max_rows, heavy)
    ranked = line.running(__old=("count", F.lit(1), True)).totals(__n=("count", F.lit(1)))
    v = F.col(value).cast("double")
    pos = (F.col("__n") - F.col("__old")) if newest_first else (F.col("__old") - 1)
    margin = F.lit(1.96) * F.col("std") / F.sqrt(F.col("sample_size"))
    out = (
        ranked.result()
        .groupBy(*entity)
        .agg(
            F.avg(v).alias("mean"),
            F.stddev_pop(v).alias("std"),
            F.count(v).alias("sample_size"),
            F.regr_slope(v, pos).alias("trend_slope"),
        )
        .withColumns({"ci_low": F.col("mean") - margin, "ci_high": F.col("mean") + margin})
    )
    if upper_median:
        # element floor(n/2) of the ascending values
        by_value = Timeline(rows.select(*entity, value, ts, *tie), entity, [value, ts, *tie], max_rows, heavy)
        at = by_value.running(__i=("count", F.lit(1), False)).totals(__n=("count", F.lit(1))).result()
        median = at.filter(F.col("__i") == F.floor(F.col("__n") / 2)).select(
            *entity, F.col(value).cast("double").alias("median")
        )
    else:
        median = quantiles(rows, entity, value, {"median": 0.5}, max_rows, heavy)
    return out.join(median, entity, "left")


def expanding_form(
    df: DataFrame,
    entity,
    ts: str,
    value: str,
    tie: Sequence[str] = (),
    max_rows: int | None = None,
) -> DataFrame:
    """Season average and three-row prediction from earlier rows only.

    Leading rows without a history take the first later value of the column.
    Adds ``season_avg``, ``predicted_value``, ``pred_prob`` and ``actual``.
    """
    entity = as_list(entity)
    v = F.col(value).cast("double")
    line = Timeline(df, entity, [ts, *tie], max_rows)
    line = line.running(__s=("sum", v, False), __n=("count", v, False))
    season = F.when(F.col("__n") > 0, F.col("__s") / F.col("__n"))
    out = line.with_column("__season", season).drop("__s", "__n").trailing(
        3, lambda rows, w: rows.withColumn("__pred", F.avg(v).over(w.rowsBetween(-3, -1)))
    )
    filled = _first_following(out, entity, [ts, *tie], ["__season", "__pred"], line.sliced, max_rows)
    return (
        filled.withColumnsRenamed({"__season": "season_avg", "__pred": "predicted_value"})
        .withColumns(
            {
                "pred_prob": 1.0 / (1.0 + F.exp(-(F.col("predicted_value") - F.col("season_avg")))),
                "actual": F.coalesce((v > F.col("season_avg")).cast("int"), F.lit(0)),
            }
        )
    )


def _first_following(df: DataFrame, entity: list[str], order: list[str], columns: list[str], sliced: bool, max_rows: int | None) -> DataFrame:
    """Fill nulls of each column with the next non-null value of the entity."""
    ahead = lambda w: {c: F.first(c, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)) for c in columns}
    if not sliced:
        return df.withColumns(ahead(Window.partitionBy(*entity).orderBy(*order)))
    line = Timeline(df, entity, order, max_rows)
    at = [F.col(c) for c in order]
    firsts = [F.min(F.when(F.col(c).isNotNull(), F.struct(*at, F.col(c)))).alias(f"__f_{c}") for c in columns]
    later = Window.partitionBy(*entity).orderBy(SLICE).rowsBetween(1, Window.unboundedFollowing)
    carry = line.hot_slices(*firsts).select(
        *line.keys, *[F.first(f"__f_{c}", ignorenulls=True).over(later)[c].alias(f"__later_{c}") for c in columns]
    )
    joined = line.join_slices(line.df.withColumns(ahead(line.window())), carry)
    return joined.withColumns({c: F.coalesce(F.col(c), F.col(f"__later_{c}")) for c in columns}).drop(SLICE, HOT, *[f"__later_{c}" for c in columns])


def lag_features(
    df: DataFrame,
    entity,
    ts: str,
    value: str,
    tie: Sequence[str] = (),
    shifted: bool = True,
    causal: bool = False,
    max_rows: int | None = None,
) -> DataFrame:
    """``lag_1`` and ``lag_3_mean``; gaps take the entity mean.

    ``shifted=False`` includes the current row in the three-row mean.
    ``causal=True`` leaves the gaps null instead of using the whole-entity mean.
    """
    v = F.col(value).cast("double")

    def build(rows: DataFrame, w: WindowSpec) -> DataFrame:
        frame = w.rowsBetween(-3, -1) if shifted else w.rowsBetween(-2, 0)
        return rows.withColumns({"lag_1": F.lag(v, 1).over(w), "lag_3_mean": F.avg(v).over(frame)})

    if causal:
        return Timeline(df, entity, [ts, *tie], max_rows).trailing(3, build)
    line = Timeline(df, entity, [ts, *tie], max_rows).totals(__s=("sum", v), __n=("count", v))
    mean = F.when(F.col("__n") > 0, F.col("__s") / F.col("__n"))
    out = line.trailing(3, build)
    return out.withColumns(
        {c: F.coalesce(F.col(c), mean) for c in ("lag_1", "lag_3_mean")}
    ).drop("__s", "__n")


def latest_rows(df: DataFrame, entity, ts: str, n: int, tie: Sequence[str] = (), rank: str | None = None) -> DataFrame:
    """Newest n rows of every entity. Spark trims to n before it shuffles."""
    order = [F.col(c).desc() for c in [ts, *tie]]
    name = rank or "__rn"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*as_list(entity)).orderBy(*order))).filter(
        F.col(name) <= n
    )
    return out if rank else out.drop(name)


def latest_row(df: DataFrame, key, ts: str, tie: Sequence[str] = ()) -> DataFrame:
    """Newest row per key, as an aggregate so that rows combine before the shuffle."""
    key = as_list(key)
    rest = [c for c in df.columns if c not in key]
    at = F.struct(*[F.col(c) for c in [ts, *tie]])
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), at).alias("__row")).select(*key, "__row.*")


def group_zscore(df: DataFrame, group, value: str, name: str = "z", max_rows: int | None = None) -> DataFrame:
    """(value - mean) / population deviation of the group; 0 when there is none.

    The moments are one row per group, so the table itself is not moved when
    that side is small enough to broadcast.
    """
    group = as_list(group)
    v = F.col(value).cast("double")
    moments = df.groupBy(*group).agg(F.avg(v).alias("__m"), F.stddev_pop(v).alias("__sd"))
    out = null_safe_join(df, settled_small(moments), group)
    z = F.when(F.col("__sd") > 0, (v - F.col("__m")) / F.col("__sd")).otherwise(F.lit(0.0))
    return out.withColumn(name, F.when(v.isNull(), F.lit(0.0)).otherwise(z)).drop("__m", "__sd")
