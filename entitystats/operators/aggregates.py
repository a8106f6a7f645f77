"""Season, team and table-level aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entitystats.functions import values as V
from entitystats.functions.dates import minutes_played
from entitystats.operators.normalize import pick
from entitystats.session import join_per_key, max_rows_per_task, settled
from entitystats.skew import Timeline, as_list, heavy_keys, null_safe_join, quantiles, whole_key

#: Box-score measures and the spellings they come in - fixed values.
BOX_ALIASES = {
    "PTS": ["PTS", "points"],
    "AST": ["AST"],
    "REB": ["REB"],
    "FGA": ["FGA", "FG_ATT"],
    "FGM": ["FGM"],
    "FTA": ["FTA"],
    "FTM": ["FTM"],
    "STL": ["STL", "stl"],
    "BLK": ["BLK", "blk"],
    "TOV": ["TO", "TOV", "to"],
}
MINUTES_ALIASES = ["MIN", "min"]

#: Tracking metrics: spellings, and the factor to the reported unit - fixed values.
TRACKING = {
    "avg_speed_mph": [
        (["avg_speed_mph", "speed_mph", "spd_mph"], 1.0),
        (["avg_speed_mps", "speed_mps", "spd_mps"], V.MPS_TO_MPH),
        (["avg_speed", "speed"], 1.0),
    ],
    "distance_miles_per_game": [
        (["distance_m", "distance_meters", "distanceMeters", "dist_m"], 1 / V.METRES_PER_MILE),
        (["distance_miles", "distance_mile", "distance_mi", "dist_miles"], 1.0),
    ],
    "touches_per_game": [(["touches", "touch_count", "touches_count", "touches_per_game", "touches_pg"], 1.0)],
    "time_possession_sec_per_game": [
        (["time_of_possession_sec", "possession_sec", "time_poss_sec", "time_poss", "possession_time_sec"], 1.0)
    ],
    "exp_fg_pct": [
        (["exp_fg_pct", "expected_fg_pct", "expected_fg", "exp_fg", "xg", "exp_fg_percent", "expected_fg_percent", "exp_fg_perc"], 1.0)
    ],
}


def _number(df: DataFrame, names: Sequence[str]) -> Column:
    """First spelling that holds a non-zero number, else 0."""
    tries = [F.nullif(F.col(n).try_cast("double"), F.lit(0.0)) for n in names if n in df.columns]
    return F.coalesce(*tries, F.lit(0.0)) if tries else F.lit(0.0)


def box_lines(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Canonical numeric box score per game."""
    minutes = pick(df, MINUTES_ALIASES)
    return df.select(
        *keep,
        *[_number(df, names).alias(k) for k, names in BOX_ALIASES.items()],
        (F.lit(0.0) if minutes is None else minutes_played(minutes)).alias("MIN"),
    )


def game_proxies(df: DataFrame) -> DataFrame:
    """Adds ``proxy_PER`` and ``proxy_WS`` per game from its box score."""
    line = box_lines(df, [])
    names = line.columns
    exprs = {n: c for n, c in zip(names, [_number(df, BOX_ALIASES[k]) for k in BOX_ALIASES])}
    minutes = pick(df, MINUTES_ALIASES)
    mins = F.lit(0.0) if minutes is None else minutes_played(minutes)
    eff = V.box_efficiency(*[exprs[k] for k in ("PTS", "AST", "REB", "STL", "BLK", "TOV", "FGA", "FGM", "FTA", "FTM")])
    return df.withColumns({"proxy_PER": V.per_estimate(eff), "proxy_WS": V.ws_per_game(eff, mins)})


def season_box_score(df: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """Games, sums of eleven measures and their per-game means."""
    keys = as_list(keys)
    measures = [*BOX_ALIASES, "MIN"]
    sums = box_lines(df, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("games"), *[F.sum(m).alias(m) for m in measures])
    return sums.withColumns({f"{m}_per_game": F.col(m) / F.col("games") for m in measures})


def season_estimates(box: DataFrame, per_scale: float | Column = V.PER_SCALE, ws_scale: float | Column = V.WS_SCALE) -> DataFrame:
    """Season efficiency, rating and win-share estimates from ``season_box_score``."""
    g = lambda m: F.col(f"{m}_per_game")
    eff = V.box_efficiency(*[g(k) for k in ("PTS", "AST", "REB", "STL", "BLK", "TOV", "FGA", "FGM", "FTA", "FTM")])
    raw_ws = V.ws_per_game(F.col("eff_per_game"), g("MIN"), 1.0)
    return (
        box.withColumn("eff_per_game", eff)
        .withColumns({"PER_est_raw": F.col("eff_per_game") * V.PER_FACTOR, "WS_est_raw": raw_ws * F.col("games")})
        .withColumns(
            {
                "PER_est": F.col("PER_est_raw") * per_scale,
                "ws_per_game": raw_ws * ws_scale,
                "WS_est": raw_ws * ws_scale * F.col("games"),
            }
        )
    )


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den)


def shooting_stats(df: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """Games, per-game points/assists/rebounds and shooting ratios.

    A ratio is null when its denominator is zero.
    """
    keys = as_list(keys)
    s = lambda names: F.sum(_number(df, names))
    sums = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("games"),
        s(["PTS", "points"]).alias("pts"), s(["AST"]).alias("ast"), s(["REB"]).alias("reb"),
        s(["FGM"]).alias("fgm"), s(["FGA"]).alias("fga"), s(["FG3M"]).alias("fg3m"), s(["FG3A"]).alias("fg3a"),
        s(["FTM"]).alias("ftm"), s(["FTA"]).alias("fta"),
    )
    c = F.col
    return sums.select(
        *keys, "games",
        (c("pts") / c("games")).alias("PTS_per_game"), (c("ast") / c("games")).alias("AST_per_game"), (c("reb") / c("games")).alias("REB_per_game"),
        _ratio(c("fgm"), c("fga")).alias("FG_pct"), _ratio(c("fg3m"), c("fg3a")).alias("FG3_pct"), _ratio(c("ftm"), c("fta")).alias("FT_pct"),
        F.when(c("fga") > 0, c("pts") / (2.0 * (c("fga") + 0.44 * c("fta")))).alias("TS_PCT"),
    )


def team_stats(df: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """Points for and against, difference, games and shooting ratios.

    Measures whose columns are absent are absent from the result.
    """
    keys = as_list(keys)
    aggs = [F.count(F.lit(1)).alias("games")]
    opp = next((c for c in ("OPP_PTS", "PTS_OPP", "OPPPTS", "PTS_ALLOWED") if c in df.columns), None)
    if "PTS" in df.columns:
        aggs.append(F.avg("PTS").alias("PTS_avg"))
    if opp:
        aggs.append(F.avg(opp).alias("OPP_PTS_avg"))
    if "PTS" in df.columns and opp:
        aggs.append((F.avg("PTS") - F.avg(opp)).alias("PTS_diff"))
    for name, made, tried in (("FG_pct", "FGM", "FGA"), ("FT_pct", "FTM", "FTA")):
        m = next((c for c in (made, f"{made}_HOME", f"{made}_AWAY") if c in df.columns), None)
        a = next((c for c in (tried, f"{tried}_HOME", f"{tried}_AWAY") if c in df.columns), None)
        if m and a:
            aggs.append(_ratio(F.sum(m).cast("double"), F.sum(a).cast("double")).alias(name))
    return df.groupBy(*keys).agg(*aggs)


def multi_season_mean(per_season: DataFrame, entity, metrics: Sequence[str], prefix: str = "multi_", seasons: str | None = None) -> DataFrame:
    """Mean over seasons of each metric that is numeric there; with a season count."""
    aggs = [F.avg(F.col(m).try_cast("double")).alias(f"{prefix}{m}") for m in metrics]
    if seasons:
        aggs.append(F.count_distinct(F.col(seasons)).alias(f"{prefix}season_count"))
    return per_season.groupBy(*as_list(entity)).agg(*aggs)


def multi_season_long(long: DataFrame, entity, metric: str, value: str) -> DataFrame:
    """The same for (entity, season, metric, value) rows: one mean per entity and metric."""
    return long.groupBy(*as_list(entity), metric).agg(F.avg(F.col(value).try_cast("double")).alias(value)).filter(F.col(value).isNotNull())


def season_mean(df: DataFrame, keys, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*as_list(keys)).agg(*[F.avg(c).alias(f"{c}_avg") for c in columns])


def team_seasons(games: DataFrame, ts: str = "game_date") -> DataFrame:
    """Team and calendar-year record: games, mean points for and against.

    Every game counts once for each side; a game of a team against itself
    counts once, from the home side.
    """
    season = F.year(ts).cast("string").alias("season")
    home = games.select(F.col("home_team").alias("team"), season, F.col("home_score").alias("pf"), F.col("away_score").alias("pa"))
    away = games.filter("NOT (home_team <=> away_team)").select(
        F.col("away_team").alias("team"), season, F.col("away_score").alias("pf"), F.col("home_score").alias("pa")
    )
    return home.unionByName(away).groupBy("team", "season").agg(
        F.count(F.lit(1)).alias("games_count"), F.avg("pf").alias("pts_for_avg"), F.avg("pa").alias("pts_against_avg")
    )


def entities_with_rows(df: DataFrame, entity, at_least: int, top: int | None = None) -> DataFrame:
    """Entities with enough rows, most rows first (name breaks ties)."""
    keys = as_list(entity)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") >= at_least)
    return counts if top is None else counts.orderBy(F.desc("n_rows"), *keys).limit(top)


def top_groups(df: DataFrame, group, measure: Column, n: int, name: str = "score") -> DataFrame:
    """The n groups with the largest aggregate, name ascending on ties."""
    keys = as_list(group)
    return df.groupBy(*keys).agg(measure.alias(name)).orderBy(F.desc(name), *keys).limit(n)


#: Reported quantiles - fixed values.
SUMMARY_QUANTILES = {"q01": 0.01, "q05": 0.05, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q95": 0.95, "q99": 0.99}


def dataset_summary(df: DataFrame, entity: str, value: str, max_rows: int | None = None) -> DataFrame:
    """One row: size, mean, sample deviation, quantiles, entities and values beyond three deviations."""
    rows = df.select(whole_key(entity).alias("__all"), entity, F.col(value).cast("double").alias("v"))
    base = rows.groupBy("__all").agg(
        F.count(F.lit(1)).alias("rows_total"), F.avg("v").alias("target_mean"), F.stddev_samp("v").alias("target_std"),
        F.count_distinct(F.col(entity)).alias("num_entities"),
    )
    base = settled(base)
    beyond = null_safe_join(rows, F.broadcast(base.select("__all", "target_mean", "target_std")), ["__all"])  # one row
    tails = beyond.groupBy("__all").agg(
        F.count_if(F.col("v") > F.col("target_mean") + 3 * F.col("target_std")).alias("outliers_up"),
        F.count_if(F.col("v") < F.col("target_mean") - 3 * F.col("target_std")).alias("outliers_down"),
    )
    q = quantiles(rows, "__all", "v", SUMMARY_QUANTILES, max_rows)
    return base.join(q, "__all").join(tails, "__all").drop("__all")


def tracking_features(df: DataFrame, entity) -> DataFrame:
    """Mean tracking metrics; the first readable spelling counts, units converted."""
    aggs = []
    for metric, options in TRACKING.items():
        tries = [V.float_text(F.col(n)) * factor for names, factor in options for n in names if n in df.columns]
        value = F.coalesce(*tries) if tries else F.lit(None).cast("double")
        aggs.append(F.avg(V.as_share(value) if metric == "exp_fg_pct" else value).alias(metric))
    return df.groupBy(*as_list(entity)).agg(*aggs)


def entity_mean_since(df: DataFrame, entity: str, key, ts: str, since, value: str) -> DataFrame:
    """Mean of one entity from a time on: both filters reach the scan."""
    return df.filter((F.col(entity) == key) & (F.col(ts) >= since)).agg(F.avg(value).alias("avg_value"))


def range_means(df: DataFrame, entity: str, ts: str, start, end, value: str, top: int = 10) -> DataFrame:
    """Entities with the largest mean between two times."""
    inside = df.filter(F.col(ts).between(F.lit(start), F.lit(end)))
    return top_groups(inside, entity, F.avg(value), top, "avg_value")


def feature_frequency(df: DataFrame, lists: dict[str, Column]) -> DataFrame:
    """How often each feature is named in each list column, and in total."""
    tagged = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("src"), c.alias("items")) for n, c in lists.items()])).alias("l"))
    flat = tagged.select("l.src", F.explode("l.items").alias("feature"))
    counts = flat.groupBy("feature").agg(*[F.count_if(F.col("src") == n).alias(f"{n}_count") for n in lists], F.count(F.lit(1)).alias("total_count"))
    return counts.orderBy(F.desc("total_count"), "feature")


def fit_scale(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """One-parameter least squares y = a x, with the error before and after.

    The errors follow from the same sums, so one aggregate is enough.
    """
    xy, xx = F.sum(F.col(x) * F.col(y)), F.sum(F.col(x) * F.col(x))
    yy, n = F.sum(F.col(y) * F.col(y)), F.count(F.lit(1))
    sums = pairs.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(xy.alias("xy"), xx.alias("xx"), yy.alias("yy"), n.alias("n"))
    a = F.when(F.col("xx") != 0, F.col("xy") / F.col("xx")).otherwise(F.lit(1.0))
    rmse = lambda s: F.sqrt(F.greatest((s * s * F.col("xx") - 2 * s * F.col("xy") + F.col("yy")) / F.col("n"), F.lit(0.0)))
    return sums.withColumn("scale", a).select("scale", rmse(F.lit(1.0)).alias("rmse_before"), rmse(F.col("scale")).alias("rmse_after"), "n")


def grid_errors(pairs: DataFrame, estimates: dict[str, tuple[str, str]], grid: Sequence[dict[str, float]]) -> DataFrame:
    """Error of scaled estimates for every parameter combination, best first.

    ``estimates`` maps a name to (estimate, truth) columns; each grid entry
    gives the scale per name. The table is read once: per name only three sums
    are needed, whatever the size of the grid.
    """
    names = list(estimates)
    usable = pairs
    for e, t in estimates.values():
        usable = usable.filter(F.col(e).isNotNull() & F.col(t).isNotNull())
    aggs = [F.count(F.lit(1)).alias("n")]
    for k, (e, t) in estimates.items():
        aggs += [F.sum(F.col(e) * F.col(e)).alias(f"{k}_xx"), F.sum(F.col(e) * F.col(t)).alias(f"{k}_xy"), F.sum(F.col(t) * F.col(t)).alias(f"{k}_yy")]
    points = F.explode(F.array(*[F.struct(*[F.lit(float(p[k])).alias(f"{k}_scale") for k in names]) for p in grid])).alias("p")
    out = usable.agg(*aggs).select("*", points).select("*", "p.*").drop("p")

    def rmse(k: str) -> Column:
        s = F.col(f"{k}_scale")
        return F.sqrt(F.greatest((s * s * F.col(f"{k}_xx") - 2 * s * F.col(f"{k}_xy") + F.col(f"{k}_yy")) / F.col("n"), F.lit(0.0)))

    out = out.withColumns({f"{k}_rmse": rmse(k) for k in names})
    total = sum((F.col(f"{k}_rmse") for k in names[1:]), F.col(f"{names[0]}_rmse"))
    return out.filter("n > 0").select(*[f"{k}_scale" for k in names], *[f"{k}_rmse" for k in names], total.alias("sum_rmse"), "n").orderBy("sum_rmse")


def correlations(df: DataFrame, target: str, columns: Sequence[str] | None = None) -> DataFrame:
    """(feature, corr) for every numeric column, from one aggregate pass."""
    from entitystats.operators.normalize import numeric_columns

    names = [c for c in (columns or numeric_columns(df)) if c != target]
    row = df.agg(*[F.corr(F.col(c).cast("double"), F.col(target).cast("double")).alias(c) for c in names])
    return row.unpivot([], names, "feature", "corr")


def select_by_correlation(df: DataFrame, target: str, threshold: float = 0.01, columns: Sequence[str] | None = None) -> DataFrame:
    """Features with |corr| at or above the threshold; undefined ones are left out."""
    return correlations(df, target, columns).filter(~F.isnan("corr") & (F.abs("corr") >= threshold))


def exceedance(
    history: DataFrame, lookups: DataFrame, entity: str, value: str, x: str, min_rows: int = 3, max_rows: int | None = None
) -> DataFrame:
    """Share of an entity's historical values above ``x``, per distinct (entity, x).

    Entities with fewer than ``min_rows`` values use the values of all
    entities. Both sides are combined per value first and merged in value
    order, so no pairs are formed.
    """
    limit = max_rows or max_rows_per_task(history.sparkSession)
    known = history.filter(F.col(value).isNotNull()).select(entity, F.col(value).cast("double").alias("v"))
    heavy = heavy_keys(known, [entity], limit)  # before combining, so never too short
    counts = known.groupBy(entity, "v").agg(F.count(F.lit(1)).alias("w"))
    wants = lookups.select(entity, F.col(x).cast("double").alias("x")).filter("x IS NOT NULL").distinct()
    own = settled(_count_above(counts, wants, [entity], limit, heavy))
    enough = own.filter(F.col("n") >= min_rows).select(entity, "x", (F.col("above") / F.col("n")).alias("p_over"))
    few = own.filter(F.col("n") < min_rows).select(entity, "x")
    if few.isEmpty():
        return enough
    pooled = known.groupBy("v").agg(F.count(F.lit(1)).alias("w")).withColumn("__all", whole_key("v"))
    # all rows bound the number of distinct values, and counting them is cheap
    total = known.count()
    heavy = [(0, total)] if 0 < limit < total else []
    shared = _count_above(pooled, few.select("x", whole_key("x").alias("__all")).distinct(), ["__all"], limit, heavy)
    shared = shared.filter("n > 0").select("x", (F.col("above") / F.col("n")).alias("p_over"))
    return enough.unionByName(few.join(shared, "x").select(entity, "x", "p_over"))


def _count_above(counts: DataFrame, wants: DataFrame, keys: list[str], max_rows: int, heavy: list[tuple] | None = None) -> DataFrame:
    """(keys, x, above, n): values above x and all values, per wanted x."""
    merged = counts.select(*keys, "v", F.lit(0).alias("kind"), "w").unionByName(
        wants.select(*keys, F.col("x").alias("v"), F.lit(1).alias("kind"), F.lit(0).cast("bigint").alias("w"))
    )
    line = Timeline(merged, keys, ["v", "kind"], max_rows, heavy).running(__upto=("sum", F.col("w"), True)).totals(__n=("sum", F.col("w")))
    return line.result().filter("kind = 1").select(*keys, F.col("v").alias("x"), (F.col("__n") - F.col("__upto")).alias("above"), F.col("__n").alias("n"))


def agreement_percent(df: DataFrame, match: Column) -> DataFrame:
    """Rounded percentage of matching rows."""
    return df.agg(F.floor(100 * F.avg(F.coalesce(match, F.lit(False)).cast("double")) + 0.5).alias("agreement"))


def compare_by_key(a: DataFrame, b: DataFrame, key, columns: Sequence[str], ratio_cost: float | None = None) -> DataFrame:
    """Inner join of two reports with _a/_b columns, differences and, given a cost, gain per unit."""
    keys = as_list(key)
    left = a.select(*keys, *[F.col(c).alias(f"{c}_a") for c in columns])
    right = b.select(*keys, *[F.col(c).alias(f"{c}_b") for c in columns])
    out = left.join(right, keys).withColumns({f"delta_{c}": F.col(f"{c}_b") - F.col(f"{c}_a") for c in columns})
    if ratio_cost is not None:
        out = out.withColumns({f"gain_{c}_per_cost": F.col(f"delta_{c}") / F.lit(ratio_cost) for c in columns})
    return out


def mean_lookup(train: DataFrame, rows: DataFrame, entity, value: str, name: str = "pred") -> DataFrame:
    """Entity mean of the training rows, or the mean of all of them.

    The training rows are read once, for sums per entity that serve both means.
    """
    keys = as_list(entity)
    sums = settled(train.groupBy(*keys).agg(F.sum(F.col(value).cast("double")).alias("s"), F.count(value).alias("n")))
    overall = sums.agg((F.sum("s") / F.sum("n")).alias("m")).scalar()
    means = sums.select(*keys, (F.col("s") / F.nullif("n", F.lit(0))).alias(f"__{name}"))
    return join_per_key(rows, means, keys, "left").withColumn(name, F.coalesce(F.col(f"__{name}"), overall)).drop(f"__{name}")


def baseline_error(train: DataFrame, rows: DataFrame, entity, value: str, split: str = "split") -> DataFrame:
    """Mean absolute error per split of predicting the training mean."""
    return mean_lookup(train, rows, entity, value).groupBy(split).agg(F.avg(F.abs(F.col(value) - F.col("pred"))).alias("mae"), F.count(F.lit(1)).alias("n"))
