"""Request context: latest form, opponents, travel, point-in-time history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entitystats.functions.teams import HIGH_ALTITUDE_M, coordinates, haversine_km, rival_pairs
from entitystats.session import max_rows_per_task, settled_small
from entitystats.skew import Timeline, as_list, heavy_keys, null_safe_join

#: Parts that the history of an entity is dealt over.
FORM_PARTS = 16


def opponent_adjusted(
    history: DataFrame, requests: DataFrame, entity, ts: str, value: str, opponent: str, rating: str,
    current_opponent: str, current_rating: str, tie: Sequence[str] = (), max_rows: int | None = None,
) -> DataFrame:
    """One row per request: form against the coming opponent and its kind.

    ``requests`` has one row per entity with the coming opponent and rating.
    Stronger means a rating at or below the current one, similar within two
    points. The history of an entity above the row limit is dealt over
    ``FORM_PARTS`` parts by a hash of its rows, which meet as many copies of the
    entity's one request; the sums of the parts are added up. So no task sees a
    whole hot entity. Pass ``settled_small`` requests to have a small request
    table broadcast.
    """
    keys = as_list(entity)
    v = F.col(value).cast("double")
    heavy = heavy_keys(history, keys, max_rows or max_rows_per_task(history.sparkSession))
    if heavy:
        # rows / limit of them at most
        hot = history.sparkSession.createDataFrame([(*h[:-1], True) for h in heavy], T.StructType([*[history.schema[k] for k in keys], T.StructField("__hot", T.BooleanType())]))
        dealt = lambda df, part: null_safe_join(df, F.broadcast(hot), keys).withColumn("__part", F.when(F.col("__hot"), part).otherwise(F.lit(0))).drop("__hot")
        asked = null_safe_join(requests, F.broadcast(hot), keys)
        asked = asked.withColumn("__part", F.explode(F.sequence(F.lit(0), F.when(F.col("__hot"), F.lit(FORM_PARTS - 1)).otherwise(F.lit(0))))).drop("__hot")
        joined = dealt(history, F.pmod(F.xxhash64(ts, *tie, value, opponent), F.lit(FORM_PARTS)).cast("int")).join(asked, [*keys, "__part"])
    else:
        joined = history.join(requests, keys).withColumn("__part", F.lit(0))
    same = F.col(opponent).cast("string") == F.col(current_opponent).cast("string")
    stronger = F.col(rating) <= F.col(current_rating)
    similar = F.abs(F.col(rating) - F.col(current_rating)) <= 2.0
    at = F.struct(*[F.col(c) for c in [ts, *tie]])
    meeting = F.when(same & v.isNotNull(), at)
    kinds = {"same": same, "stronger": stronger, "similar": similar}
    sums = joined.groupBy(*keys, "__part").agg(
        *[F.count(F.when(on, v)).alias(f"__n_{k}") for k, on in kinds.items()], *[F.sum(F.when(on, v)).alias(f"__s_{k}") for k, on in kinds.items()],
        F.max(meeting).alias("__at"), F.max_by(F.struct(F.col(ts).alias("ts"), v.alias("v")), meeting).alias("__last"),
    )
    mean = lambda k: F.sum(f"__s_{k}") / F.nullif(F.sum(f"__n_{k}"), F.lit(0))
    last = F.max_by("__last", "__at")
    form = sums.groupBy(*keys).agg(
        F.sum("__n_same").alias("games_vs_current_opponent"),
        mean("same").alias("avg_vs_current_opponent"),
        mean("stronger").alias("avg_vs_stronger_def"),
        mean("similar").alias("avg_vs_similar_def"),
        last["ts"].alias("last_game_vs_current_opponent_date"),
        last["v"].alias("last_game_vs_current_opponent_stat"),
    )
    out = requests.select(*keys).join(form, keys, "left")
    return out.withColumn("games_vs_current_opponent", F.coalesce("games_vs_current_opponent", F.lit(0).cast("bigint")))


def travel_features(df: DataFrame, team: str, opponent: str) -> DataFrame:
    """Distance, altitude, high-altitude flag and rivalry flag for two team codes.

    The look-up tables are fixed and small, so the table itself does not move.
    """
    spark = df.sparkSession
    place = coordinates(spark)
    side = lambda p: place.select(F.col("code").alias(f"__{p}"), *[F.col(c).alias(f"__{p}_{c}") for c in ("lat", "lon", "altitude_m")])
    pair = rival_pairs(spark).withColumn("__rival", F.lit(1))
    t, o = F.upper(F.col(team)), F.upper(F.col(opponent))
    out = df.join(F.broadcast(side("t")), t == F.col("__t"), "left").join(F.broadcast(side("o")), o == F.col("__o"), "left")
    out = out.join(F.broadcast(pair), (F.least(t, o) == F.col("low")) & (F.greatest(t, o) == F.col("high")), "left")
    known = F.col("__t").isNotNull() & F.col("__o").isNotNull()
    km = haversine_km(F.col("__t_lat"), F.col("__t_lon"), F.col("__o_lat"), F.col("__o_lon"))
    alt = F.when(known, F.col("__o_altitude_m")).otherwise(F.lit(0.0))
    return out.withColumns(
        {
            "is_rivalry": F.coalesce("__rival", F.lit(0)),
            "travel_distance_km": F.when(known, km).otherwise(F.lit(0.0)),
            "opp_altitude_m": alt,
            "is_high_altitude_opp": (alt >= HIGH_ALTITUDE_M).cast("int"),
        }
    ).drop("__rival", "low", "high", *[f"__{p}{s}" for p in "to" for s in ("", "_lat", "_lon", "_altitude_m")])


def game_flags(df: DataFrame, playoff: Sequence[str] = (), game_type: Sequence[str] = (), national: Sequence[str] = ()) -> DataFrame:
    """``is_playoff`` and ``is_national_tv`` from any of several flag columns."""
    any_of = lambda names: _any(df, names)
    typed = F.lit(False)
    for c in game_type:
        if c in df.columns:
            typed = typed | F.coalesce(F.col(c) == "Playoffs", F.lit(False))
    return df.withColumns({"is_playoff": (any_of(playoff) | typed).cast("int"), "is_national_tv": any_of(national).cast("int")})


def _any(df: DataFrame, names: Sequence[str]) -> Column:
    hit = F.lit(False)
    for c in names:
        if c in df.columns:
            hit = hit | F.coalesce(F.col(c).cast("boolean"), F.lit(False))
    return hit


def as_of(left: DataFrame, right: DataFrame, entity, ts: str, columns: Sequence[str], tie: Sequence[str] = (), max_rows: int | None = None) -> DataFrame:
    """Each left row with the latest right row strictly before it.

    Both sides are merged in time order; a running maximum of (time, values)
    carries the latest right row forward, so one shuffle serves the join and no
    pairs are formed. ``tie`` orders right rows of one time.
    """
    keys = as_list(entity)
    extra = [c for c in left.columns if c not in [*keys, ts]]
    state = F.struct(F.col(ts), *[F.col(c) for c in tie], *[F.col(c).alias(f"v_{c}") for c in columns])
    r = right.select(*keys, ts, F.lit(1).alias("__side"), state.alias("__state"), *[F.lit(None).alias(f"l_{c}") for c in extra])
    l = left.select(*keys, ts, F.lit(0).alias("__side"), F.lit(None).cast(r.schema["__state"].dataType).alias("__state"), *[F.col(c).alias(f"l_{c}") for c in extra])  # noqa: E741
    # at one time the left row comes first, so only earlier right rows count
    merged = l.unionByName(r)
    line = Timeline(merged, keys, [ts, "__side"], max_rows).running(__seen=("max", F.col("__state"), False))
    return line.result().filter("__side = 0").select(
        *keys, ts, *[F.col(f"l_{c}").alias(c) for c in extra], F.col(f"__seen.{ts}").alias(f"{ts}_before"), *[F.col(f"__seen.v_{c}").alias(f"{c}_before") for c in columns]
    )


def prior_average(left: DataFrame, right: DataFrame, entity, ts: str, value: str, max_rows: int | None = None) -> DataFrame:
    """Each left row with count and mean of the right values strictly before it."""
    keys = as_list(entity)
    extra = [c for c in left.columns if c not in [*keys, ts]]
    l = left.select(*keys, ts, F.lit(0).alias("__side"), F.lit(None).cast("double").alias("__v"), *[F.col(c).alias(f"l_{c}") for c in extra])  # noqa: E741
    r = right.select(*keys, ts, F.lit(1).alias("__side"), F.col(value).cast("double").alias("__v"), *[F.lit(None).alias(f"l_{c}") for c in extra])
    line = Timeline(l.unionByName(r), keys, [ts, "__side"], max_rows).running(__s=("sum", F.col("__v"), False), __n=("count", F.col("__v"), False))
    mean = F.when(F.col("__n") > 0, F.col("__s") / F.col("__n"))
    return line.result().filter("__side = 0").select(*keys, ts, *[F.col(f"l_{c}").alias(c) for c in extra], F.col("__n").alias("n_before"), mean.alias("avg_before"))


def batch_context(requests: DataFrame, contexts: DataFrame, key: str) -> DataFrame:
    """Requests with their context in request order, and an error where there is none.

    ``requests`` is (pos, key...). A blank key is reported as missing.
    """
    found = contexts.withColumn("__found", F.lit(True))
    out = requests.join(found, key, "left")
    blank = F.coalesce(F.trim(F.col(key).cast("string")), F.lit("")) == ""
    error = F.when(blank, f"missing {key}").when(F.col("__found").isNull(), "not found")
    return out.withColumn("error", error).drop("__found")


def request_positions(spark, items: Sequence, key: str, kind: str = "string") -> DataFrame:
    """(pos, key) of a request list; the list is a parameter, not a table."""
    return spark.createDataFrame(list(enumerate(items)), f"pos int, {key} {kind}")


def lookup_by_ids(df: DataFrame, ids: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """Rows of the requested ids in request order; unknown ids are left out."""
    return ids.join(df, key).orderBy(pos)


def overlay(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str], now: Column, stamp: str = "fetched_at") -> DataFrame:
    """New field values over old ones; stamped now where no time is known; unknown ids are ignored."""
    side = new.select(key, *[F.col(c).alias(f"__n_{c}") for c in [*fields, stamp] if c in new.columns], F.lit(True).alias("__hit"))
    out = old.join(side, key, "left")
    cols = {c: F.coalesce(F.col(f"__n_{c}"), F.col(c)) if f"__n_{c}" in side.columns else F.col(c) for c in [*fields, stamp]}
    cols[stamp] = F.when(F.col("__hit"), F.coalesce(cols[stamp], now)).otherwise(F.col(stamp))
    return out.withColumns(cols).drop("__hit", *[f"__n_{c}" for c in [*fields, stamp]])


def player_contexts(games: DataFrame, entity, ts: str, value: str, tie: Sequence[str] = (), n: int = 8) -> DataFrame:
    """Nested context per entity: newest n games, text, averages, rest.

    The list holds at most n games, so it stays small for any entity.
    """
    from entitystats.functions.text import recent_games_text
    from entitystats.operators.windows import latest_rows

    keys = as_list(entity)
    recent = latest_rows(games, keys, ts, n, tie, rank="__rn")
    game = F.struct(F.col("__rn"), F.col(ts).alias("date"), F.col(value).cast("double").alias("stat_value"))
    grouped = recent.groupBy(*keys).agg(F.array_sort(F.collect_list(game)).alias("__g"), F.avg(value).alias("recent_mean"))
    games_ = F.transform("__g", lambda g: F.struct(g["date"].alias("date"), g["stat_value"].alias("stat_value")))
    gap = F.datediff(F.get("__g", F.lit(0))["date"].cast("date"), F.get("__g", F.lit(1))["date"].cast("date"))
    rest = F.when(F.size("__g") >= 2, F.greatest(F.lit(0), gap - 1))
    return grouped.select(
        *keys, games_.alias("recent_games"), recent_games_text(F.transform("__g", lambda g: g["stat_value"])).alias("recent"),
        "recent_mean", F.struct(rest.alias("days_rest"), F.coalesce(rest == 0, F.lit(False)).alias("is_back_to_back")).alias("contextual_factors"),
    )


def season_merge(
    df: DataFrame, entity, season: str, seasons: Sequence[str], ts: str, per_season: int = 82, tie: Sequence[str] = (), newest_first: bool = False
) -> DataFrame:
    """Newest rows of each wanted season, at most ``per_season`` each; the season filter reaches the scan."""
    from entitystats.operators.windows import latest_rows

    out = latest_rows(df.filter(F.col(season).isin(list(seasons))), [*as_list(entity), season], ts, per_season, tie)
    return out.orderBy(*as_list(entity), F.desc(ts)) if newest_first else out


def league_zscores(entities: DataFrame, league: DataFrame, season: str, metrics: Sequence[str]) -> DataFrame:
    """Distance of an entity's metrics from the league of its season; 0 without spread or league."""
    aggs = [a for m in metrics for a in (F.avg(F.col(m).cast("double")).alias(f"__m_{m}"), F.stddev_pop(F.col(m).cast("double")).alias(f"__s_{m}"))]
    moments = league.groupBy(season).agg(*aggs)
    out = null_safe_join(entities, settled_small(moments), [season])
    z = {f"{m}_z": F.coalesce(F.when(F.col(f"__s_{m}") > 0, (F.col(m) - F.col(f"__m_{m}")) / F.col(f"__s_{m}")), F.lit(0.0)) for m in metrics}
    return out.withColumns(z).drop(*[f"__{k}_{m}" for m in metrics for k in "ms"])
