"""Whole feature rows, put together from the single operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entitystats.operators.context import opponent_adjusted, travel_features
from entitystats.operators.windows import latest_rows, rolling_summary
from entitystats.session import join_per_key, settled_small
from entitystats.skew import Timeline, as_list


def entity_features(
    games: DataFrame, requests: DataFrame, entity, ts: str, value: str, opponent: str, rating: str, current_opponent: str, current_rating: str,
    tie: Sequence[str] = (), team: str | None = None, seasons: DataFrame | None = None, max_rows: int | None = None,
) -> DataFrame:
    """One feature row per requested entity; gaps are 0.

    Recent form, form against the coming opponent and, given team codes, travel.
    ``seasons`` adds per-entity multi-season columns. All parts are grouped by
    entity, so joining them needs no further shuffle of the games.
    """
    keys = as_list(entity)
    asked = settled_small(requests)
    form = rolling_summary(games, keys, ts, value, tie, max_rows=max_rows)
    moments = games.groupBy(*keys).agg(F.avg(value).alias("recent_mean"), F.stddev_pop(value).alias("recent_std"))
    versus = opponent_adjusted(games, asked, keys, ts, value, opponent, rating, current_opponent, current_rating, tie)
    out = asked.join(form, keys, "left").join(moments, keys, "left").join(versus, keys, "left")
    if team is not None:
        out = travel_features(out, team, current_opponent)
    if seasons is not None:
        out = out.join(seasons, keys, "left")
    return out.fillna(0)


def spec_samples(
    specs: DataFrame, games: DataFrame, entity, ts: str, value: str, n: int = 82, tie: Sequence[str] = (), causal: bool = False, max_rows: int | None = None
) -> DataFrame:
    """Training samples for (entity, time, label...) rows: recent mean and deviation.

    By default the newest n games of the entity count, whatever the sample's
    time (which lets later games in); ``causal=True`` uses all games strictly
    before it.
    """
    keys = as_list(entity)
    if not causal:
        recent = latest_rows(games.filter(F.col(value).isNotNull()), keys, ts, n, tie)
        stats = recent.groupBy(*keys).agg(F.avg(value).alias("recent_mean"), F.stddev_pop(value).alias("recent_std"))
        return join_per_key(specs, stats, keys, "left")
    extra = [c for c in specs.columns if c not in [*keys, ts]]
    # values are taken from their overall mean, so that squares stay small
    centre = F.coalesce(games.agg(F.avg(value).alias("m")).scalar(), F.lit(0.0))
    v = F.col(value).cast("double") - centre
    left = specs.select(*keys, ts, F.lit(0).alias("__side"), F.lit(None).cast("double").alias("__v"), *[F.col(c).alias(f"l_{c}") for c in extra])
    right = games.select(*keys, ts, F.lit(1).alias("__side"), v.alias("__v"), *[F.lit(None).alias(f"l_{c}") for c in extra])
    x = F.col("__v")
    line = Timeline(left.unionByName(right), keys, [ts, "__side"], max_rows).running(
        __c=("count", x, False), __s=("sum", x, False), __q=("sum", x * x, False)
    )
    mean = F.when(F.col("__c") > 0, F.col("__s") / F.col("__c"))
    spread = F.sqrt(F.greatest(F.col("__q") / F.col("__c") - mean * mean, F.lit(0.0)))
    return line.result().filter("__side = 0").select(
        *keys, ts, *[F.col(f"l_{c}").alias(c) for c in extra], (mean + centre).alias("recent_mean"), F.when(F.col("__c") > 0, spread).alias("recent_std")
    )
