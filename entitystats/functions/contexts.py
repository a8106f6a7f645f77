"""Casting loosely typed context JSON to a fixed nested type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What the backend may send; numbers may come as text.
RAW_CONTEXT = (
    "player string, stat string, recent string, season string, seasonAvg string, notes string, note string, projectedMinutes string,"
    " noGamesThisSeason boolean, lastSeason string, lastGameDate string, teamId string,"
    " recentGames array<struct<date string, gameDate string, statValue string, opponentTeamId string, opponent string,"
    " opponentAbbrev string, opponentDefRating string, opponentDef string, opponentPace string>>,"
    " rollingAverages map<string, string>, opponent struct<name string, defensiveRating string, pace string>,"
    " contextualFactors struct<daysRest string, isBackToBack boolean>, seasonsConsidered array<string>"
)


def parse_context(text: Column) -> Column:
    return F.from_json(text, RAW_CONTEXT)


def normalise_context(raw: Column) -> Column:
    """Typed context; null when it has no games, no average and no no-games note."""
    num = lambda c: c.try_cast("double")
    games = F.transform(
        raw["recentGames"],
        lambda g: F.struct(F.coalesce(F.nullif(g["date"], F.lit("")), g["gameDate"]).alias("date"), num(g["statValue"]).alias("stat_value")),
    )
    rolling = F.transform_values(raw["rollingAverages"], lambda _, v: num(v))
    opponent = F.when(
        raw["opponent"].isNotNull(),
        F.struct(
            raw["opponent"]["name"].alias("name"), num(raw["opponent"]["defensiveRating"]).alias("defensive_rating"), num(raw["opponent"]["pace"]).alias("pace")
        ),
    )
    factors = F.when(
        raw["contextualFactors"].isNotNull(),
        F.struct(num(raw["contextualFactors"]["daysRest"]).alias("days_rest"), raw["contextualFactors"]["isBackToBack"].alias("is_back_to_back")),
    )
    none = F.coalesce(raw["noGamesThisSeason"], F.lit(False))
    empty = raw.isNull() | ((F.coalesce(F.size(raw["recentGames"]), F.lit(0)) <= 0) & num(raw["seasonAvg"]).isNull() & ~none)
    return F.when(
        ~empty,
        F.struct(
            raw["player"].alias("player"), raw["stat"].alias("stat"), raw["recent"].alias("recent"), games.alias("recent_games"), num(raw["seasonAvg"]).alias("season_avg"),
            opponent.alias("opponent"), num(raw["projectedMinutes"]).alias("projected_minutes"), none.alias("no_games_this_season"),
            factors.alias("contextual_factors"), rolling.alias("rolling_averages"), raw["teamId"].try_cast("double").cast("bigint").alias("team_id"),
            raw["seasonsConsidered"].alias("seasons_considered"),
        ),
    )


def opponent_of_latest(raw: Column) -> Column:
    """Team, rating and pace of the opponent in the newest (first) game."""
    g = F.get(raw["recentGames"], F.lit(0))
    text = lambda *names: F.coalesce(*[F.nullif(g[n], F.lit("")) for n in names])
    rating = F.coalesce(F.nullif(g["opponentDefRating"].try_cast("double"), F.lit(0.0)), F.nullif(g["opponentDef"].try_cast("double"), F.lit(0.0)))
    return F.when(
        g.isNotNull(),
        F.struct(
            text("opponentTeamId", "opponent", "opponentAbbrev").alias("team_id"), rating.alias("defensive_rating"),
            F.nullif(g["opponentPace"].try_cast("double"), F.lit(0.0)).alias("pace"),
        ),
    )


def rolling_entries(values: Column) -> Column:
    """The rolling-average entries of a feature map."""
    return F.map_filter(
        values,
        lambda k, _: k.startswith("last_") | k.contains("exponential") | k.startswith("wma_") | k.isin("slope_10", "momentum_vs_5_avg"),
    )
