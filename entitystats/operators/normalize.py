"""Turning provider records into canonical columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entitystats.functions.dates import date_in_id, epoch_timestamp, parse_timestamp
from entitystats.functions.teams import team_code
from entitystats.functions.values import id_number, int_text, matchup_teams

#: Provider spellings per canonical column, in order of preference - fixed values.
GAME_ALIASES = {
    "game_id": ["game_id", "id", "gid"],
    "home_team": ["home_team", "homeTeam", "homeTeamName", "home_team_name", "h_team", "home"],
    "away_team": ["away_team", "awayTeam", "awayTeamName", "away_team_name", "a_team", "away"],
    "home_score": ["home_score", "homeScore", "home_pts", "homePoints", "hScore", "h_score", "h_pts", "home_points", "home-team-score"],
    "away_score": ["away_score", "awayScore", "away_pts", "awayPoints", "aScore", "a_score", "a_pts", "away_points", "away-team-score"],
    "timestamp": ["timestamp", "time", "utc_time", "start_time", "game_time"],
    "date": ["date", "game_date_str", "date_str"],
}

#: Spellings per statistic - fixed values.
STAT_ALIASES = {
    "points": ["PTS", "points", "statValue"],
    "assists": ["AST", "ast", "statValue"],
    "rebounds": ["REB", "reb", "statValue"],
}
STAT_FALLBACK = ["PTS", "AST", "REB", "points", "statValue"]

#: Where an event time may stand, in order - fixed values.
TIME_COLUMNS = ["game_date", "date", "timestamp", "game_date_str", "game_time", "start_time", "utc_time", "time"]
MATCHUP_POINTS = ["PTS", "PTS_PLAYER", "PLAYER_PTS", "PTS_HOME", "PTS_AWAY"]

CONTEXT_FLAGS = ["injury_sentiment", "morale_score", "motivation"]


def pick(df: DataFrame, names: Sequence[str], kind: str | None = None) -> Column | None:
    """First non-null of the columns that exist; None when none does."""
    found = [F.col(f"`{n}`") for n in names if n in df.columns]
    if not found:
        return None
    return F.coalesce(*[c.cast(kind) for c in found]) if kind else F.coalesce(*found)


def coalesce_aliases(df: DataFrame, aliases: dict[str, list[str]], kind: str | None = None) -> DataFrame:
    """One column per canonical name; a present canonical value wins."""
    found = {target: pick(df, [target, *names], kind) for target, names in aliases.items()}
    return df.withColumns({target: c for target, c in found.items() if c is not None})


def pick_stat(df: DataFrame, stat: str) -> Column:
    """The requested statistic, by its own name, upper case, then common names."""
    first = STAT_ALIASES.get(stat, ["PTS"])[0]
    column = pick(df, list(dict.fromkeys([first, first.upper(), *STAT_FALLBACK])), "double")
    return F.lit(None).cast("double") if column is None else column


def event_time(value: Column, kind: T.DataType) -> Column:
    """Timestamp from a timestamp, date, number (epoch) or text column."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return value.cast("timestamp")
    if isinstance(kind, T.NumericType):
        return F.when(value != 0, epoch_timestamp(value.cast("double")))
    is_epoch = value.rlike(r"^\d{9,}(\.\d+)?$")
    return F.when(is_epoch, epoch_timestamp(value.try_cast("double"))).when(value != "", parse_timestamp(value))


def resolve_event_time(df: DataFrame, columns: Sequence[str] = tuple(TIME_COLUMNS), id_column: str = "game_id") -> Column:
    """First time column that can be read, else a date inside the id."""
    tries = [event_time(F.col(c), df.schema[c].dataType) for c in columns if c in df.columns]
    if id_column in df.columns:
        tries.append(date_in_id(F.col(id_column).cast("string")).cast("timestamp"))
    return F.coalesce(*tries) if tries else F.lit(None).cast("timestamp")


def normalize_games(df: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Canonical columns, integer scores, team codes and ``game_date``.

    A score text that is no whole number is kept in ``<score>_raw`` and the
    score is null.
    """
    out = coalesce_aliases(df, GAME_ALIASES)
    for score in ("home_score", "away_score"):
        if score in out.columns and isinstance(out.schema[score].dataType, T.StringType):
            number = int_text(F.col(score))
            out = out.withColumns({f"{score}_raw": F.when(number.isNull(), F.col(score)), score: number})
    for team in ("home_team", "away_team"):
        if team in out.columns:
            out = out.withColumn(team, team_code(F.col(team), names))
    return out.withColumn("game_date", resolve_event_time(out))


def player_records(df: DataFrame, stat: str = "points") -> DataFrame:
    """League log rows as (player, date, sides, stat_type, value); rows without a value go."""
    blank = lambda c: F.lit(None).cast("string") if c is None else F.nullif(c.cast("string"), F.lit(""))
    sides = matchup_teams(blank(pick(df, ["MATCHUP", "matchup", "MATCH"])))
    home = blank(pick(df, ["HOME_TEAM_ABBREVIATION", "HOME_TEAM", "home_team"]))
    away = blank(pick(df, ["VISITOR_TEAM_ABBREVIATION", "VISITOR_TEAM", "away_team"]))
    team = blank(pick(df, ["TEAM_ABBREVIATION", "TEAM", "team"]))
    opponent = blank(pick(df, ["OPPONENT", "OPP_TEAM_ABBREVIATION", "OPP_TEAM", "OPPONENT_TEAM"]))
    both = home.isNotNull() & away.isNotNull()
    known = both | sides["home_team"].isNotNull()
    home = F.when(both, home).otherwise(F.coalesce(sides["home_team"], home))
    away = F.when(both, away).otherwise(F.coalesce(sides["away_team"], away))
    pair = ~known & team.isNotNull() & opponent.isNotNull()
    value = pick(df, MATCHUP_POINTS)
    none = F.lit(None)
    player = pick(df, ["PLAYER_NAME", "PLAYER", "player"])
    number = pick(df, ["PLAYER_ID", "player_id"])
    date = pick(df, ["GAME_DATE", "GAME_DATE_EST", "gameDate", "DATE", "date"])
    return df.select(
        (none.cast("string") if player is None else player).alias("player_name"),
        (none.cast("bigint") if number is None else number.try_cast("bigint")).alias("player_nba_id"),
        (none.cast("string") if date is None else date).alias("game_date"),
        F.coalesce(home, F.when(pair, team), F.lit("UNKNOWN")).alias("home_team"),
        F.coalesce(away, F.when(pair, opponent), F.lit("UNKNOWN")).alias("away_team"),
        F.lit(stat).alias("stat_type"),
        (none.cast("double") if value is None else value.try_cast("double")).alias("value"),
    ).filter(F.col("value").isNotNull())


def wide_to_long(df: DataFrame, keys: Sequence[str], measures: Sequence[str], name: str = "stat_type", value: str = "value") -> DataFrame:
    """One row per key and measure that has a value."""
    typed = df.select(*keys, *[F.col(m).cast("double").alias(m) for m in measures])
    return typed.unpivot(list(keys), list(measures), name, value).filter(F.col(value).isNotNull())


def active_entities(df: DataFrame, flags: Sequence[str], team_columns: Sequence[str] = (), name: str | None = None, top: int | None = None) -> DataFrame:
    """Rows with any flag set or any team id present.

    ``top`` keeps that many, flagged ones first and then by ``name``.
    """
    truthy = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).isin("", "0", "false") == F.lit(False)
    flagged, on_team = F.lit(False), F.lit(False)
    for c in flags:
        if c in df.columns:
            flagged = flagged | truthy(c)
    for c in team_columns:
        if c in df.columns:
            on_team = on_team | truthy(c)
    found = df.filter(flagged | on_team)
    if top is None:
        return found
    return found.orderBy(flagged.desc(), *([name] if name else [])).limit(top)


def ablate(df: DataFrame, prefixes: Sequence[str] = ("adv_", "multi_"), names: Sequence[str] = tuple(CONTEXT_FLAGS)) -> DataFrame:
    """Set a feature group to 0.0."""
    hit = [c for c in df.columns if c.startswith(tuple(prefixes)) or c in names]
    return df.withColumns({c: F.lit(0.0) for c in hit})


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def align_features(df: DataFrame, expected: Sequence[str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Exactly the expected numeric columns in order; absent, null and text are 0.0.

    Without ``expected`` all numeric columns stay as they are.
    """
    numeric = set(numeric_columns(df))
    names = list(expected) if expected is not None else [c for c in df.columns if c in numeric and c not in keep]
    cols = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in numeric else F.lit(0.0).alias(c) for c in names]
    return df.select(*keep, *cols)


def one_hot_levels(df: DataFrame, columns: Sequence[str], max_levels: int = 30) -> dict[str, list[str]]:
    """Distinct texts of each column that has at most ``max_levels`` of them.

    One approximate count over all columns sets the wide ones aside; each of
    the others is read back as at most ``max_levels`` + 2 distinct values.
    """
    rough = df.agg(*[F.approx_count_distinct(F.col(c)).alias(c) for c in columns]).first()
    levels = {}
    for c in columns:
        if rough[c] == 0 or rough[c] > 2 * max_levels:
            continue
        found = [r[0] for r in df.select(F.col(c).cast("string")).distinct().limit(max_levels + 2).collect()]
        if 0 < len([v for v in found if v is not None]) <= max_levels:
            levels[c] = sorted("None" if v is None else v for v in found)
    return levels


def prepare_features(df: DataFrame, max_levels: int = 30, keep: Sequence[str] = ()) -> DataFrame:
    """Numbers kept, texts with few levels one-hot coded, the rest dropped, nulls 0."""
    numeric = [c for c in numeric_columns(df) if c not in keep]
    texts = [c for c in df.columns if c not in numeric and c not in keep]
    levels = one_hot_levels(df, texts, max_levels) if texts else {}
    dummies = [
        (F.coalesce(F.col(c).cast("string"), F.lit("None")) == v).cast("double").alias(f"{c}_{v}")
        for c, values in levels.items()
        for v in values
    ]
    return df.select(*keep, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in numeric], *dummies)


def fit_width(df: DataFrame, n: int, keep: Sequence[str] = ()) -> DataFrame:
    """First n feature columns, padded with zero columns when there are fewer."""
    names = [c for c in df.columns if c not in keep]
    padding = [F.lit(0.0).alias(f"pad_{i}") for i in range(max(0, n - len(names)))]
    return df.select(*keep, *names[:n], *padding)


def match_ids(df: DataFrame, id_column: str, ids: DataFrame, ids_column: str) -> DataFrame:
    """Rows whose id is in a list of mixed id texts, with the id as bigint."""
    wanted = ids.select(id_number(F.col(ids_column).cast("string")).alias("__id")).filter("__id IS NOT NULL").distinct()
    typed = df.withColumn(id_column, id_number(F.col(id_column).cast("string")))
    return typed.join(wanted, typed[id_column] == wanted["__id"], "left_semi")
