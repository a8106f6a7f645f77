"""Betting-line feed: flattening, grouping, filters and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entitystats.session import settled_small
from entitystats.skew import broadcast_if_small

#: Feed resource types and the status that is kept - fixed values.
PLAYER_TYPE, LEAGUE_TYPE, LEAD_STATUS = "new_player", "league", "pre_game"

FEED_SCHEMA = (
    "data array<struct<id string, type string,"
    " attributes struct<stat_type string, line_score double, start_time string, status string>,"
    " relationships struct<new_player struct<data struct<id string>>, league struct<data struct<id string>>,"
    " game struct<data struct<id string>>>>>,"
    " included array<struct<id string, type string, attributes struct<name string, team string, position string>>>"
)


def flatten_feed(feed: DataFrame, lead_only: bool = True) -> DataFrame:
    """One row per line with its player and league names.

    Missing includes are "Unknown", a missing line is 0. Only lines that have
    not started are kept unless ``lead_only`` is off.
    """
    inc = feed.select(F.explode("included").alias("i")).select("i.id", "i.type", "i.attributes.*")
    unknown = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("Unknown"))
    players = inc.filter(F.col("type") == PLAYER_TYPE).groupBy(F.col("id").alias("player_id")).agg(
        F.max_by(F.struct(unknown("name").alias("player"), unknown("team").alias("team"), unknown("position").alias("position")), "id").alias("p")
    )
    leagues = inc.filter(F.col("type") == LEAGUE_TYPE).groupBy(F.col("id").alias("league_id")).agg(F.max(unknown("name")).alias("league"))
    d = feed.select(F.explode("data").alias("d")).select(
        F.col("d.id").alias("id"), F.col("d.relationships.new_player.data.id").alias("player_id"), F.col("d.relationships.league.data.id").alias("league_id"),
        F.col("d.relationships.game.data.id").alias("game_id"), F.coalesce(F.nullif(F.col("d.attributes.stat_type"), F.lit("")), F.lit("unknown")).alias("stat"),
        F.coalesce("d.attributes.line_score", F.lit(0.0)).alias("line"), F.coalesce("d.attributes.start_time", F.lit("")).alias("start_time"),
        F.coalesce(F.nullif(F.col("d.attributes.status"), F.lit("")), F.lit("unknown")).alias("status"),
    )
    if lead_only:
        d = d.filter(F.col("status") == LEAD_STATUS)
    out = d.join(settled_small(players), "player_id", "left").join(settled_small(leagues), "league_id", "left")
    name = lambda c: F.coalesce(c, F.lit("Unknown"))
    return out.select(
        "id", *[name(F.col(f"p.{c}")).alias(c) for c in ("player", "team", "position")], name(F.col("league")).alias("league"),
        "stat", "line", "start_time", "status", "game_id",
    )


def enrich(lines: DataFrame, players: DataFrame, leagues: DataFrame, player_key: str, league_key: str) -> DataFrame:
    """Names from two dimension tables, "Unknown" where absent, line 0 where absent."""
    out = lines.join(broadcast_if_small(players), player_key, "left").join(broadcast_if_small(leagues), league_key, "left")
    names = [c for c in [*players.columns, *leagues.columns] if c not in (player_key, league_key)]
    fills = {c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("Unknown")) for c in names}
    return out.withColumns({**fills, "line": F.coalesce("line", F.lit(0.0))})


def line_groups(lines: DataFrame, player: str = "player", stat: str = "stat", line: str = "line", start: str = "start_time", ident: str = "id") -> DataFrame:
    """Per player and stat: count, range and mean of the lines and the latest line.

    Of several lines with the latest start the smallest id stands for the group.
    """
    v = F.coalesce(F.col(line).try_cast("double"), F.lit(0.0))
    latest = F.max_by(F.struct(F.col(ident).alias("id"), v.alias("line"), F.col(start).alias("start")), F.struct(F.col(start), -F.col(ident).cast("bigint")))
    return (
        lines.groupBy(player, stat)
        .agg(F.count(F.lit(1)).alias("count"), F.min(v).alias("min_line"), F.max(v).alias("max_line"), F.avg(v).alias("avg_line"), latest.alias("rep"))
        .select(player, stat, "count", "min_line", "max_line", "avg_line", F.col("rep.id").alias("rep_id"), F.col("rep.line").alias("rep_line"))
    )


def line_filter(lines: DataFrame, league: str | None = None, stat: str | None = None, player: str | None = None) -> DataFrame:
    """Equal league and stat, case-insensitive part of the player name."""
    out = lines
    if league:
        out = out.filter(F.col("league") == league)
    if stat:
        out = out.filter(F.col("stat") == stat)
    if player:
        out = out.filter(F.lower("player").contains(player.lower()))
    return out


def line_page(lines: DataFrame, offset: int = 0, limit: int = 50, ident: str = "id", **filters) -> tuple[DataFrame, DataFrame]:
    """(page in id order, total matched)."""
    found = line_filter(lines, **filters)
    return found.orderBy(ident).offset(offset).limit(limit), found.agg(F.count(F.lit(1)).alias("total"))


def distinct_values(lines: DataFrame, column: str, **filters) -> DataFrame:
    """Sorted distinct non-empty values under the other filters."""
    found = line_filter(lines, **filters)
    return found.filter(F.length(F.col(column)) > 0).select(column).distinct().orderBy(column)


def player_mappings(lines: DataFrame) -> DataFrame:
    """Distinct (player, league, stat)."""
    return lines.select("player", "league", "stat").distinct()


def player_counts(lines: DataFrame, search: str | None = None, scanned: bool = False, **filters) -> DataFrame:
    """Lines per player, most first, name ascending.

    With league or stat filters the players are filtered but keep their counts
    over all lines; ``scanned`` counts only the filtered lines instead.
    """
    base = line_filter(lines, **filters) if scanned else lines
    counts = base.filter(F.length("player") > 0).groupBy("player").agg(F.count(F.lit(1)).alias("count"))
    if filters and not scanned:
        counts = counts.join(line_filter(lines, **filters).select("player").distinct(), "player", "left_semi")
    if search:
        counts = counts.filter(F.lower("player").contains(search.lower()))
    return counts.orderBy(F.desc("count"), "player")


def feed_totals(lines: DataFrame) -> DataFrame:
    """Lines, players and leagues."""
    return lines.agg(F.count(F.lit(1)).alias("lines"), F.count_distinct("player").alias("players"), F.count_distinct("league").alias("leagues"))


#: What every item of an analysis must have - fixed values.
ITEM_KEYS = ["player", "stat", "line", "recommendation", "confidence", "numericEvidence", "reasoning", "dataUsed"]


def output_reasons(items: Column, expected: Column) -> Column:
    """Messages about a whole analysis: no array at all, or another number of items than asked for."""
    wrong = F.concat(F.lit("Expected "), expected.cast("string"), F.lit(" elements, got "), F.size(items).cast("string"))
    return F.array_compact(F.array(F.when(items.isNull(), F.lit("Output is not a JSON array")).when(F.size(items) != expected, wrong)))


def evidence_reasons(
    item: dict[str, Column], trusted: dict[str, Column], index: Column
) -> Column:
    """Messages for parts of a claimed analysis that the trusted context does not bear out.

    Keys used when present in both: recent_values (arrays), season_avg,
    opponent, opp_def, pace, minutes; ``item`` also has recommendation,
    confidence and keys (an array of the names it has). A claim that is there
    but is no number does not match.
    """
    say = lambda text: F.concat(F.lit("Item "), index.cast("string"), F.lit(f" {text}"))
    reasons = []
    if "keys" in item:
        reasons += [F.when(~F.array_contains(item["keys"], k), say(f"missing key '{k}'")) for k in ITEM_KEYS]
    if "recommendation" in item:
        r = item["recommendation"]
        reasons.append(F.when(r.isNotNull() & ~r.isin("OVER", "UNDER"), say("recommendation must be OVER/UNDER/null")))
    if "confidence" in item:
        c = item["confidence"]
        reasons.append(F.when(c.isNotNull() & (c != "") & ~c.isin("High", "Medium", "Low"), say("confidence must be High/Medium/Low")))
    if "recent_values" in item and "recent_values" in trusted:
        stranger = F.get(F.array_except(F.array_compact(item["recent_values"]), F.array_compact(trusted["recent_values"])), F.lit(0))
        reasons.append(F.when(stranger.isNotNull(), F.concat(say("recentGames value "), stranger.cast("string"), F.lit(" not present in trusted context"))))

    def off(key: str, tolerance: Column, message: str) -> Column:
        claim = item[key].try_cast("double")
        wrong = claim.isNull() | F.isnan(claim) | (F.abs(claim - trusted[key]) > tolerance)
        return F.when(item[key].isNotNull() & trusted[key].isNotNull() & wrong, say(message))

    if "season_avg" in item and "season_avg" in trusted:
        reasons.append(off("season_avg", F.greatest(F.lit(0.5), F.abs(trusted["season_avg"]) * 0.05), "seasonAvg mismatch with trusted context beyond tolerance"))
    if "opponent" in item and "opponent" in trusted:
        differs = (item["opponent"] != "") & (trusted["opponent"] != "") & (item["opponent"] != trusted["opponent"])
        reasons.append(F.when(differs, say("opponent.name mismatch (model vs trusted)")))
    for key, tolerance, what in (("opp_def", 1.0, "opponent.defensiveRating"), ("pace", 1.0, "opponent.pace"), ("minutes", 1.5, "projectedMinutes")):
        if key in item and key in trusted:
            reasons.append(off(key, F.lit(tolerance), f"{what} mismatch beyond tolerance"))
    return F.array_compact(F.array(*reasons))
