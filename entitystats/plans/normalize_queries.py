"""Provider-record clean-up, on text columns derived from the test tables."""

from pyspark.sql import functions as F

from entitystats.functions import dates, teams, text, values
from entitystats.operators import normalize as N
from entitystats.plans.registry import query
from entitystats.plans.rounding import rounded


def _long(column):
    return column.cast("bigint")


@query(
    "normalize_aliases",
    """
    SELECT o_orderkey AS game_id, s_name AS home_team, CAST(floor(o_totalprice) AS BIGINT) AS home_score
    FROM (SELECT o_orderkey, o_orderstatus, upper(substr(o_orderpriority, 3, 3)) AS s_name, o_totalprice FROM orders)
    """,
)
def normalize_aliases(t):
    """Each order status writes its columns under other provider names."""
    team = F.substring("o_orderpriority", 3, 100)
    score = F.format_number(F.floor("o_totalprice"), 0)
    by_status = lambda s, c: F.when(F.col("o_orderstatus") == s, c)
    raw = t.orders.select(
        by_status("F", F.col("o_orderkey")).alias("game_id"),
        F.when(F.col("o_orderstatus") != "F", F.col("o_orderkey")).alias("gid"),
        by_status("F", team).alias("homeTeam"), by_status("O", team).alias("h_team"), by_status("P", team).alias("home"),
        by_status("F", score).alias("homeScore"), by_status("O", score).alias("h_pts"), by_status("P", score).alias("home-team-score"),
        F.col("o_orderdate").alias("timestamp"),
    )
    return N.normalize_games(raw).select("game_id", "home_team", "home_score")


@query(
    "event_time_formats",
    """
    SELECT event_id, CASE WHEN event_type IN ('click', 'view', 'error') THEN date_trunc('day', ts)
                          ELSE date_trunc('second', ts) END AS game_date
    FROM events
    """,
)
def event_time_formats(t):
    """Dates written as ISO day, US day, ISO instant, epoch seconds or inside the id."""
    kind, ts = F.col("event_type"), F.col("ts").cast("timestamp")
    raw = t.events.select(
        "event_id",
        F.when(kind == "click", F.date_format(ts, "yyyy-MM-dd"))
        .when(kind == "view", F.date_format(ts, "MM/dd/yyyy"))
        .when(kind == "purchase", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .alias("date"),
        F.when(kind == "signup", F.unix_timestamp(ts)).alias("timestamp"),
        F.concat(F.lit("nba_"), F.date_format(ts, "yyyyMMdd"), F.lit("_game")).alias("game_id"),
    )
    return raw.select("event_id", N.resolve_event_time(raw).cast("timestamp_ntz").alias("game_date"))


@query(
    "parse_dates",
    """
    SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS parsed FROM orders
    """,
)
def parse_dates(t):
    day = F.col("o_orderdate").cast("timestamp")
    layouts = {
        "1-URGENT": "yyyy-MM-dd",
        "2-HIGH": "MM/dd/yyyy",
        "3-MEDIUM": "yyyy-MM-dd'T'HH:mm:ss'Z'",
        "4-NOT SPECIFIED": "MMM d, yyyy",
        "5-LOW": "MMMM d, yyyy",
    }
    written = F.coalesce(*[F.when(F.col("o_orderpriority") == p, F.date_format(day, f)) for p, f in layouts.items()])
    return t.orders.select("o_orderkey", dates.parse_date(written).cast("string").alias("parsed"))


@query(
    "season_labels",
    """
    SELECT o_orderkey,
      CASE WHEN month(o_orderdate) >= 10 THEN printf('%d-%02d', CAST(year(o_orderdate) AS INTEGER), CAST((year(o_orderdate) + 1) % 100 AS INTEGER))
           ELSE printf('%d-%02d', CAST(year(o_orderdate) - 1 AS INTEGER), CAST(year(o_orderdate) % 100 AS INTEGER)) END AS oct_season,
      CASE WHEN month(o_orderdate) >= 8 THEN printf('%d-%02d', CAST(year(o_orderdate) AS INTEGER), CAST((year(o_orderdate) + 1) % 100 AS INTEGER))
           ELSE printf('%d-%02d', CAST(year(o_orderdate) - 1 AS INTEGER), CAST(year(o_orderdate) % 100 AS INTEGER)) END AS aug_season,
      CAST(year(o_orderdate) AS VARCHAR) AS year_season,
      CASE WHEN month(o_orderdate) >= 10 THEN printf('%d-%02d', CAST(year(o_orderdate) - 2 AS INTEGER), CAST((year(o_orderdate) - 1) % 100 AS INTEGER))
           ELSE printf('%d-%02d', CAST(year(o_orderdate) - 3 AS INTEGER), CAST((year(o_orderdate) - 2) % 100 AS INTEGER)) END AS two_before
    FROM orders
    """,
)
def season_labels(t):
    day = F.col("o_orderdate")
    oct_season = dates.season_label(day, 10)
    return t.orders.select(
        "o_orderkey",
        oct_season.alias("oct_season"),
        dates.season_label(day, 8).alias("aug_season"),
        F.year(day).cast("string").alias("year_season"),
        F.element_at(dates.previous_seasons(oct_season, 3), 3).alias("two_before"),
    )


@query(
    "numeric_texts",
    """
    SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS whole, CAST(o_custkey AS BIGINT) AS id_value,
           round(3.14159e-9 + (CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) + 35) + CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) / 60.0, 6) AS minutes,
           CAST(0 AS DOUBLE) AS bad_minutes,
           round(3.14159e-9 + CASE WHEN o_totalprice / 1000 > 1 THEN o_totalprice / 100000 ELSE o_totalprice / 1000 END, 6) AS share
    FROM orders
    """,
)
def numeric_texts(t):
    digit = F.substring("o_orderpriority", 1, 1).cast("int")
    clock = F.concat((digit + 35).cast("string"), F.lit(":"), F.lpad(digit.cast("string"), 2, "0"))
    percent = F.concat((F.col("o_totalprice") / 1000).cast("string"), F.lit("%"))
    return rounded(
        t.orders.select(
            "o_orderkey",
            values.int_text(F.concat(F.format_number(F.floor("o_totalprice"), 0), F.lit(" "))).alias("whole"),
            values.id_number(F.concat(F.col("o_custkey").cast("string"), F.lit(".0"))).alias("id_value"),
            dates.minutes_played(clock).alias("minutes"),
            dates.minutes_played(F.col("o_orderpriority")).alias("bad_minutes"),
            values.as_share(values.float_text(percent)).alias("share"),
        )
    )


_TEAM_SQL = "CASE s.k " + " ".join(f"WHEN {i} THEN '{row[0]}'" for i, row in enumerate(teams.TEAMS)) + " END"


@query(
    "team_codes",
    f"""
    WITH s AS (SELECT c_custkey, c_nationkey AS k, c_mktsegment AS seg FROM customer)
    SELECT c_custkey, CASE WHEN seg = 'MACHINERY' THEN upper(substr(seg, 1, 3)) ELSE {_TEAM_SQL} END AS team FROM s
    """,
)
def team_codes(t):
    """Codes, full names, nicknames and unknown words; the team follows the nation key."""
    by_nation = lambda pick: F.coalesce(*[F.when(F.col("c_nationkey") == i, F.lit(pick(r))) for i, r in enumerate(teams.TEAMS[:25])])
    seg = F.col("c_mktsegment")
    written = (
        F.when(seg == "MACHINERY", F.lower(seg))
        .when(seg == "BUILDING", by_nation(lambda r: r[0]))
        .when(seg == "FURNITURE", by_nation(lambda r: f" {r[1].title()} {r[2].title()} "))
        .when(seg == "HOUSEHOLD", by_nation(lambda r: f"The {r[2]}" if " " not in r[2] else r[2]))
        .otherwise(by_nation(lambda r: r[2].upper()))
    )
    return t.customer.select("c_custkey", teams.team_code(written).alias("team"))


@query(
    "matchups",
    """
    SELECT o_orderkey, CAST(o_orderstatus <> 'P' AS INTEGER) AS is_home,
           CASE WHEN o_orderstatus = 'P' THEN 'CCC' ELSE 'LAL' END AS home_team,
           CASE WHEN o_orderstatus = 'P' THEN 'LAL' ELSE 'CCC' END AS away_team
    FROM (SELECT o_orderkey, o_orderstatus FROM orders)
    """,
)
def matchups(t):
    status = F.col("o_orderstatus")
    written = F.when(status == "P", "LAL @ CCC").when(status == "F", "LAL vs. CCC").otherwise("LAL vs CCC")
    sides = values.matchup_teams(written)
    return t.orders.select("o_orderkey", values.matchup_home_flag(written).alias("is_home"), *[c.alias(n) for n, c in sides.items()])


@query(
    "player_records",
    """
    SELECT c_name AS player_name, o_custkey AS player_nba_id, 'BOS' AS home_team, 'LAL' AS away_team,
           'points' AS stat_type, o_totalprice AS value, strftime(o_orderdate, '%Y-%m-%d') AS game_date
    FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'F'
    """,
)
def player_records(t):
    """League log rows; finished orders carry no points and drop out."""
    log = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_name").alias("PLAYER_NAME"), F.col("o_custkey").alias("PLAYER_ID"), F.lit("LAL @ BOS").alias("MATCHUP"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("GAME_DATE"),
        F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice")).alias("PTS"),
    )
    return N.player_records(log)


@query(
    "wide_to_long",
    """
    SELECT l_orderkey, l_linenumber, 'l_quantity' AS stat_type, l_quantity AS value FROM lineitem
    UNION ALL SELECT l_orderkey, l_linenumber, 'l_discount', l_discount FROM lineitem
    UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem
    """,
)
def wide_to_long(t):
    return N.wide_to_long(t.lineitem, ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"])


@query(
    "stat_aliases",
    "SELECT event_id, CASE WHEN event_type = 'click' THEN value WHEN event_type = 'view' THEN value * 2 END AS points FROM events",
)
def stat_aliases(t):
    kind = F.col("event_type")
    raw = t.events.select(
        "event_id", F.when(kind == "click", F.col("value")).alias("PTS"), F.when(kind == "view", F.col("value") * 2).alias("statValue")
    )
    return raw.select("event_id", N.pick_stat(raw, "points").alias("points"))


@query(
    "critical_fields",
    """
    SELECT event_id, CASE WHEN event_type = 'error' THEN 'home_team' WHEN event_type = 'view' THEN 'game_date,home_team'
                          ELSE '' END AS missing FROM events
    """,
)
def critical_fields(t):
    from entitystats.operators.quality import missing_fields

    kind = F.col("event_type")
    raw = t.events.select(
        "event_id", F.when(kind != "view", F.col("ts")).alias("game_date"),
        F.when(kind == "error", "  ").when(kind != "view", "LAL").alias("home_team"), F.lit("BOS").alias("away_team"),
    )
    return raw.select("event_id", F.array_join(missing_fields(raw), ",").alias("missing"))


@query(
    "accepted_records",
    "SELECT event_type, count(*) AS records FROM events WHERE event_type NOT IN ('error', 'view') GROUP BY event_type",
)
def accepted_records(t):
    from entitystats.operators.quality import split_critical

    kind = F.col("event_type")
    raw = t.events.select("event_type", F.when(kind != "view", F.col("ts")).alias("game_date"), F.when(kind != "error", "LAL").alias("home_team"), F.lit("BOS").alias("away_team"))
    return split_critical(raw)[0].groupBy("event_type").agg(F.count(F.lit(1)).alias("records"))


@query(
    "active_entities",
    "SELECT c_custkey FROM customer WHERE c_acctbal > 0 OR c_nationkey > 0",
)
def active_entities(t):
    raw = t.customer.select("c_custkey", (F.col("c_acctbal") > 0).alias("is_active"), F.col("c_nationkey").alias("teamId"))
    return N.active_entities(raw.withColumnRenamed("is_active", "isActive"), ["isActive"], ["teamId"]).select("c_custkey")


@query(
    "feature_ablation",
    "SELECT l_orderkey, l_linenumber, l_quantity, CAST(0 AS DOUBLE) AS adv_price, CAST(0 AS DOUBLE) AS morale_score FROM lineitem",
)
def feature_ablation(t):
    raw = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_quantity", F.col("l_extendedprice").alias("adv_price"), F.col("l_tax").alias("morale_score")
    )
    return N.ablate(raw)


@query(
    "feature_alignment",
    "SELECT l_orderkey, l_linenumber, l_tax, CAST(0 AS DOUBLE) AS absent, l_quantity, CAST(0 AS DOUBLE) AS l_returnflag FROM lineitem",
)
def feature_alignment(t):
    return N.align_features(t.lineitem, ["l_tax", "absent", "l_quantity", "l_returnflag"], keep=["l_orderkey", "l_linenumber"])


@query(
    "one_hot_features",
    """
    SELECT c_custkey, CAST(c_nationkey AS DOUBLE) AS c_nationkey, c_acctbal,
    """
    + ",".join(
        f"CAST(c_mktsegment = '{s}' AS INTEGER)::DOUBLE AS \"c_mktsegment_{s}\""
        for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
    )
    + " FROM customer",
)
def one_hot_features(t):
    """The market segment has five levels; the names have too many and go."""
    return N.prepare_features(t.customer, keep=["c_custkey"])


@query(
    "name_keys",
    """
    WITH n AS (SELECT doc_id, lower(regexp_replace(text, '[.,''"]', '', 'g')) AS s FROM documents)
    SELECT doc_id, md5(trim(regexp_replace(strip_accents(s), '\\s+', ' ', 'g'))) AS key FROM n
    """,
)
def name_keys(t):
    """Normalised form of whole texts in four languages."""
    return t.documents.select("doc_id", F.md5(text.normalise_name(F.col("text"))).alias("key"))


@query(
    "list_fields",
    """
    WITH f AS (SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN 1 WHEN p_type = 'PROMO' THEN 2 WHEN p_type = 'STANDARD' THEN 3 ELSE 4 END AS k, p_name FROM part)
    SELECT p_partkey, CASE WHEN k = 4 THEN p_name ELSE replace(p_name, ' ', '|') END AS items FROM f
    """,
)
def list_fields(t):
    """Python-style list, comma list, semicolon list or a single value."""
    words, kind = F.split("p_name", " "), F.col("p_type")
    written = (
        F.when(kind == "ECONOMY", F.concat(F.lit("['"), F.array_join(words, "', '"), F.lit("']")))
        .when(kind == "PROMO", F.array_join(words, ", "))
        .when(kind == "STANDARD", F.array_join(words, " ; "))
        .otherwise(F.col("p_name"))
    )
    return t.part.select("p_partkey", F.array_join(text.list_field(written), "|").alias("items"))


@query(
    "id_matching",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)",
)
def id_matching(t):
    ids = t.customer.filter("c_acctbal < 0").select(F.concat(F.col("c_custkey").cast("string"), F.lit(".0")).alias("pid"))
    return N.match_ids(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", ids, "pid")
