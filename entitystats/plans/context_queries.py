"""Request context, point-in-time history, feed lines."""

from pyspark.sql import functions as F

from entitystats.functions import contexts as FC
from entitystats.functions import values as V
from entitystats.functions.dates import is_fresh
from entitystats.functions.teams import TEAMS
from entitystats.operators import context as C
from entitystats.operators import features as X
from entitystats.operators import lines as L
from entitystats.operators import windows as W
from entitystats.operators.sets import common_columns
from entitystats.plans import window_queries  # noqa: F401  (its SQL is reused below)
from entitystats.plans.registry import ORACLES, query
from entitystats.plans.rounding import rounded
from entitystats.session import join_per_key, settled_small


@query(
    "joined_latest_facts",
    """
    SELECT l_orderkey, l_linenumber, c_name, o_orderdate, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey ORDER BY o_orderdate DESC, l_orderkey DESC, l_linenumber DESC, l_quantity DESC LIMIT 5
    """,
)
def joined_latest_facts(t):
    """The five newest facts with their names: a top-n report."""
    facts = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity").join(
        t.orders.select("o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    named = facts.join(t.customer.select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    order = [F.desc(c) for c in ("o_orderdate", "l_orderkey", "l_linenumber", "l_quantity")]
    return named.select("l_orderkey", "l_linenumber", "c_name", "o_orderdate", "l_quantity").orderBy(*order).limit(5)


@query(
    "fact_dimension_join",
    """
    SELECT n_name, o_orderstatus, count(*) AS n, round(3.14159e-5 + sum(l_extendedprice), 2) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL
    """,
)
def fact_dimension_join(t):
    facts = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    who = facts.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))
    return rounded(who.groupBy("n_name", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("l_extendedprice").alias("total")), 2)


_K = "CAST(json_extract(props, '$.k') AS DOUBLE)"


@query(
    "opponent_adjusted",
    f"""
    WITH e AS (SELECT user_id, event_id, ts, event_type, value, {_K} AS k FROM events),
    r AS (SELECT user_id, arg_max(event_type, event_id) AS cur, arg_max(k, event_id) AS cur_k, max(event_id) AS cur_id FROM e GROUP BY user_id),
    h AS (SELECT e.*, cur, cur_k FROM e JOIN r USING (user_id) WHERE event_id <> cur_id)
    SELECT user_id, count(*) FILTER (WHERE event_type = cur) AS games_vs_current_opponent,
      round(3.14159e-9 + avg(value) FILTER (WHERE event_type = cur), 6) AS avg_vs_current_opponent,
      round(3.14159e-9 + avg(value) FILTER (WHERE k <= cur_k), 6) AS avg_vs_stronger_def,
      round(3.14159e-9 + avg(value) FILTER (WHERE abs(k - cur_k) <= 2), 6) AS avg_vs_similar_def,
      max(ts) FILTER (WHERE event_type = cur) AS last_game_vs_current_opponent_date,
      round(3.14159e-9 + arg_max(value, ts) FILTER (WHERE event_type = cur), 6) AS last_game_vs_current_opponent_stat
    FROM h GROUP BY user_id
    """,
)
def opponent_adjusted(t):
    """The newest event of a user is the coming game, earlier ones the history."""
    e = t.events.select("user_id", "event_id", "ts", "event_type", "value", F.get_json_object("props", "$.k").try_cast("double").alias("k"))
    now = e.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("cur"), F.max_by("k", "event_id").alias("cur_k"), F.max("event_id").alias("cur_id"))
    now = settled_small(now)
    history = e.join(now.select("user_id", "cur_id"), "user_id").filter("event_id <> cur_id").drop("cur_id")
    return rounded(C.opponent_adjusted(history, now.drop("cur_id"), "user_id", "ts", "value", "event_type", "k", "cur", "cur_k", ["event_id"]))


_PLACE = "(VALUES " + ",".join(f"({i},'{r[0]}',{r[3]}::DOUBLE,{r[4]}::DOUBLE,{r[5]}::DOUBLE)" for i, r in enumerate(TEAMS)) + ") AS {a}(i, code, lat, lon, alt)"


@query(
    "travel_features",
    f"""
    SELECT o_orderkey, round(3.14159e-7 + 2 * 6371.0 * atan2(sqrt(q), sqrt(1 - q)), 4) AS travel_distance_km, alt AS opp_altitude_m,
           CAST(alt >= 1000 AS INTEGER) AS is_high_altitude_opp, rival AS is_rivalry
    FROM (SELECT o_orderkey, b.alt, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2) AS q,
             CAST(least(a.code, b.code) || greatest(a.code, b.code) IN ('LACLAL', 'BOSLAL', 'BOSNYK', 'GSWLAL', 'NYKPHI', 'BKNNYK') AS INTEGER) AS rival
          FROM orders JOIN {_PLACE.format(a="a")} ON a.i = o_orderkey % 30 JOIN {_PLACE.format(a="b")} ON b.i = o_custkey % 30)
    """,
)
def travel_features(t):
    code = lambda c: F.get(F.array(*[F.lit(r[0]) for r in TEAMS]), (F.col(c) % 30).cast("int"))
    games = t.orders.select("o_orderkey", code("o_orderkey").alias("team"), code("o_custkey").alias("opponent"))
    return rounded(C.travel_features(games, "team", "opponent").drop("team", "opponent"), 4)


@query(
    "game_flags",
    """
    SELECT o_orderkey, CAST(o_orderstatus = 'P' OR o_orderpriority = '1-URGENT' AS INTEGER) AS is_playoff, CAST(o_totalprice > 300000 AS INTEGER) AS is_national_tv,
           CAST(year(o_orderdate) IN (1998, 1999) AS INTEGER) AS is_contract_year FROM orders
    """,
)
def game_flags(t):
    raw = t.orders.select(
        "o_orderkey", (F.col("o_orderstatus") == "P").alias("isPlayoff"), F.when(F.col("o_orderpriority") == "1-URGENT", "Playoffs").alias("gameType"),
        (F.col("o_totalprice") > 300000).alias("isNationalTV"), V.contract_year(F.year("o_orderdate"), 1998).alias("is_contract_year"),
    )
    return C.game_flags(raw, ["isPlayoff"], ["gameType"], ["isNationalTV"]).select("o_orderkey", "is_playoff", "is_national_tv", "is_contract_year")


@query(
    "career_flags",
    """
    WITH p AS (SELECT o_custkey, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, max(o_totalprice) AS top, count(DISTINCT o_orderpriority) FILTER (o_totalprice > 300000) AS awards FROM orders GROUP BY 1)
    SELECT o_custkey, CAST(urgent > 2 OR top > 450000 AS INTEGER) AS is_all_star, awards::INTEGER AS recent_awards_count FROM p
    """,
)
def career_flags(t):
    """All-star by any of two flags, one of them null where unknown, and the number of awards."""
    grouped = t.orders.groupBy("o_custkey").agg(
        F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"), F.max("o_totalprice").alias("top"), F.collect_set(F.when(F.col("o_totalprice") > 300000, F.col("o_orderpriority"))).alias("awards")
    )
    flags = [F.when(F.col("urgent") > 0, F.col("urgent") > 2), (F.col("top") > 450000).cast("int")]
    return grouped.select("o_custkey", V.all_star(*flags).alias("is_all_star"), V.award_count(F.when(F.size("awards") > 0, F.col("awards"))).alias("recent_awards_count"))


@query("selected_columns", "SELECT o_totalprice, o_orderkey FROM orders")
def selected_columns(t):
    """Of a selection of names those that the table has, in the order of the selection."""
    return t.orders.select(*common_columns(["o_totalprice", "no_such_feature", "o_orderkey"], t.orders))


@query(
    "as_of_join",
    """
    SELECT o.o_orderkey, o.o_custkey, o.o_orderdate, p.o_orderdate AS o_orderdate_before, p.o_totalprice AS o_totalprice_before
    FROM orders o LEFT JOIN LATERAL (SELECT o_orderdate, o_totalprice FROM orders h WHERE h.o_custkey = o.o_custkey AND h.o_orderdate < o.o_orderdate
         ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) p ON true
    """,
)
def as_of_join(t):
    """Each order with the customer's latest order of an earlier day."""
    return C.as_of(t.orders.select("o_orderkey", "o_custkey", "o_orderdate"), t.orders, "o_custkey", "o_orderdate", ["o_totalprice"], ["o_orderkey"])


@query(
    "prior_average",
    """
    SELECT c_custkey AS o_custkey, o_orderdate, count(h) AS n_before, round(3.14159e-7 + avg(h), 4) AS avg_before FROM (
      SELECT c_custkey, TIMESTAMP '1998-01-01' AS o_orderdate, CASE WHEN o.o_orderdate < TIMESTAMP '1998-01-01' THEN o_totalprice END AS h
      FROM customer LEFT JOIN orders o ON o_custkey = c_custkey) GROUP BY ALL
    """,
)
def prior_average(t):
    """Every customer's mean order value strictly before one day."""
    asks = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.lit("1998-01-01").cast("timestamp_ntz").alias("o_orderdate"))
    return rounded(C.prior_average(asks, t.orders, "o_custkey", "o_orderdate", "o_totalprice"), 4)


@query(
    "league_relative_form",
    """
    WITH m AS (SELECT c_mktsegment, avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s FROM customer GROUP BY 1)
    SELECT c_custkey, round(3.14159e-9 + (c_acctbal - m) / s, 6) AS c_acctbal_z FROM customer JOIN m USING (c_mktsegment)
    """,
)
def league_relative_form(t):
    who = t.customer.select("c_custkey", "c_mktsegment", "c_acctbal")
    return rounded(C.league_zscores(who, t.customer, "c_mktsegment", ["c_acctbal"]).select("c_custkey", "c_acctbal_z"))


@query(
    "season_merge",
    """
    SELECT o_orderkey, o_custkey FROM (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey, year(o_orderdate)
       ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders WHERE year(o_orderdate) IN (1997, 1998)) WHERE rn <= 3
    """,
)
def season_merge(t):
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderdate", F.year("o_orderdate").alias("season"))
    return C.season_merge(rows, "o_custkey", "season", [1997, 1998], "o_orderdate", 3, ["o_orderkey"]).select("o_orderkey", "o_custkey")


@query(
    "player_contexts",
    """
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events),
    g AS (SELECT user_id, list(value ORDER BY rn) AS v, avg(value) AS m, max(CASE WHEN rn = 1 THEN CAST(ts AS DATE) END) AS d0, max(CASE WHEN rn = 2 THEN CAST(ts AS DATE) END) AS d1
          FROM r WHERE rn <= 8 GROUP BY user_id)
    SELECT user_id, 'Last ' || len(v) || ' games: ' || array_to_string(list_transform(v, lambda x: CAST(x AS VARCHAR)), ', ') AS recent,
           round(3.14159e-9 + m, 6) AS recent_mean, CAST(greatest(0, date_diff('day', d1, d0) - 1) AS INTEGER) AS days_rest FROM g
    """,
)
def player_contexts(t):
    out = C.player_contexts(t.events, "user_id", "ts", "value", ["event_id"])
    return rounded(out.select("user_id", "recent", "recent_mean", "contextual_factors.days_rest"))


@query(
    "batch_context",
    """
    WITH q AS (SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_name END AS name FROM customer),
    x AS (SELECT c_name AS name, c_acctbal FROM customer WHERE c_acctbal > 0)
    SELECT c_custkey AS pos, q.name, c_acctbal AS form, CASE WHEN q.name IS NULL THEN 'missing name' WHEN x.name IS NULL THEN 'not found' END AS error
    FROM q LEFT JOIN x ON q.name = x.name
    """,
)
def batch_context(t):
    asks = t.customer.select(F.col("c_custkey").alias("pos"), F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_name")).alias("name"))
    known = t.customer.filter("c_acctbal > 0").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("form"))
    return C.batch_context(asks, known, "name")


@query(
    "context_overlay",
    """
    SELECT c_custkey, coalesce(s_acctbal, c_acctbal) AS form, CASE WHEN s_suppkey IS NOT NULL THEN 'now' END AS fetched_at
    FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey
    """,
)
def context_overlay(t):
    old = t.customer.select("c_custkey", F.col("c_acctbal").alias("form"), F.lit(None).cast("string").alias("fetched_at"))
    new = t.supplier.select(F.col("s_suppkey").alias("c_custkey"), F.col("s_acctbal").alias("form"))
    return C.overlay(old, new, "c_custkey", ["form"], F.lit("now"))


@query(
    "lookup_by_ids",
    "SELECT c_custkey AS pos, o_orderkey, o_totalprice FROM customer JOIN orders ON o_orderkey = c_custkey * 11 - 3",
)
def lookup_by_ids(t):
    """Every customer asks for one order number, in customer order; unknown numbers are left out."""
    ids = t.customer.select(F.col("c_custkey").alias("pos"), (F.col("c_custkey") * 11 - 3).alias("o_orderkey"))
    return C.lookup_by_ids(t.orders.select("o_orderkey", "o_totalprice"), ids, "o_orderkey").select("pos", "o_orderkey", "o_totalprice")


@query(
    "fresh_contexts",
    "SELECT event_id, ts > TIMESTAMP '2024-01-15 06:00:00' AND ts <= TIMESTAMP '2024-01-15 12:00:00' AS fresh FROM events",
)
def fresh_contexts(t):
    return t.events.select("event_id", is_fresh(F.col("ts"), F.lit("2024-01-15 12:00:00")).alias("fresh"))


@query(
    "context_normalisation",
    """
    SELECT event_id, value AS season_avg, CAST(json_extract(props, '$.k') AS DOUBLE) AS first_stat, event_type AS opponent,
           CASE WHEN event_type = 'view' THEN NULL ELSE event_type END AS rival FROM events WHERE event_type <> 'error'
    """,
)
def context_normalisation(t):
    """Contexts written as JSON with numbers as text; an empty one gives nothing."""
    k, kind = F.get_json_object("props", "$.k"), F.col("event_type")
    body = F.when(kind == "error", "{}").otherwise(
        F.concat(
            F.lit('{"seasonAvg":"'), F.col("value").cast("string"), F.lit('","recentGames":[{"gameDate":"2024-01-01","statValue":"'), k,
            F.lit('","opponentAbbrev":"'), F.when(kind == "view", "").otherwise(kind), F.lit('"}],"opponent":{"name":"'), kind, F.lit('","pace":99}}'),
        )
    )
    raw = t.events.select("event_id", FC.parse_context(body).alias("raw"))
    out = raw.select("event_id", FC.normalise_context(F.col("raw")).alias("c"), FC.opponent_of_latest(F.col("raw")).alias("o")).filter("c IS NOT NULL")
    return out.select("event_id", "c.season_avg", F.col("c.recent_games")[0]["stat_value"].alias("first_stat"), F.col("c.opponent.name").alias("opponent"), F.col("o.team_id").alias("rival"))


def _lines(t):
    """Orders as betting lines: customer, priority and price; the status is the league."""
    return t.orders.join(t.customer.select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"), "left").select(
        F.col("o_orderkey").alias("id"), F.col("c_name").alias("player"), F.col("o_orderstatus").alias("league"),
        F.col("o_orderpriority").alias("stat"), F.col("o_totalprice").alias("line"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("start_time"),
    )


_LINES = """
    WITH l AS (SELECT o_orderkey AS id, c_name AS player, o_orderstatus AS league, o_orderpriority AS stat, o_totalprice AS line,
                      strftime(o_orderdate, '%Y-%m-%d') AS start_time FROM orders LEFT JOIN customer ON o_custkey = c_custkey)
"""


@query(
    "feed_lines",
    """
    SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN c_acctbal > 0 THEN c_name ELSE 'Unknown' END AS player, coalesce(n_name, 'Unknown') AS league,
           o_orderpriority AS stat, o_totalprice AS line FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey < 20
    WHERE o_orderstatus = 'O'
    """,
)
def feed_lines(t):
    """A nested feed built from whole tables: one document per order date, and one with the includes."""
    rel = lambda c: F.struct(F.struct(c.cast("string").alias("id")).alias("data"))
    orders = t.orders.join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    item = F.struct(
        F.col("o_orderkey").cast("string").alias("id"), F.lit("projection").alias("type"),
        F.struct(
            F.col("o_orderpriority").alias("stat_type"), F.col("o_totalprice").alias("line_score"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("start_time"),
            F.when(F.col("o_orderstatus") == "O", "pre_game").otherwise("final").alias("status"),
        ).alias("attributes"),
        F.struct(rel(F.col("o_custkey")).alias("new_player"), rel(F.col("c_nationkey")).alias("league"), rel(F.lit(None)).alias("game")).alias("relationships"),
    )
    inc = lambda i, kind, name: F.struct(i.cast("string").alias("id"), F.lit(kind).alias("type"), F.struct(name.alias("name"), F.lit("").alias("team"), F.lit("").alias("position")).alias("attributes"))
    players = t.customer.filter("c_acctbal > 0").select(F.array(inc(F.col("c_custkey"), "new_player", F.col("c_name"))).alias("included"))
    leagues = t.nation.filter("n_nationkey < 20").select(F.array(inc(F.col("n_nationkey"), "league", F.col("n_name"))).alias("included"))
    docs = orders.select(F.array(item).alias("data")).unionByName(players.unionByName(leagues), allowMissingColumns=True)
    feed = docs.select("data", "included").to(t.spark.createDataFrame([], L.FEED_SCHEMA).schema)
    return L.flatten_feed(feed).select("id", "player", "league", "stat", "line")


@query(
    "line_groups",
    _LINES
    + """SELECT player, stat, count(*) AS count, min(line) AS min_line, max(line) AS max_line, round(3.14159e-5 + avg(line), 2) AS avg_line,
         arg_max(id, (start_time, -id)) AS rep_id, arg_max(line, (start_time, -id)) AS rep_line FROM l GROUP BY player, stat""",
)
def line_groups(t):
    out = L.line_groups(_lines(t).withColumn("line", F.col("line") + 0.0))
    # rounded to cents; ties are rounded with the same offset as the check
    return out.withColumn("avg_line", F.round(F.col("avg_line") + 3.14159e-5, 2))


@query(
    "line_page",
    _LINES + "SELECT * FROM l WHERE league = 'F' AND stat = '2-HIGH' AND contains(lower(player), '#00000') ORDER BY id LIMIT 50 OFFSET 100",
)
def line_page(t):
    """A page of fifty is the feature; the filters run over all lines."""
    return L.line_page(_lines(t), 100, 50, league="F", stat="2-HIGH", player="#00000")[0]


@query("line_total", _LINES + "SELECT count(*) AS total FROM l WHERE league = 'F' AND stat = '2-HIGH' AND contains(lower(player), '#00000')")
def line_total(t):
    return L.line_page(_lines(t), 100, 50, league="F", stat="2-HIGH", player="#00000")[1]


@query("distinct_stats", _LINES + "SELECT DISTINCT stat FROM l WHERE league = 'P'")
def distinct_stats(t):
    return L.distinct_values(_lines(t), "stat", league="P")


@query("player_mappings", _LINES + "SELECT DISTINCT player, league, stat FROM l")
def player_mappings(t):
    return L.player_mappings(_lines(t))


@query("player_counts", _LINES + "SELECT player, count(*) AS count FROM l WHERE contains(lower(player), '#0000000') GROUP BY player")
def player_counts(t):
    return L.player_counts(_lines(t), search="#0000000")


@query(
    "filtered_player_counts",
    _LINES + "SELECT player, count(*) AS count FROM l WHERE player IN (SELECT player FROM l WHERE league = 'P' AND stat = '5-LOW') GROUP BY player",
)
def filtered_player_counts(t):
    """Players of a league and statistic, with their counts over all lines."""
    return L.player_counts(_lines(t), league="P", stat="5-LOW")


@query("scanned_player_counts", _LINES + "SELECT player, count(*) AS count FROM l WHERE league = 'P' GROUP BY player")
def scanned_player_counts(t):
    return L.player_counts(_lines(t), scanned=True, league="P")


@query("feed_totals", _LINES + "SELECT count(*) AS lines, count(DISTINCT player) AS players, count(DISTINCT league) AS leagues FROM l")
def feed_totals(t):
    return L.feed_totals(_lines(t))


@query(
    "line_enrichment",
    """
    SELECT l_orderkey, l_linenumber, coalesce(nullif(p_name, ''), 'Unknown') AS part_name, CASE WHEN l_suppkey < 50 THEN s_name ELSE 'Unknown' END AS league_name, l_extendedprice AS line
    FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey
    """,
)
def line_enrichment(t):
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").alias("line"))
    parts = t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("part_name"))
    leagues = t.supplier.filter("s_suppkey < 50").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("league_name"))
    return L.enrich(lines, parts, leagues, "l_partkey", "l_suppkey").select("l_orderkey", "l_linenumber", "part_name", "league_name", "line")


@query(
    "evidence_check",
    """
    WITH m AS (SELECT user_id, avg(value) AS m FROM events GROUP BY user_id),
    e AS (SELECT *, 'Item ' || event_id || ' ' AS i FROM events JOIN m USING (user_id)),
    r AS (SELECT event_id, list_filter([
        CASE WHEN event_id % 11 = 0 THEN i || 'missing key ''reasoning''' END,
        CASE WHEN event_id % 13 = 0 THEN i || 'missing key ''dataUsed''' END,
        CASE WHEN event_type = 'view' THEN i || 'recommendation must be OVER/UNDER/null' END,
        CASE WHEN event_type = 'signup' THEN i || 'confidence must be High/Medium/Low' END,
        CASE WHEN event_id % 7 = 0 THEN i || 'recentGames value ' || (event_id % 5 + 1) || ' not present in trusted context' END,
        CASE WHEN event_id % 17 = 0 OR abs(value - m) > greatest(0.5, abs(m) * 0.05) THEN i || 'seasonAvg mismatch with trusted context beyond tolerance' END,
        CASE WHEN event_id % 3 = 0 AND event_type <> 'click' THEN i || 'opponent.name mismatch (model vs trusted)' END,
        CASE WHEN abs(value - m) > 1 THEN i || 'opponent.defensiveRating mismatch beyond tolerance' END,
        CASE WHEN event_id % 5 > 2 THEN i || 'opponent.pace mismatch beyond tolerance' END,
        CASE WHEN event_id % 4 > 1 THEN i || 'projectedMinutes mismatch beyond tolerance' END
    ], lambda x: x IS NOT NULL) AS reasons FROM e)
    SELECT event_id, len(reasons)::INTEGER AS n_reasons, array_to_string(reasons, '; ') AS reasons FROM r
    """,
)
def evidence_check(t):
    """Each event makes claims about its user, some of them wrong; the user's mean is the trusted context."""
    means = t.events.groupBy("user_id").agg(F.avg("value").alias("m"))
    both = join_per_key(t.events, means, ["user_id"])
    at, kind, value, mean = F.col("event_id"), F.col("event_type"), F.col("value"), F.col("m")
    keys = F.array_compact(F.array(
        *[F.lit(k) for k in ("player", "stat", "line", "recommendation", "confidence", "numericEvidence")], F.when(at % 11 != 0, "reasoning"), F.when(at % 13 != 0, "dataUsed")
    ))
    item = {
        "keys": keys, "recommendation": F.when(kind == "view", "MAYBE").when(kind != "error", "OVER"),
        "confidence": F.when(kind == "signup", "Sure").when(kind == "error", "").otherwise("Low"),
        "recent_values": F.when(at % 7 == 0, F.array(F.lit(0).cast("bigint"), at % 5 + 1)).otherwise(F.array(F.lit(0).cast("bigint"))),
        "season_avg": F.when(at % 17 == 0, "about 50").otherwise(value.cast("string")), "opponent": F.when(at % 3 == 0, kind).otherwise(""),
        "opp_def": value, "pace": mean + (at % 5) * 0.4, "minutes": mean + at % 4,
    }
    trusted = {"recent_values": F.array(F.lit(0).cast("bigint"), F.lit(None).cast("bigint")), "season_avg": mean, "opponent": F.lit("click"), "opp_def": mean, "pace": mean, "minutes": mean}
    reasons = L.evidence_reasons(item, trusted, at)
    return both.select("event_id", F.size(reasons).alias("n_reasons"), F.array_join(reasons, "; ").alias("reasons"))


@query(
    "analysis_size",
    """
    WITH c AS (SELECT l_orderkey, count(*) AS n, max(l_linenumber) AS want FROM lineitem GROUP BY 1)
    SELECT l_orderkey, CASE WHEN l_orderkey % 9 = 0 THEN 'Output is not a JSON array' WHEN n <> want THEN 'Expected ' || want || ' elements, got ' || n ELSE '' END AS reasons FROM c
    """,
)
def analysis_size(t):
    """Lines of an order as the items of an analysis, as many expected as the largest line number says."""
    orders = t.lineitem.groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("items"), F.max("l_linenumber").alias("want"))
    items = F.when(F.col("l_orderkey") % 9 != 0, F.col("items"))
    return orders.select("l_orderkey", F.array_join(L.output_reasons(items, F.col("want")), "; ").alias("reasons"))


@query(
    "entity_features",
    f"SELECT * FROM ({ORACLES['rolling_summary']}) JOIN ("
    + ORACLES["opponent_adjusted"].replace("WHERE event_id <> cur_id", "").replace("max(ts) FILTER (WHERE event_type = cur) AS last_game_vs_current_opponent_date,", "").replace(
        "avg_vs_similar_def,", "avg_vs_similar_def, round(3.14159e-9 + avg(value), 6) AS recent_mean, round(3.14159e-9 + stddev_pop(value), 6) AS recent_std,"
    )
    + ") USING (user_id)",
)
def entity_features(t):
    """Form, moments and form against the latest opponent in one row per user."""
    e = t.events.select("user_id", "event_id", "ts", "event_type", "value", F.get_json_object("props", "$.k").try_cast("double").alias("k"))
    now = e.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("cur"), F.max_by("k", "event_id").alias("cur_k"))
    out = X.entity_features(e, now, "user_id", "ts", "value", "event_type", "k", "cur", "cur_k", ["event_id"])
    return rounded(out.drop("cur", "cur_k", "last_game_vs_current_opponent_date"))


@query(
    "spec_samples",
    """
    WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events),
    s AS (SELECT user_id, avg(value) AS m, stddev_pop(value) AS d FROM r WHERE rn <= 10 GROUP BY 1)
    SELECT event_id, round(3.14159e-9 + m, 6) AS recent_mean, round(3.14159e-9 + d, 6) AS recent_std FROM events JOIN s USING (user_id)
    """,
)
def spec_samples(t):
    specs = t.events.select("user_id", "ts", "event_id")
    return rounded(X.spec_samples(specs, t.events, "user_id", "ts", "value", 10, ["event_id"]).select("event_id", "recent_mean", "recent_std"))


@query(
    "spec_samples_causal",
    """
    SELECT event_id, round(3.14159e-7 + avg(value) OVER w, 4) AS recent_mean, round(3.14159e-7 + stddev_pop(value) OVER w, 4) AS recent_std FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    """,
)
def spec_samples_causal(t):
    specs = t.events.select("user_id", "ts", "event_id")
    return rounded(X.spec_samples(specs, t.events, "user_id", "ts", "value", causal=True).select("event_id", "recent_mean", "recent_std"), 4)
