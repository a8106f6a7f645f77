"""Season, team and table aggregates."""

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from entitystats.functions import values as V
from entitystats.operators import aggregates as A
from entitystats.plans.registry import query
from entitystats.plans.rounding import rounded
from entitystats.session import scratch_folder, size_in_bytes
from entitystats.sources.clustered import read_range, write_clustered


def _games(t):
    """Line items as games of a supplier, the ship year as season."""
    return t.lineitem.select(
        F.col("l_suppkey").alias("player"), F.year("l_shipdate").cast("string").alias("season"), F.col("l_quantity").alias("PTS"),
        F.col("l_linenumber").alias("AST"), F.lit(None).cast("double").alias("REB"), (F.col("l_extendedprice") / 1000).alias("FGA"),
        F.col("l_quantity").alias("FGM"), (F.col("l_quantity") * 2).alias("FTA"), F.col("l_quantity").alias("FTM"),
        F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(":30")).alias("MIN"), (F.col("l_tax") * 100).alias("TO"),
    )


_BOX = """
    WITH b AS (SELECT l_suppkey AS player, CAST(year(l_shipdate) AS VARCHAR) AS season, count(*) AS games, sum(l_quantity) AS pts,
       sum(l_linenumber) AS ast, sum(l_extendedprice / 1000) AS fga, sum(l_quantity) AS fgm, sum(l_quantity * 2) AS fta, sum(l_quantity) AS ftm,
       sum(l_tax * 100) AS tov, sum(CAST(l_quantity AS INTEGER) + 0.5) AS mins FROM lineitem GROUP BY ALL),
    e AS (SELECT *, (pts + ast - greatest(0, fga - fgm) - greatest(0, fta - ftm) - tov) / games AS eff FROM b)
"""


@query(
    "season_box_score",
    _BOX
    + """SELECT player, season, games, round(3.14159e-7 + pts / games, 4) AS PTS_per_game, round(3.14159e-7 + ast / games, 4) AS AST_per_game,
         round(3.14159e-7 + fga, 4) AS FGA, round(3.14159e-7 + mins / games, 4) AS MIN_per_game, round(3.14159e-7 + tov / games, 4) AS TOV_per_game FROM e""",
)
def season_box_score(t):
    out = A.season_box_score(_games(t), ["player", "season"])
    return rounded(out.select("player", "season", "games", "PTS_per_game", "AST_per_game", "FGA", "MIN_per_game", "TOV_per_game"), 4)


@query(
    "season_estimates",
    _BOX
    + """SELECT player, season, round(3.14159e-7 + eff * 2.5 * 0.34, 4) AS PER_est,
         round(3.14159e-7 + greatest(0, eff) * 0.018 * (mins / games / 30) * 0.31 * games, 4) AS WS_est, round(3.14159e-7 + eff, 4) AS eff_per_game FROM e""",
)
def season_estimates(t):
    out = A.season_estimates(A.season_box_score(_games(t), ["player", "season"]))
    return rounded(out.select("player", "season", "PER_est", "WS_est", "eff_per_game"), 4)


@query(
    "shooting_stats",
    """
    SELECT l_suppkey AS player, count(*) AS games, round(3.14159e-7 + sum(l_quantity) / count(*), 4) AS PTS_per_game,
           round(3.14159e-7 + sum(l_quantity) / sum(l_extendedprice / 1000), 4) AS FG_pct, CAST(NULL AS DOUBLE) AS FG3_pct,
           round(3.14159e-7 + 0.5, 4)::DOUBLE AS FT_pct,
           round(3.14159e-7 + sum(l_quantity) / (2 * (sum(l_extendedprice / 1000) + 0.44 * sum(l_quantity * 2))), 4) AS TS_PCT
    FROM lineitem GROUP BY l_suppkey
    """,
)
def shooting_stats(t):
    return rounded(A.shooting_stats(_games(t), "player").select("player", "games", "PTS_per_game", "FG_pct", "FG3_pct", "FT_pct", "TS_PCT"), 4)


@query(
    "team_stats",
    """
    SELECT l_suppkey AS team, CAST(year(l_shipdate) AS VARCHAR) AS season, count(*) AS games, round(3.14159e-7 + avg(l_quantity), 4) AS PTS_avg,
           round(3.14159e-7 + avg(l_linenumber), 4) AS OPP_PTS_avg, round(3.14159e-7 + (avg(l_quantity) - avg(l_linenumber)), 4) AS PTS_diff,
           round(3.14159e-7 + sum(l_tax) / sum(l_quantity), 4) AS FG_pct
    FROM lineitem GROUP BY ALL
    """,
)
def team_stats(t):
    log = t.lineitem.select(
        F.col("l_suppkey").alias("team"), F.year("l_shipdate").cast("string").alias("season"), F.col("l_quantity").alias("PTS"),
        F.col("l_linenumber").alias("OPP_PTS"), F.col("l_tax").alias("FGM"), F.col("l_quantity").alias("FGA"),
    )
    return rounded(A.team_stats(log, ["team", "season"]), 4)


@query(
    "multi_season_mean",
    """
    WITH s AS (SELECT l_suppkey, year(l_shipdate) AS season, avg(l_quantity) AS q, avg(l_tax) AS x FROM lineitem GROUP BY ALL)
    SELECT l_suppkey, round(3.14159e-9 + avg(q), 6) AS multi_q, round(3.14159e-9 + avg(x), 6) AS multi_x, count(DISTINCT season) AS multi_season_count
    FROM s GROUP BY l_suppkey
    """,
)
def multi_season_mean(t):
    s = t.lineitem.groupBy("l_suppkey", F.year("l_shipdate").alias("season")).agg(F.avg("l_quantity").alias("q"), F.avg("l_tax").alias("x"))
    return rounded(A.multi_season_mean(s, "l_suppkey", ["q", "x"], seasons="season"))


@query(
    "multi_season_long",
    """
    WITH s AS (SELECT l_suppkey, year(l_shipdate) AS season, avg(l_quantity) AS quantity, avg(l_tax) AS tax FROM lineitem GROUP BY ALL),
    u AS (SELECT l_suppkey, 'quantity' AS metric, quantity AS v FROM s UNION ALL SELECT l_suppkey, 'tax', tax FROM s)
    SELECT l_suppkey, metric, round(3.14159e-9 + avg(v), 6) AS v FROM u GROUP BY ALL
    """,
)
def multi_season_long(t):
    s = t.lineitem.groupBy("l_suppkey", F.year("l_shipdate").alias("season")).agg(F.avg("l_quantity").alias("quantity"), F.avg("l_tax").alias("tax"))
    return rounded(A.multi_season_long(s.unpivot(["l_suppkey", "season"], ["quantity", "tax"], "metric", "v"), "l_suppkey", "metric", "v"))


@query(
    "season_mean",
    "SELECT o_custkey, year(o_orderdate)::INTEGER AS season, round(3.14159e-7 + avg(o_totalprice), 4) AS o_totalprice_avg FROM orders GROUP BY ALL",
)
def season_mean(t):
    rows = t.orders.select("o_custkey", F.year("o_orderdate").alias("season"), "o_totalprice")
    return rounded(A.season_mean(rows, ["o_custkey", "season"], ["o_totalprice"]), 4)


@query(
    "team_seasons",
    """
    WITH g AS (SELECT o_orderpriority AS h, o_orderstatus AS a, CAST(year(o_orderdate) AS VARCHAR) AS season, o_totalprice AS hs,
                      CASE WHEN o_orderkey > 100 THEN CAST(o_custkey AS DOUBLE) END AS s FROM orders),
    u AS (SELECT h AS team, season, hs AS pf, s AS pa FROM g UNION ALL SELECT a, season, s, hs FROM g WHERE h <> a)
    SELECT team, season, count(*) AS games_count, round(3.14159e-7 + avg(pf), 4) AS pts_for_avg, round(3.14159e-7 + avg(pa), 4) AS pts_against_avg FROM u GROUP BY ALL
    """,
)
def team_seasons(t):
    games = t.orders.select(
        F.col("o_orderpriority").alias("home_team"), F.col("o_orderstatus").alias("away_team"), F.col("o_orderdate").alias("game_date"),
        F.col("o_totalprice").alias("home_score"), F.when(F.col("o_orderkey") > 100, F.col("o_custkey").cast("double")).alias("away_score"),
    )
    return rounded(A.team_seasons(games), 4)


@query(
    "entities_with_rows",
    "SELECT o_custkey, count(*) AS n_rows FROM orders GROUP BY o_custkey HAVING count(*) >= 10",
)
def entities_with_rows(t):
    return A.entities_with_rows(t.orders, "o_custkey", 10)


@query(
    "top_entities_by_rows",
    "SELECT user_id, count(*) AS n_rows FROM events GROUP BY user_id ORDER BY n_rows DESC, user_id LIMIT 10",
)
def top_entities_by_rows(t):
    """A top-ten report."""
    return A.entities_with_rows(t.events, "user_id", 1, top=10)


@query(
    "dataset_summary",
    """
    WITH m AS (SELECT avg(value) AS mean, stddev_samp(value) AS sd FROM events)
    SELECT count(*) AS rows_total, round(3.14159e-9 + avg(value), 6) AS target_mean, round(3.14159e-9 + stddev_samp(value), 6) AS target_std,
           count(DISTINCT user_id) AS num_entities,
    """
    + ",".join(f"round(3.14159e-9 + quantile_cont(value, {p}), 6) AS {n}" for n, p in A.SUMMARY_QUANTILES.items())
    + """, count(*) FILTER (WHERE value > mean + 3 * sd) AS outliers_up, count(*) FILTER (WHERE value < mean - 3 * sd) AS outliers_down
    FROM events, m
    """,
)
def dataset_summary(t):
    return rounded(A.dataset_summary(t.events, "user_id", "value"))


@query(
    "tracking_features",
    """
    SELECT user_id, round(3.14159e-9 + avg(CASE WHEN event_type = 'click' THEN value WHEN event_type = 'view' THEN value * 2.2369362920544 END), 6) AS avg_speed_mph,
           round(3.14159e-9 + avg(value * 100 / 1609.344), 6) AS distance_miles_per_game,
           round(3.14159e-9 + avg(CASE WHEN event_type <> 'error' THEN value END), 6) AS touches_per_game,
           CAST(NULL AS DOUBLE) AS time_possession_sec_per_game,
           round(3.14159e-9 + avg(CASE WHEN value > 1 THEN value / 100 ELSE value END), 6) AS exp_fg_pct
    FROM events GROUP BY user_id
    """,
)
def tracking_features(t):
    kind, v = F.col("event_type"), F.col("value")
    raw = t.events.select(
        "user_id", F.when(kind == "click", v.cast("string")).otherwise("").alias("avg_speed_mph"), F.when(kind == "view", v).alias("speed_mps"),
        (v * 100).alias("distance_m"), F.when(kind != "error", v).alias("touches"), F.concat(v.cast("string"), F.lit("%")).alias("xg"),
    )
    return rounded(A.tracking_features(raw, "user_id"))


@query(
    "entity_mean_since",
    "SELECT round(3.14159e-9 + avg(value), 6) AS avg_value FROM events WHERE user_id = 7 AND ts >= TIMESTAMP '2024-01-10'",
)
def entity_mean_since(t):
    """One entity from a date on, as the reported benchmark asks."""
    return rounded(A.entity_mean_since(t.events, "user_id", 7, "ts", F.lit("2024-01-10").cast("timestamp_ntz"), "value"))


@query(
    "range_means",
    """
    SELECT user_id, round(3.14159e-9 + avg(value), 6) AS avg_value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25'
    GROUP BY user_id ORDER BY avg(value) DESC, user_id LIMIT 10
    """,
)
def range_means(t):
    at = lambda d: F.lit(d).cast("timestamp_ntz")
    return rounded(A.range_means(t.events, "user_id", "ts", at("2024-01-05"), at("2024-01-25"), "value"))


@query(
    "feature_frequency",
    """
    WITH f AS (SELECT unnest(string_split(p_name, ' ')) AS feature, 'name' AS src FROM part UNION ALL SELECT lower(p_type), 'type' FROM part)
    SELECT feature, count(*) FILTER (WHERE src = 'name') AS name_count, count(*) FILTER (WHERE src = 'type') AS type_count, count(*) AS total_count
    FROM f GROUP BY feature
    """,
)
def feature_frequency(t):
    return A.feature_frequency(t.part, {"name": F.split("p_name", " "), "type": F.array(F.lower("p_type"))})


@query(
    "fit_scale",
    """
    WITH p AS (SELECT CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part), a AS (SELECT sum(x * y) / sum(x * x) AS a FROM p)
    SELECT round(3.14159e-7 + a, 4) AS scale, round(3.14159e-7 + sqrt(avg((x - y) * (x - y))), 4) AS rmse_before,
           round(3.14159e-7 + sqrt(avg((a * x - y) * (a * x - y))), 4) AS rmse_after, count(*) AS n FROM p, a GROUP BY a
    """,
)
def fit_scale(t):
    pairs = t.part.select(F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    return rounded(A.fit_scale(pairs, "x", "y"), 4)


#: Grid values - fixed values.
PER_GRID = [0.2, 0.3, 0.34, 0.4]
WS_GRID = [0.2, 0.3, 0.31, 0.4]


@query(
    "grid_errors",
    f"""
    WITH g AS (SELECT CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b FROM unnest({PER_GRID}) x(a), unnest({WS_GRID}) y(b)),
    e AS (SELECT a, b, sqrt(avg(pow(a * p_size - p_retailprice / 100, 2))) AS r1, sqrt(avg(pow(b * p_size - p_retailprice / 50, 2))) AS r2, count(*) AS n
          FROM part, g GROUP BY a, b)
    SELECT a AS per_scale, b AS ws_scale, round(3.14159e-7 + r1, 4) AS per_rmse, round(3.14159e-7 + r2, 4) AS ws_rmse, round(3.14159e-7 + (r1 + r2), 4) AS sum_rmse, n FROM e
    """,
)
def grid_errors(t):
    pairs = t.part.select(
        F.col("p_size").cast("double").alias("e"), (F.col("p_retailprice") / 100).alias("per"), (F.col("p_retailprice") / 50).alias("ws")
    )
    grid = [{"per": a, "ws": b} for a in PER_GRID for b in WS_GRID]
    out = A.grid_errors(pairs, {"per": ("e", "per"), "ws": ("e", "ws")}, grid)
    return rounded(out.select("per_scale", "ws_scale", *[c for c in out.columns if not c.endswith("scale")]), 4).withColumns(
        {c: F.round(c, 2) for c in ("per_scale", "ws_scale")}
    )


@query(
    "feature_correlations",
    "".join(
        ("" if i == 0 else " UNION ALL ")
        + f"SELECT '{c}' AS feature, round(3.14159e-9 + corr({c}, l_extendedprice), 6) AS corr FROM lineitem HAVING abs(corr({c}, l_extendedprice)) >= 0.001"
        for i, c in enumerate(["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"])
    ),
)
def feature_correlations(t):
    return rounded(A.select_by_correlation(t.lineitem, "l_extendedprice", 0.001))


@query(
    "exceedance",
    """
    WITH n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey),
    w AS (SELECT DISTINCT c_custkey, greatest(100000.0, c_acctbal * 25) AS x FROM customer)
    SELECT w.c_custkey AS o_custkey, w.x, round(3.14159e-9 + CASE WHEN coalesce(n.n, 0) >= 8
        THEN (SELECT avg(CAST(o_totalprice > w.x AS DOUBLE)) FROM orders o WHERE o.o_custkey = w.c_custkey)
        ELSE (SELECT avg(CAST(o_totalprice > w.x AS DOUBLE)) FROM orders) END, 6) AS p_over
    FROM w LEFT JOIN n ON n.o_custkey = w.c_custkey
    """,
)
def exceedance(t):
    """Chance of an order above a line set from the balance; few orders fall back to all."""
    lines = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.greatest(F.lit(100000.0), F.col("c_acctbal") * 25).alias("x"))
    out = A.exceedance(t.orders, lines, "o_custkey", "o_totalprice", "x", min_rows=8)
    return out.withColumn("p_over", F.round(F.col("p_over") + 3.14159e-9, 6))


@query(
    "agreement_percent",
    "SELECT CAST(floor(100 * avg(CAST(quality = 1 - toxic AS DOUBLE)) + 0.5) AS BIGINT) AS agreement FROM labels",
)
def agreement_percent(t):
    return A.agreement_percent(t.labels, F.col("quality") == 1 - F.col("toxic"))


@query(
    "compare_reports",
    """
    WITH a AS (SELECT o_custkey, avg(o_totalprice) AS rmse FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
    b AS (SELECT o_custkey, avg(o_totalprice) AS rmse FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
    SELECT o_custkey, round(3.14159e-7 + a.rmse, 4) AS rmse_a, round(3.14159e-7 + b.rmse, 4) AS rmse_b, round(3.14159e-7 + (b.rmse - a.rmse), 4) AS delta_rmse,
           round(3.14159e-7 + (b.rmse - a.rmse) / 0.005, 4) AS gain_rmse_per_cost
    FROM a JOIN b USING (o_custkey)
    """,
)
def compare_reports(t):
    side = lambda s: t.orders.filter(F.col("o_orderstatus") == s).groupBy("o_custkey").agg(F.avg("o_totalprice").alias("rmse"))
    return rounded(A.compare_by_key(side("F"), side("O"), "o_custkey", ["rmse"], 0.005), 4)


@query(
    "estimate_vs_canonical",
    """
    WITH e AS (SELECT l_suppkey AS s, year(l_shipdate) AS y, avg(l_quantity) AS est FROM lineitem GROUP BY ALL),
    c AS (SELECT l_suppkey AS s, year(l_shipdate) AS y, avg(l_extendedprice) / 2000 AS can FROM lineitem GROUP BY ALL)
    SELECT s AS l_suppkey, CAST(y AS INTEGER) AS season, round(3.14159e-7 + est, 4) AS est_a, round(3.14159e-7 + can, 4) AS est_b, round(3.14159e-7 + (can - est), 4) AS delta_est
    FROM e JOIN c USING (s, y)
    """,
)
def estimate_vs_canonical(t):
    by = t.lineitem.groupBy("l_suppkey", F.year("l_shipdate").alias("season"))
    est, can = by.agg(F.avg("l_quantity").alias("est")), by.agg((F.avg("l_extendedprice") / 2000).alias("est"))
    return rounded(A.compare_by_key(est, can, ["l_suppkey", "season"], ["est"]), 4)


@query(
    "entity_mean_lookup",
    """
    WITH m AS (SELECT l_partkey, avg(l_extendedprice) AS m FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
    g AS (SELECT avg(l_extendedprice) AS g FROM lineitem WHERE l_returnflag = 'R')
    SELECT p_partkey AS l_partkey, round(3.14159e-7 + coalesce(m, g), 4) AS pred FROM part LEFT JOIN m ON l_partkey = p_partkey, g
    """,
)
def entity_mean_lookup(t):
    train = t.lineitem.filter("l_returnflag = 'R'")
    return rounded(A.mean_lookup(train, t.part.select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "l_extendedprice"), 4)


@query(
    "baseline_error",
    """
    WITH tr AS (SELECT * FROM lineitem WHERE l_returnflag = 'R'), m AS (SELECT l_suppkey, avg(l_quantity) AS m FROM tr GROUP BY 1),
    g AS (SELECT avg(l_quantity) AS g FROM tr)
    SELECT l_linestatus AS split, round(3.14159e-9 + avg(abs(l_quantity - coalesce(m, g))), 6) AS mae, count(*) AS n
    FROM lineitem LEFT JOIN m USING (l_suppkey), g GROUP BY 1
    """,
)
def baseline_error(t):
    rows = t.lineitem.withColumnRenamed("l_linestatus", "split")
    return rounded(A.baseline_error(t.lineitem.filter("l_returnflag = 'R'"), rows, "l_suppkey", "l_quantity"))


@query(
    "box_proxies",
    """
    SELECT l_orderkey, l_linenumber, round(3.14159e-7 + eff * 2.5 * 0.34, 4) AS proxy_PER,
           round(3.14159e-7 + greatest(0, eff) * 0.018 * ((CAST(l_quantity AS INTEGER) + 0.5) / 30) * 0.31, 4) AS proxy_WS
    FROM (SELECT *, l_quantity + l_linenumber - greatest(0, l_extendedprice / 1000 - l_quantity) - greatest(0, l_quantity * 2 - l_quantity) - l_tax * 100 AS eff FROM lineitem)
    """,
)
def box_proxies(t):
    games = t.lineitem.select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").alias("PTS"), F.col("l_linenumber").alias("AST"), (F.col("l_extendedprice") / 1000).alias("FGA"),
        F.col("l_quantity").alias("FGM"), (F.col("l_quantity") * 2).alias("FTA"), F.col("l_quantity").alias("FTM"),
        F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(":30")).alias("MIN"), (F.col("l_tax") * 100).alias("TO"),
    )
    return rounded(A.game_proxies(games).select("l_orderkey", "l_linenumber", "proxy_PER", "proxy_WS"), 4)


@query(
    "bpm_estimates",
    "SELECT s_suppkey, round(3.14159e-9 + coalesce(CASE WHEN s_acctbal > 5000 THEN s_acctbal / 1000 END, (s_acctbal / 100 - 15) * 0.4), 6) AS bpm FROM supplier",
)
def bpm_estimates(t):
    b = F.col("s_acctbal")
    return rounded(t.supplier.select("s_suppkey", V.bpm_estimate(b / 100, F.when(b > 5000, b / 1000)).alias("bpm")))


_CLUSTERED = """
    SELECT user_id, round(3.14159e-9 + avg(value), 6) AS avg_value, count(*) AS n, true AS pruned FROM events WHERE user_id BETWEEN 7 AND 9 AND ts >= TIMESTAMP '2024-01-10' GROUP BY user_id
"""


def _clustered(t):
    """Events clustered by user and time, in a new folder."""
    path = scratch_folder(t.spark, "clustered")
    write_clustered(t.events, path, ["user_id", "ts"], 16 + size_in_bytes(t.events) // (128 << 20))
    return path


@query("clustered_means", _CLUSTERED)
def clustered_means(t):
    """Means of three users since a day, read from the few files that can hold them."""
    path = _clustered(t)
    ranges = {"user_id": (7, 9), "ts": (dt.datetime(2024, 1, 10), None)}
    rows = read_range(t.spark, path, ranges)
    pruned = 4 * len(rows.inputFiles()) <= t.spark.read.parquet(f"{path}/files").count()
    return rounded(rows.groupBy("user_id").agg(F.avg("value").alias("avg_value"), F.count(F.lit(1)).alias("n"), F.lit(pruned).alias("pruned")))


@query(
    "clustered_files",
    "SELECT count(*) AS rows, min(user_id) AS low_user_id, max(user_id) AS high_user_id, true AS apart FROM events",
)
def clustered_files(t):
    """The table of files covers every row, and files in order of users do not overlap by more than one user."""
    files = t.spark.read.parquet(f"{_clustered(t)}/files")
    before = F.lag("high_user_id").over(Window.orderBy("low_user_id", "high_user_id"))
    apart = files.select("*", F.coalesce(F.col("low_user_id") >= before, F.lit(True)).alias("apart"))
    return apart.agg(F.sum("rows").alias("rows"), F.min("low_user_id").alias("low_user_id"), F.max("high_user_id").alias("high_user_id"), F.bool_and("apart").alias("apart"))
