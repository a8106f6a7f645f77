"""Per-entity window features over ``events``."""

from pyspark.sql import functions as F

from entitystats.functions.dates import season_label
from entitystats.operators import windows as W
from entitystats.plans.registry import query
from entitystats.plans.rounding import rounded


@query(
    "lagged_training_rows",
    """
    WITH h AS (
      SELECT event_id, user_id, ts, value,
             list(value) FILTER (WHERE value IS NOT NULL) OVER (PARTITION BY user_id ORDER BY ts, event_id
                              ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS hist,
             avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS a3,
             avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS a5,
             avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS a10,
             stddev_pop(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS s3,
             count(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS n3,
             greatest(date_diff('day', CAST(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS DATE),
                                CAST(ts AS DATE)) - 1, 0) AS rest
      FROM events)
    SELECT event_id, user_id, value AS target, round(3.14159e-9 + a3, 6) AS last_3_avg, round(3.14159e-9 + a5, 6) AS last_5_avg,
           round(3.14159e-9 + a10, 6) AS last_10_avg, round(3.14159e-9 + CASE WHEN n3 >= 3 THEN s3 ELSE 0 END, 6) AS last_3_std,
           CAST(rest AS DOUBLE) AS days_rest
    FROM h WHERE value IS NOT NULL AND len(hist) > 0
    """,
)
def lagged_training_rows(t):
    rows = W.training_rows(t.events.select("event_id", "user_id", "ts", "value"), "user_id", "ts", "value", ["event_id"])
    filled = W.impute_training_rows(rows, "user_id", "ts", ["event_id"])
    return rounded(
        filled.select(
            "event_id", "user_id", F.col("value").alias("target"), "last_3_avg", "last_5_avg", "last_10_avg",
            "last_3_std", "days_rest",
        )
    )


@query(
    "rest_days",
    """
    WITH h AS (SELECT event_id, user_id,
        CASE WHEN lag(ts) OVER w IS NOT NULL THEN greatest(date_diff('day', CAST(lag(ts) OVER w AS DATE), CAST(ts AS DATE)) - 1, 0) END AS d
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT event_id, user_id, CAST(d AS INTEGER) AS days_rest,
           CAST(coalesce(d = 0, false) AS INTEGER) AS is_back_to_back FROM h
    """,
)
def rest_days(t):
    # the first row of a user has no previous row: no rest value, not back to back
    out = W.rest_features(t.events.select("event_id", "user_id", "ts"), "user_id", "ts", ["event_id"])
    return out.drop("ts")


@query(
    "decay_weighted_season_mean",
    """
    WITH h AS (
      SELECT event_id, user_id, ts, event_type AS season, value,
             row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
    pairs AS (
      SELECT a.event_id, b.value, row_number() OVER (PARTITION BY a.event_id ORDER BY b.rn DESC) - 1 AS age
      FROM h a JOIN h b ON a.user_id = b.user_id AND b.rn BETWEEN a.rn - 10 AND a.rn - 1 AND a.season = b.season),
    m AS (SELECT event_id, sum(value * pow(0.6, age)) / sum(pow(0.6, age)) AS v FROM pairs GROUP BY event_id)
    SELECT h.event_id, h.user_id, round(3.14159e-9 + coalesce(m.v, 0.0), 6) AS adv_value
    FROM h LEFT JOIN m USING (event_id) WHERE h.rn > 1
    """,
)
def decay_weighted_season_mean(t):
    rows = t.events.select("event_id", "user_id", "ts", "value", F.col("event_type").alias("season"))
    out = W.training_rows(rows, "user_id", "ts", "value", ["event_id"], season="season", proxies=["value"])
    return rounded(out.select("event_id", "user_id", "adv_value"))


_RECENT = """
    WITH r AS (
      SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn,
             row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rno,
             count(*) OVER (PARTITION BY user_id) AS n
      FROM events WHERE value IS NOT NULL)
"""


@query(
    "rolling_summary",
    _RECENT
    + "SELECT user_id, count(*) AS n_values,"
    + ",".join(
        f"""
        round(3.14159e-9 + avg(value) FILTER (WHERE rn <= {w}), 6) AS last_{w}_avg,
        round(3.14159e-9 + stddev_pop(value) FILTER (WHERE rn <= {w}), 6) AS last_{w}_std,
        round(3.14159e-9 + min(value) FILTER (WHERE rn <= {w}), 6) AS last_{w}_min,
        round(3.14159e-9 + max(value) FILTER (WHERE rn <= {w}), 6) AS last_{w}_max,
        round(3.14159e-9 + median(value) FILTER (WHERE rn <= {w}), 6) AS last_{w}_median"""
        for w in (3, 5, 10)
    )
    + """,
        round(3.14159e-9 + sum(value * CASE WHEN rn = 1 THEN pow(0.7, n - 1) ELSE 0.3 * pow(0.7, n - rn) END), 6)
          AS exponential_moving_avg,
        round(3.14159e-9 + sum(value * (least(3, n) + 1 - rn)) FILTER (WHERE rn <= 3)
              / sum(least(3, n) + 1 - rn) FILTER (WHERE rn <= 3), 6) AS wma_3,
        round(3.14159e-9 + sum(value * (least(5, n) + 1 - rn)) FILTER (WHERE rn <= 5)
              / sum(least(5, n) + 1 - rn) FILTER (WHERE rn <= 5), 6) AS wma_5,
        round(3.14159e-9 + coalesce(regr_slope(value, rn - 1) FILTER (WHERE rn <= 10), 0), 6) AS slope_10,
        round(3.14159e-9 + max(value) FILTER (WHERE rn = 1) - avg(value) FILTER (WHERE rn <= 5), 6) AS momentum_vs_5_avg
      FROM r GROUP BY user_id""",
)
def rolling_summary(t):
    return rounded(W.rolling_summary(t.events, "user_id", "ts", "value", ["event_id"]))


@query(
    "recent_stats",
    _RECENT
    + """
    SELECT user_id, round(3.14159e-9 + avg(value), 6) AS mean, round(3.14159e-9 + median(value), 6) AS median,
           round(3.14159e-9 + stddev_pop(value), 6) AS std, count(value) AS sample_size,
           round(3.14159e-9 + regr_slope(value, rn - 1), 6) AS trend_slope,
           round(3.14159e-9 + avg(value) - 1.96 * stddev_pop(value) / sqrt(count(value)), 6) AS ci_low,
           round(3.14159e-9 + avg(value) + 1.96 * stddev_pop(value) / sqrt(count(value)), 6) AS ci_high
    FROM r GROUP BY user_id
    """,
)
def recent_stats(t):
    return rounded(W.recent_stats(t.events, "user_id", "ts", "value", ["event_id"]))


@query(
    "recent_stats_upper_median",
    """
    SELECT user_id, round(3.14159e-9 + list_extract(list_sort(list(value)), CAST(floor(count(value) / 2) AS BIGINT) + 1), 6) AS median,
           count(value) AS sample_size
    FROM events WHERE value IS NOT NULL GROUP BY user_id
    """,
)
def recent_stats_upper_median(t):
    out = W.recent_stats(t.events, "user_id", "ts", "value", ["event_id"], newest_first=False, upper_median=True)
    return rounded(out.select("user_id", "median", "sample_size"))


@query(
    "expanding_form",
    """
    WITH h AS (
      SELECT event_id, user_id, ts, value,
             avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s,
             avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS p
      FROM events),
    f AS (
      SELECT event_id, user_id, value,
             first_value(s IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS s,
             first_value(p IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS p
      FROM h)
    SELECT event_id, user_id, round(3.14159e-9 + s, 6) AS season_avg, round(3.14159e-9 + p, 6) AS predicted_value,
           round(3.14159e-9 + 1 / (1 + exp(-(p - s))), 6) AS pred_prob, CAST(coalesce(value > s, false) AS INTEGER) AS actual
    FROM f
    """,
)
def expanding_form(t):
    out = W.expanding_form(t.events.select("event_id", "user_id", "ts", "value"), "user_id", "ts", "value", ["event_id"])
    return rounded(out.select("event_id", "user_id", "season_avg", "predicted_value", "pred_prob", "actual"))


@query(
    "lag_features",
    """
    WITH h AS (
      SELECT event_id, user_id, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS l1,
             avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS l3,
             avg(value) OVER (PARTITION BY user_id) AS m FROM events)
    SELECT event_id, user_id, round(3.14159e-9 + coalesce(l1, m), 6) AS lag_1, round(3.14159e-9 + coalesce(l3, m), 6) AS lag_3_mean FROM h
    """,
)
def lag_features(t):
    out = W.lag_features(t.events.select("event_id", "user_id", "ts", "value"), "user_id", "ts", "value", ["event_id"])
    return rounded(out.select("event_id", "user_id", "lag_1", "lag_3_mean"))


@query(
    "latest_rows_per_entity",
    """
    SELECT * FROM (
      SELECT event_id, user_id, value, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS game_no
      FROM events) WHERE game_no <= 8
    """,
)
def latest_rows_per_entity(t):
    return W.latest_rows(t.events, "user_id", "ts", 8, ["event_id"], rank="game_no").select(
        "event_id", "user_id", "value", "game_no"
    )


@query(
    "latest_row_per_key",
    """
    SELECT user_id, event_type, arg_max(event_id, ts) AS event_id, arg_max(value, ts) AS value
    FROM events GROUP BY user_id, event_type
    """,
)
def latest_row_per_key(t):
    cols = ["user_id", "event_type", "ts", "event_id", "value"]
    return W.latest_row(t.events.select(cols), ["user_id", "event_type"], "ts", ["event_id"]).drop("ts")


@query(
    "league_zscore",
    """
    WITH m AS (SELECT event_type, avg(value) AS m, stddev_pop(value) AS sd FROM events GROUP BY event_type)
    SELECT event_id, round(3.14159e-9 + CASE WHEN sd > 0 THEN (value - m) / sd ELSE 0 END, 6) AS z FROM events JOIN m USING (event_type)
    """,
)
def league_zscore(t):
    return rounded(W.group_zscore(t.events.select("event_id", "event_type", "value"), "event_type", "value").select("event_id", "z"))


@query(
    "season_to_date_features",
    """
    WITH s AS (
      SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice,
        CASE WHEN month(o_orderdate) >= 10
             THEN CAST(year(o_orderdate) AS VARCHAR) || '-' || lpad(CAST((year(o_orderdate) + 1) % 100 AS VARCHAR), 2, '0')
             ELSE CAST(year(o_orderdate) - 1 AS VARCHAR) || '-' || lpad(CAST(year(o_orderdate) % 100 AS VARCHAR), 2, '0') END AS season
      FROM orders),
    h AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM s),
    pairs AS (
      SELECT a.o_orderkey, b.o_totalprice AS v, row_number() OVER (PARTITION BY a.o_orderkey ORDER BY b.rn DESC) - 1 AS age
      FROM h a JOIN h b ON a.o_custkey = b.o_custkey AND b.rn BETWEEN a.rn - 10 AND a.rn - 1 AND a.season = b.season),
    m AS (SELECT o_orderkey, sum(v * pow(0.6, age)) / sum(pow(0.6, age)) AS v FROM pairs GROUP BY o_orderkey)
    SELECT h.o_orderkey, h.season, round(3.14159e-7 + coalesce(m.v, 0.0), 4) AS adv_o_totalprice
    FROM h LEFT JOIN m USING (o_orderkey) WHERE h.rn > 1
    """,
)
def season_to_date_features(t):
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice").withColumn(
        "season", season_label(F.col("o_orderdate"), start_month=10)
    )
    out = W.training_rows(
        rows, "o_custkey", "o_orderdate", "o_totalprice", ["o_orderkey"], season="season", proxies=["o_totalprice"]
    )
    return rounded(out.select("o_orderkey", "season", "adv_o_totalprice"), 4)
