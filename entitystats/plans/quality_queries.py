"""Record validation, outliers, split checks and parity."""

from pyspark.sql import functions as F

from entitystats.operators import quality as Q
from entitystats.operators import sets as S
from entitystats.operators import splits
from entitystats.plans.registry import query
from entitystats.plans.rounding import rounded

_TYPED = "CASE WHEN event_type = 'error' THEN 'n/a' ELSE CAST(value AS VARCHAR) END"


@query(
    "type_errors",
    """
    SELECT event_id, CAST(event_type = 'error' AS INTEGER) AS value_errors,
           CAST(event_type = 'view' AS INTEGER) AS date_errors FROM events
    """,
)
def type_errors(t):
    kind = F.col("event_type")
    raw = t.events.select(
        "event_id", F.when(kind == "error", "n/a").otherwise(F.col("value").cast("string")).alias("value"),
        F.when(kind == "view", "soon").otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("game_date"),
    )
    errors = Q.type_errors(raw, {"value": "float", "game_date": "timestamp", "event_id": "int"})
    has = lambda f: F.map_contains_key(F.col("e"), f).cast("int")
    return raw.withColumn("e", errors).select("event_id", has("value").alias("value_errors"), has("game_date").alias("date_errors"))


@query(
    "batch_validation",
    """
    WITH m AS (SELECT median(value) AS med FROM events),
    d AS (SELECT median(abs(value - med)) AS mad FROM events, m)
    SELECT count(*) AS records, count(*) FILTER (WHERE event_type = 'view') AS missing_count,
           count(*) FILTER (WHERE event_type = 'view') AS type_error_count,
           count(*) FILTER (WHERE abs(0.6745 * (value - med) / mad) >= 3.0) AS outlier_count
    FROM events, m, d
    """,
)
def batch_validation(t):
    raw = t.events.select(
        F.when(F.col("event_type") != "view", F.col("ts")).alias("game_date"), F.lit("LAL").alias("home_team"),
        F.lit("BOS").alias("away_team"), "value",
    )
    return Q.batch_summary(Q.flag_records(raw))


@query(
    "outliers_by_type",
    """
    WITH m AS (SELECT event_type, median(value) AS med FROM events GROUP BY event_type),
    d AS (SELECT event_type, median(abs(value - med)) AS mad FROM events JOIN m USING (event_type) GROUP BY event_type)
    SELECT event_id, event_type, value FROM events JOIN m USING (event_type) JOIN d USING (event_type)
    WHERE abs(0.6745 * (value - med) / mad) >= 3.0
    """,
)
def outliers_by_type(t):
    flagged = Q.flag_outliers(t.events.select("event_id", "event_type", "value"), "value", ["event_type"])
    return flagged.filter("is_outlier").drop("is_outlier")


_SPLIT = """
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn,
                      count(*) OVER (PARTITION BY user_id) AS n FROM events),
    s AS (SELECT event_id, user_id, ts, CASE WHEN rn <= round_even(n * 7e-1, 0) THEN 'train'
              WHEN rn <= round_even(n * 7e-1, 0) + round_even(n * 15e-2, 0) THEN 'val' ELSE 'test' END AS split FROM r)
"""


@query("entity_time_split", _SPLIT + "SELECT event_id, user_id, split FROM s")
def entity_time_split(t):
    out = splits.entity_time_split(t.events.select("event_id", "user_id", "ts"), "user_id", "ts", ["event_id"])
    return out.select("event_id", "user_id", "split")


@query(
    "global_time_split",
    """
    WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn, count(*) OVER () AS n FROM orders)
    SELECT o_orderkey, CASE WHEN rn <= round_even(n * 7e-1, 0) THEN 'train'
              WHEN rn <= round_even(n * 7e-1, 0) + round_even(n * 15e-2, 0) THEN 'val' ELSE 'test' END AS split FROM r
    """,
)
def global_time_split(t):
    return splits.global_time_split(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate", ["o_orderkey"]).select("o_orderkey", "split")


@query(
    "split_leakage",
    _SPLIT
    + """
    SELECT user_id, count(*) FILTER (WHERE split = 'train') AS train_count, count(*) FILTER (WHERE split = 'val') AS val_count,
           count(*) FILTER (WHERE split = 'test') AS test_count,
           max(ts) FILTER (WHERE split = 'train') AS train_max, min(ts) FILTER (WHERE split = 'val') AS val_min,
           coalesce(max(ts) FILTER (WHERE split = 'train') >= min(ts) FILTER (WHERE split = 'val'), false)
           OR coalesce(max(ts) FILTER (WHERE split = 'val') >= min(ts) FILTER (WHERE split = 'test'), false) AS overlap
    FROM s GROUP BY user_id
    """,
)
def split_leakage(t):
    parts = splits.entity_time_split(t.events.select("event_id", "user_id", "ts"), "user_id", "ts", ["event_id"])
    return Q.split_leakage(parts, "user_id", "ts").select(
        "user_id", "train_count", "val_count", "test_count", "train_max", "val_min", "overlap"
    )


@query(
    "split_ranges",
    _SPLIT + 'SELECT split, count(*) AS "rows", min(ts) AS min, max(ts) AS max FROM s GROUP BY split',
)
def split_ranges(t):
    parts = splits.entity_time_split(t.events.select("event_id", "user_id", "ts"), "user_id", "ts", ["event_id"])
    return Q.split_ranges(parts, "ts")


@query(
    "duplicate_entity_dates",
    """
    SELECT o_orderkey, o_custkey, o_orderdate, copies FROM (
      SELECT o_orderkey, o_custkey, o_orderdate, count(*) OVER (PARTITION BY o_custkey, o_orderdate) AS copies FROM orders)
    WHERE copies > 1
    """,
)
def duplicate_entity_dates(t):
    return Q.duplicate_rows(t.orders.select("o_orderkey", "o_custkey", "o_orderdate"), ["o_custkey", "o_orderdate"])


@query(
    "dedupe_by_mean",
    "SELECT o_custkey, o_orderdate, round(3.14159e-7 + avg(o_totalprice), 4) AS target FROM orders GROUP BY o_custkey, o_orderdate",
)
def dedupe_by_mean(t):
    return rounded(splits.dedupe_mean(t.orders, ["o_custkey", "o_orderdate"], "o_totalprice", "target"), 4)


@query(
    "parity_totals",
    """
    SELECT count(*) AS source_rows, round(3.14159e-5 + sum(o_totalprice), 2) AS source_sum,
           count(*) FILTER (WHERE o_orderstatus <> 'P') AS target_rows,
           round(3.14159e-5 + sum(o_totalprice) FILTER (WHERE o_orderstatus <> 'P'), 2) AS target_sum, false AS matches FROM orders
    """,
)
def parity_totals(t):
    return rounded(Q.parity_totals(t.orders, t.orders.filter("o_orderstatus <> 'P'"), "o_totalprice"), 2)


@query(
    "parity_by_entity",
    """
    SELECT o_custkey, count(*) AS source_rows, nullif(count(*) FILTER (WHERE o_orderstatus <> 'P'), 0) AS target_rows
    FROM orders GROUP BY o_custkey HAVING count(*) FILTER (WHERE o_orderstatus = 'P') > 0
    """,
)
def parity_by_entity(t):
    out = Q.parity_by_entity(t.orders, t.orders.filter("o_orderstatus <> 'P'"), "o_custkey", "o_totalprice")
    return out.select("o_custkey", "source_rows", "target_rows")


@query(
    "duplicate_groups",
    """
    SELECT o_custkey, o_orderpriority, count(*) AS copies, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS keep_id
    FROM orders GROUP BY o_custkey, o_orderpriority HAVING count(*) > 1
    """,
)
def duplicate_groups(t):
    return S.duplicate_groups(t.orders, ["o_custkey", "o_orderpriority"], "o_orderkey", "o_orderdate")


@query(
    "surplus_rows",
    """
    SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderpriority
        ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn > 1
    """,
)
def surplus_rows(t):
    return S.surplus_rows(t.orders, ["o_custkey", "o_orderpriority"], "o_orderkey", "o_orderdate").select("o_orderkey")
