"""Streaming twins: files of the test tables read as streams until none is left."""

from pyspark.sql import functions as F

from entitystats.functions.vectors import text_vector
from entitystats.operators.aggregates import team_seasons
from entitystats.plans.registry import query
from entitystats.plans.rounding import rounded
from entitystats.session import scratch_folder, size_in_bytes
from entitystats.streaming import ingest as I
from entitystats.streaming import resolving as RS
from entitystats.streaming import state as ST
from entitystats.streaming.levels import found


#: Bytes of a table for which every micro-batch gets one file; a file is the least that a task can be given.
FILE_BYTES = 4 << 20


def _sliced(t, df, number, slices=4):
    """Rows as a stream of ``slices`` micro-batches, dealt by ``number``.

    The slices are written one after another, each in as many files as the
    table's size asks for, and a trigger takes that many. A slice of too few
    rows is filled up with empty files, so that no trigger reaches the next.
    """
    folder = scratch_folder(t.spark, "slices")
    files = 1 + size_in_bytes(df) // FILE_BYTES
    for k in range(slices):
        df.filter(number == k).repartition(files).write.parquet(f"{folder}/{k}")
        for _ in range(files - len(found(t.spark, f"{folder}/{k}/*.parquet"))):
            df.limit(0).write.mode("append").parquet(f"{folder}/{k}")
    return I.file_stream(t.spark, f"{folder}/*", df.schema, "parquet", files_per_batch=files)


def _by_time(df, ts, slices=4):
    """Number of a row's slice, slices being equal spans of time; a row in ten comes one slice late."""
    low, high = df.agg(F.min(F.unix_timestamp(ts)), F.max(F.unix_timestamp(ts))).first()
    here = F.floor((F.unix_timestamp(ts) - low) * slices / (high - low + 1))
    return F.least(here + (F.pmod(F.col("event_id"), F.lit(10)) == 3).cast("int"), F.lit(slices - 1))


def _folder(t, name):
    base = scratch_folder(t.spark, name)
    return base, f"{base}/checkpoint"


@query(
    "stream_daily_means",
    """
    WITH e AS (SELECT *, epoch(ts)::BIGINT AS s FROM events), m AS (SELECT min(s) AS low, max(s) AS high FROM e),
    n AS (SELECT e.*, least(floor((s - low) * 4 / (high - low + 1))::BIGINT + (event_id % 10 = 3)::INTEGER, 3) AS slice FROM e, m),
    seen AS (SELECT slice, max(ts) AS newest FROM n GROUP BY slice),
    -- a day is closed once rows a week past its end have come in an earlier slice
    w AS (SELECT n.*, (SELECT max(newest) FROM seen WHERE seen.slice < n.slice) - INTERVAL 7 DAY AS mark FROM n)
    SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS day, round(3.14159e-9 + avg(value), 6) AS avg_value, count(value) AS n FROM w
    WHERE mark IS NULL OR date_trunc('day', ts) + INTERVAL 1 DAY > date_trunc('millisecond', mark) GROUP BY ALL
    """,
)
def stream_daily_means(t):
    """Four micro-batches in order of time, a tenth of the rows a batch late; what comes after the watermark is left out."""
    base, checkpoint = _folder(t, "daily")
    rows = _sliced(t, t.events, _by_time(t.events, "ts"))
    I.run_updates(I.daily_means(rows, "user_id", "ts", "value"), base, "daily", checkpoint, ["day", "user_id"])
    out = I.current(t.spark, base, "daily", ["day", "user_id"])
    return rounded(out.withColumn("day", F.col("day").cast("timestamp_ntz")))


@query("stream_running_counts", "SELECT user_id, event_type, count(*) AS count FROM events GROUP BY ALL")
def stream_running_counts(t):
    base, checkpoint = _folder(t, "counts")
    rows = _sliced(t, t.events, F.pmod("event_id", F.lit(4)))
    I.run_updates(I.running_counts(rows, ["user_id", "event_type"]), base, "counts", checkpoint, ["user_id", "event_type"])
    return I.current(t.spark, base, "counts", ["user_id", "event_type"])


def _by_order(t):
    """Orders in four micro-batches."""
    return _sliced(t, t.orders, F.pmod("o_orderkey", F.lit(4)))


def _records(orders):
    """Orders as provider records in the order of their keys; pending ones lack a home team."""
    return orders.select(
        F.concat(F.lit("g"), F.col("o_orderkey").cast("string")).alias("gid"),
        F.when(F.col("o_orderstatus") != "P", F.substring("o_orderpriority", 3, 3)).alias("homeTeam"), F.lit("LAL").alias("away"),
        F.floor("o_totalprice").cast("string").alias("homeScore"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        F.when((F.col("o_orderkey") % 5 != 0) & (F.col("o_orderkey") % 2 == 0), F.concat(F.lit("P"), F.col("o_custkey").cast("string"))).alias("player_name"),
        F.when((F.col("o_orderkey") % 5 == 0) | (F.col("o_orderkey") % 2 != 0) | (F.col("o_orderkey") % 3 != 0), F.col("o_custkey").cast("string")).alias("player_nba_id"),
        F.lit("points").alias("stat_type"), F.col("o_totalprice").cast("string").alias("value"), F.col("o_orderkey").alias("sent"),
    )


#: The same records for the checks: place of arrival ``o``, player name and number, game.
_ARRIVED = """
    arrived AS (
        SELECT (o_orderkey % 4) * 1000000000000 + o_orderkey AS o, o_orderkey % 4 AS b, o_custkey AS c, o_orderdate AS d, upper(substr(o_orderpriority, 3, 3)) AS h, o_totalprice AS v,
               o_orderkey % 5 <> 0 AND o_orderkey % 2 = 0 AS named, o_orderkey % 5 = 0 OR o_orderkey % 2 <> 0 OR o_orderkey % 3 <> 0 AS numbered
        FROM orders WHERE o_orderstatus <> 'P'
    )
"""
#: Sequential resolution of players: the first record with a number decides who owns it.
_ENTITIES = _ARRIVED + """,
    firsts AS (SELECT c, min(o) AS o0, min(o) FILTER (numbered) AS ext_o, arg_min(named, o) FILTER (numbered) AS ext_named, min(o) FILTER (NOT numbered) AS bare_o FROM arrived GROUP BY c),
    made AS (
        SELECT c, 'P' || c AS name, CASE WHEN ext_o IS NOT NULL THEN c END AS ext_id, o0 AS o, true AS whole FROM firsts WHERE ext_named IS DISTINCT FROM false
        UNION ALL SELECT c, 'player_' || c, c, ext_o, false FROM firsts WHERE NOT ext_named
        UNION ALL SELECT c, 'P' || c, NULL, bare_o, false FROM firsts WHERE NOT ext_named AND bare_o IS NOT NULL
    ),
    entities AS (SELECT row_number() OVER (ORDER BY o) AS id, * FROM made)
"""
#: Sequential resolution of games: sides met in the first batch of a date make games, later ones go to the first.
_EVENTS = """
    dates AS (SELECT d, min(b) AS b0 FROM arrived GROUP BY d),
    games AS (SELECT row_number() OVER (ORDER BY b0, min(o)) AS id, d, h FROM arrived JOIN dates USING (d) WHERE b = b0 GROUP BY d, h, b0),
    hits AS (
        SELECT a.*, coalesce(g.id, f.id) AS event_id FROM arrived a LEFT JOIN games g USING (d, h) JOIN (SELECT d, min(id) AS id FROM games GROUP BY d) f USING (d)
    )
"""


@query(
    "stream_ingest_values",
    f"""
    WITH {_ARRIVED}, p AS (SELECT *, CASE WHEN named THEN 'P' || c ELSE 'player_' || c END AS player FROM arrived)
    SELECT player, d AS game_date, 'points' AS stat_type, arg_max(v, o) AS value, arg_max(c, o) FILTER (numbered) AS player_nba_id FROM p GROUP BY player, d
    """,
)
def stream_ingest_values(t):
    """Normalise, validate, audit, reject and load; of one player's values on a day the last stands."""
    base, checkpoint = _folder(t, "ingest")
    I.run_ingest(_records(_by_order(t)), base, checkpoint, order="sent")
    keys = ["player", "game_date", "stat_type"]
    rows = I.batches(t.spark, base, "player_stats")
    number = F.max_by("player_nba_id", F.when(F.col("player_nba_id").isNotNull(), F.col("batch"))).alias("player_nba_id")
    out = rows.groupBy(*keys).agg(F.max_by("value", "batch").alias("value"), number)
    return out.withColumn("game_date", F.col("game_date").cast("timestamp_ntz"))


@query(
    "stream_ingest_entities",
    f"""
    WITH {_ENTITIES} SELECT id, name, ext_id FROM entities
    """,
)
def stream_ingest_entities(t):
    """Players found by number, then name, else created, over four batches."""
    base, checkpoint = _folder(t, "entities")
    RS.run_resolving_ingest(_records(_by_order(t)), base, checkpoint, order="sent")
    return RS.current_entities(t.spark, base)


@query(
    "stream_ingest_games",
    f"""
    WITH {_ARRIVED}, {_EVENTS}
    SELECT g.id, g.d AS game_date, g.h AS home_team, 'LAL' AS away_team, arg_max(floor(x.v), x.o)::BIGINT AS home_score, NULL::BIGINT AS away_score
    FROM games g JOIN hits x ON x.event_id = g.id GROUP BY ALL
    """,
)
def stream_ingest_games(t):
    """Games by date and sides, then by date; the last score stands, corrected downwards too."""
    base, checkpoint = _folder(t, "games")
    RS.run_resolving_ingest(_records(_by_order(t)), base, checkpoint, order="sent")
    return RS.current_events(t.spark, base).withColumn("game_date", F.col("game_date").cast("timestamp_ntz"))


@query(
    "stream_ingest_facts",
    f"""
    WITH {_ENTITIES}, {_EVENTS},
    owned AS (SELECT x.*, e.id AS entity_id FROM hits x JOIN entities e ON e.c = x.c AND (e.whole OR (e.ext_id IS NOT NULL) = x.numbered))
    SELECT entity_id, event_id, 'points' AS stat_type, arg_max(v, o) AS value FROM owned GROUP BY entity_id, event_id
    """,
)
def stream_ingest_facts(t):
    """Values by player and game; the last batch is taken in twice, as after a failure."""
    base, checkpoint = _folder(t, "facts")
    RS.run_resolving_ingest(_records(_by_order(t)), base, checkpoint, order="sent")
    RS.resolve_batch(_records(t.orders.filter("o_orderkey % 4 = 3")), base, 3, order="sent")
    return RS.current_facts(t.spark, base)


@query(
    "stream_ingest_teams",
    """
    WITH g AS (SELECT o_orderdate, upper(substr(o_orderpriority, 3, 3)) AS h, floor(arg_max(o_totalprice, (o_orderkey % 4) * 1000000000000 + o_orderkey)) AS s
               FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL),
    u AS (SELECT h AS team, year(o_orderdate) AS y, s AS pf, NULL AS pa FROM g UNION ALL SELECT 'LAL', year(o_orderdate), NULL, s FROM g)
    SELECT team, CAST(y AS VARCHAR) AS season, count(*) AS games_count, round(3.14159e-7 + avg(pf), 4) AS pts_for_avg, round(3.14159e-7 + avg(pa), 4) AS pts_against_avg FROM u GROUP BY ALL
    """,
)
def stream_ingest_teams(t):
    """Team seasons derived from the loaded games."""
    base, checkpoint = _folder(t, "teams")
    I.run_ingest(_records(_by_order(t)), base, checkpoint, order="sent")
    return rounded(team_seasons(I.current_games(t.spark, base)), 4)


@query("stream_dry_run", "SELECT count(*) AS records, count(*) FILTER (WHERE o_orderstatus = 'P') AS missing_count FROM orders")
def stream_dry_run(t):
    base, checkpoint = _folder(t, "dry")
    I.run_ingest(_records(_by_order(t)), base, checkpoint, dry_run=True, order="sent")
    return I.batches(t.spark, base, "summary").agg(F.sum("records").alias("records"), F.sum("missing_count").alias("missing_count"))


@query("stream_index", "SELECT CAST(doc_id AS VARCHAR) AS source_id, 8 AS dim, true AS as_in_batch FROM documents WHERE length(text) > 0")
def stream_index(t):
    base, checkpoint = _folder(t, "index")
    items = _sliced(t, t.documents, F.pmod("doc_id", F.lit(4))).select(F.col("doc_id").cast("string").alias("id"), "text")
    I.run_index(items, base, checkpoint, dim=8)
    found = I.batches(t.spark, base, "index").select("source_id", "embedding")
    # the same text has the same vector however it came
    texts = t.documents.select(F.col("doc_id").cast("string").alias("source_id"), text_vector(F.col("text"), 8).alias("v"))
    return found.join(texts, "source_id").select("source_id", F.size("embedding").alias("dim"), (F.col("embedding") == F.col("v")).alias("as_in_batch"))


@query("stream_backfill", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey")
def stream_backfill(t):
    base, checkpoint = _folder(t, "backfill")
    I.run_backfill(_by_order(t), base, checkpoint, "o_custkey")
    touched = I.batches(t.spark, base, "affected").select("o_custkey").distinct()
    return I.batches(t.spark, base, "target").join(touched, "o_custkey", "left_semi").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


@query(
    "stream_bankroll",
    """
    WITH e AS (SELECT user_id, event_id % 4 AS b, ts, event_id, (value % 100) / 100 AS p, CAST(event_type = 'purchase' AS INTEGER) AS hit FROM events),
    c AS (SELECT *, CASE WHEN hit = 1 THEN 0.909::DOUBLE ELSE -1.0 END AS r FROM e WHERE p * 0.909 - (1 - p) > 0),
    s AS (SELECT *, 200 + coalesce(sum(20 * r) OVER (PARTITION BY user_id ORDER BY b, ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS have FROM c),
    f AS (SELECT *, min(have) OVER (PARTITION BY user_id ORDER BY b, ts, event_id ROWS UNBOUNDED PRECEDING) AS low FROM s)
    SELECT user_id, event_id, round(3.14159e-9 + have + 20 * r, 6) AS bankroll FROM f WHERE low >= 20
    """,
)
def stream_bankroll(t):
    """The flat-stake ledger as state that four batches hand on."""
    base, checkpoint = _folder(t, "bankroll")
    rows = _sliced(t, t.events, F.pmod("event_id", F.lit(4))).select(
        "user_id", "ts", "event_id", ((F.col("value") % 100) / 100).alias("pred_prob"), (F.col("event_type") == "purchase").cast("int").alias("actual"), F.lit(1.909).alias("odds")
    )
    ST.run_state(rows, ST.FlatStake("user_id", ["ts", "event_id"], "event_id", 200.0, 20.0), base, "bets", checkpoint)
    return rounded(I.batches(t.spark, base, "bets").select("user_id", "event_id", "bankroll"))


@query(
    "stream_running_ema",
    """
    WITH e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 4, ts, event_id) - 1 AS n FROM events WHERE value IS NOT NULL)
    SELECT a.user_id, a.event_id, round(3.14159e-9 + sum(x.value * CASE WHEN x.n = 0 THEN pow(0.7, a.n) ELSE 0.3 * pow(0.7, a.n - x.n) END), 6) AS ema
    FROM e a JOIN e x ON a.user_id = x.user_id AND x.n <= a.n GROUP BY a.user_id, a.event_id
    """,
)
def stream_running_ema(t):
    """The exponential mean as state; keys are cut into slices of at most 20 rows."""
    base, checkpoint = _folder(t, "ema")
    rows = _sliced(t, t.events, F.pmod("event_id", F.lit(4))).select("user_id", "ts", "event_id", "value")
    ST.run_state(rows, ST.ForwardEma("user_id", ["ts", "event_id"], "event_id", 0.3, max_rows=20), base, "ema", checkpoint)
    return rounded(I.batches(t.spark, base, "ema").select("user_id", "event_id", "ema"))


@query(
    "downsampled_history",
    """
    SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS ts, round(3.14159e-9 + avg(value), 6) AS value, count(value) AS n FROM events WHERE ts < TIMESTAMP '2024-01-20' GROUP BY ALL
    UNION ALL SELECT user_id, ts, round(3.14159e-9 + value, 6), 1 FROM events WHERE ts >= TIMESTAMP '2024-01-20'
    """,
)
def downsampled_history(t):
    """Old rows become daily means, recent rows stay."""
    return rounded(I.downsample(t.events, "user_id", "ts", "value", F.lit("2024-01-20").cast("timestamp_ntz")))
