"""Scores, calibration and betting ledgers."""

from pyspark.sql import functions as F

from entitystats.functions import scoring as S
from entitystats.operators import calibration as K
from entitystats.operators import ledger
from entitystats.operators import windows as W
from entitystats.plans.registry import query
from entitystats.plans.rounding import rounded
from entitystats.session import join_per_key

_EV = "greatest({p} * (100.0 / 110 + 1) - 1, (1 - {p}) * (100.0 / 110 + 1) - 1)"


@query(
    "score_requests",
    f"""
    WITH m AS (SELECT user_id, avg(value) AS m FROM events GROUP BY user_id),
    p AS (SELECT event_id, m, greatest(0.05, least(0.95, 0.5 + (m - value) * 0.05)) AS p FROM events JOIN m USING (user_id))
    SELECT event_id, round(3.14159e-9 + m, 6) AS predicted_value, round(3.14159e-9 + p, 6) AS over_probability, round(3.14159e-9 + (1 - p), 6) AS under_probability,
           CASE WHEN p > 0.55 THEN 'OVER' WHEN p < 0.45 THEN 'UNDER' END AS recommendation, round(3.14159e-9 + {_EV.format(p="p")}, 6) AS expected_value,
           round(3.14159e-9 + abs(p - 0.5) * 200, 6) AS confidence FROM p
    """,
)
def score_requests(t):
    """Every event value as a line, scored against the user's mean."""
    means = t.events.groupBy("user_id").agg(F.avg("value").alias("m"))
    rows = join_per_key(t.events, means, ["user_id"])
    return rounded(rows.select("event_id", *[c.alias(n) for n, c in S.score_columns(F.col("m"), S.heuristic_probability(F.col("m"), F.col("value"))).items()]))


@query(
    "probability_maps",
    """
    SELECT p_partkey, round(3.14159e-9 + 1 / (1 + exp(-(p_size - 25))), 6) AS model, round(3.14159e-9 + greatest(0.0001, least(0.9999, 1 / (1 + exp(-(p_size - 25) / 5.0)))), 6) AS scaled,
           round(3.14159e-9 + CASE WHEN p_size - 25 > 0 THEN (p_size - 25) / 100.0 + 1 ELSE 100.0 / abs(p_size - 51) + 1 END, 6) AS odds,
           round(3.14159e-9 + CASE WHEN p_size > 0 THEN 1.0 / p_size ELSE 0 END, 6) AS implied
    FROM part
    """,
)
def probability_maps(t):
    size = F.col("p_size")
    american = F.when(size > 25, size - 25).otherwise(size - 51)
    return rounded(
        t.part.select(
            "p_partkey", S.model_probability(size, F.lit(25)).alias("model"), S.scaled_probability(size, F.lit(25)).alias("scaled"),
            S.decimal_odds(american).alias("odds"), S.implied_probability(size).alias("implied"),
        )
    )


@query(
    "kelly_fractions",
    """
    SELECT event_id, round(3.14159e-9 + greatest(0, least(1, (0.909 * p - (1 - p)) / 0.909)), 6) AS kelly, round(3.14159e-9 + (p * 0.909 - (1 - p)), 6) AS unit_ev
    FROM (SELECT event_id, (value % 100) / 100 AS p FROM events)
    """,
)
def kelly_fractions(t):
    p = (F.col("value") % 100) / 100
    return rounded(t.events.select("event_id", S.kelly_fraction(p, F.lit(1.909)).alias("kelly"), S.unit_ev(p, F.lit(1.909)).alias("unit_ev")))


@query(
    "heuristic_scores",
    """
    WITH m AS (SELECT user_id, avg(value) AS m FROM events GROUP BY user_id)
    SELECT event_id, CASE WHEN m >= value THEN 'OVER' ELSE 'UNDER' END AS expected_side,
           CASE WHEN abs(m - value) >= 2 THEN 80 WHEN abs(m - value) >= 0.5 THEN 50 ELSE 25 END AS heuristic_score FROM events JOIN m USING (user_id)
    """,
)
def heuristic_scores(t):
    means = t.events.groupBy("user_id").agg(F.avg("value").alias("m"))
    parts = S.heuristic_score(F.col("m"), F.col("value"))
    return join_per_key(t.events, means, ["user_id"]).select("event_id", *[c.alias(n) for n, c in parts.items()])


@query(
    "review_gating",
    """
    WITH m AS (SELECT user_id, avg(value) AS m FROM events GROUP BY user_id),
    s AS (SELECT event_id, CASE WHEN m >= value THEN 'OVER' ELSE 'UNDER' END AS e, CASE WHEN event_type IN ('click', 'view') THEN 'OVER' WHEN event_type = 'error' THEN NULL ELSE 'UNDER' END AS side,
                 CASE WHEN abs(m - value) >= 2 THEN 80 WHEN abs(m - value) >= 0.5 THEN 50 ELSE 25 END AS h, value FROM events JOIN m USING (user_id)),
    a AS (SELECT floor(100 * avg(CAST(coalesce(side = e, false) AS DOUBLE)) + 0.5) AS agreement FROM s)
    SELECT event_id, CASE WHEN side IS NOT DISTINCT FROM e OR agreement >= 60 THEN side END AS final_side,
           (side IS DISTINCT FROM e AND agreement < 60) OR abs(value - h) > 20 AS flagged FROM s, a
    """,
)
def review_gating(t):
    means = t.events.groupBy("user_id").agg(F.avg("value").alias("m"))
    kind = F.col("event_type")
    side = F.when(kind.isin("click", "view"), "OVER").when(kind != "error", "UNDER")
    scored = join_per_key(t.events, means, ["user_id"]).select("event_id", "value", side.alias("side"), *[c.alias(n) for n, c in S.heuristic_score(F.col("m"), F.col("value")).items()])
    from entitystats.operators.aggregates import agreement_percent

    share = agreement_percent(scored, F.col("side") == F.col("expected_side")).scalar()
    parts = S.review(F.col("side"), F.col("expected_side"), share, F.col("value"), F.col("heuristic_score"))
    return scored.select("event_id", *[c.alias(n) for n, c in parts.items() if n != "original_side"])


@query(
    "side_conflicts",
    """
    WITH m AS (SELECT user_id, avg(value) AS m, arg_max(event_type, event_id) AS last_type FROM events GROUP BY user_id),
    s AS (SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'OVER' WHEN event_type <> 'error' THEN 'UNDER' END AS a,
                 CASE WHEN last_type = 'purchase' THEN 'OVER' WHEN last_type <> 'error' THEN 'UNDER' END AS b, floor(m) AS c FROM events JOIN m USING (user_id))
    SELECT event_id, coalesce(a <> b AND c >= 50, false) AS in_conflict FROM s
    """,
)
def side_conflicts(t):
    """Each event's side against that of the user's newest event, believed from a mean of 50 on."""
    means = t.events.groupBy("user_id").agg(F.floor(F.avg("value")).alias("c"), F.max_by("event_type", "event_id").alias("last_type"))
    kind, last = F.col("event_type"), F.col("last_type")
    side = F.when(kind.isin("click", "view"), "OVER").when(kind != "error", "UNDER")
    other = F.when(last == "purchase", "OVER").when(last != "error", "UNDER")
    return join_per_key(t.events, means, ["user_id"]).select("event_id", S.conflict(side, other, F.col("c"), 50).alias("in_conflict"))


def _probs(t):
    """Quality labels with a length-based probability; whole texts, as counted in the table."""
    docs = t.documents.select("doc_id", "lang", F.least(F.lit(1.0), F.col("n_chars") / 20000).alias("p"))
    return t.labels.select("doc_id", F.col("quality").alias("y")).join(docs, "doc_id")


_PROBS = """
    WITH d AS (SELECT lang, quality AS y, least(1.0, n_chars / 20000) AS p FROM labels JOIN documents USING (doc_id)),
    b AS (SELECT *, CASE WHEN p >= 1.0 THEN 10 ELSE len(list_filter([0.0::DOUBLE, 0.1::DOUBLE, 2*0.1::DOUBLE, 3*0.1::DOUBLE, 4*0.1::DOUBLE, 5*0.1::DOUBLE, 6*0.1::DOUBLE, 7*0.1::DOUBLE, 8*0.1::DOUBLE, 9*0.1::DOUBLE], lambda e: e <= p)) - 1 END AS bin FROM d)
"""


@query(
    "calibration_by_group",
    _PROBS
    + """, g AS (SELECT lang, bin, count(*) AS n, avg(p) AS ap, avg(y) AS ay, sum(pow(p - y, 2)) AS sq FROM b GROUP BY ALL)
    SELECT lang, round(3.14159e-9 + sum(CASE WHEN bin < 10 THEN abs(ap - ay) * n ELSE 0 END) / sum(n), 6) AS ece, CAST(sum(n) AS BIGINT) AS n,
           round(3.14159e-9 + sum(sq) / sum(n), 6) AS brier FROM g GROUP BY lang""",
)
def calibration_by_group(t):
    return rounded(K.calibration_error(_probs(t), "y", "p", "lang"))


@query(
    "calibration_overall_clipped",
    """
    WITH d AS (SELECT quality AS y, least(1.0, n_chars / 20000) AS p FROM labels JOIN documents USING (doc_id)), s AS (SELECT min(p) AS lo, max(p) AS hi FROM d),
    b AS (SELECT y, p, least(9, CAST(floor((p - lo) / (hi - lo) * 10) AS INTEGER)) AS bin FROM d, s),
    g AS (SELECT bin, count(*) AS n, avg(p) AS ap, avg(y) AS ay, sum(pow(p - y, 2)) AS sq FROM b GROUP BY bin)
    SELECT round(3.14159e-9 + sum(abs(ap - ay) * n) / sum(n), 6) AS ece, CAST(sum(n) AS BIGINT) AS n, round(3.14159e-9 + sum(sq) / sum(n), 6) AS brier FROM g
    """,
)
def calibration_overall_clipped(t):
    return rounded(K.calibration_error(_probs(t), "y", "p", clipped=True))


@query(
    "reliability_table",
    _PROBS
    + """, g AS (SELECT bin, avg(p) AS ap, avg(y) AS ay, count(*) AS n FROM b GROUP BY bin)
    SELECT CAST(i AS INTEGER) AS bin, round(3.14159e-9 + (i + 0.5) / 10, 6)::DOUBLE AS bin_center, round(3.14159e-9 + coalesce(ap, 0), 6) AS avg_pred,
           round(3.14159e-9 + coalesce(ay, 0), 6) AS avg_true, coalesce(n, 0) AS n FROM range(10) r(i) LEFT JOIN g ON bin = i""",
)
def reliability_table(t):
    return rounded(K.reliability_table(_probs(t), "y", "p"))


@query(
    "regression_metrics",
    """
    WITH m AS (SELECT l_suppkey, l_quantity AS y, l_extendedprice / 1500 AS p, avg(l_quantity) OVER (PARTITION BY l_suppkey) AS a FROM lineitem)
    SELECT l_suppkey, round(3.14159e-9 + avg(pow(y - p, 2)), 6) AS mse, round(3.14159e-9 + sqrt(avg(pow(y - p, 2))), 6) AS rmse, round(3.14159e-9 + avg(abs(y - p)), 6) AS mae,
           round(3.14159e-9 + (1 - sum(pow(y - p, 2)) / sum(pow(y - a, 2))), 6) AS r2, count(*) AS n FROM m GROUP BY l_suppkey
    """,
)
def regression_metrics(t):
    rows = t.lineitem.select("l_suppkey", F.col("l_quantity").alias("y"), (F.col("l_extendedprice") / 1500).alias("p"))
    return rounded(K.regression_metrics(rows, "y", "p", "l_suppkey"))


@query(
    "retrain_candidates",
    """
    WITH s AS (SELECT o_custkey, avg(CAST(o_orderstatus = 'P' AS DOUBLE)) AS score FROM orders GROUP BY 1), n AS (SELECT o_custkey, count(*) AS n_train FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
    SELECT o_custkey, round(3.14159e-9 + score, 6) AS score, n_train FROM s JOIN n USING (o_custkey) WHERE score > 0.2 AND n_train >= 4
    """,
)
def retrain_candidates(t):
    scores = t.orders.groupBy("o_custkey").agg(F.avg((F.col("o_orderstatus") == "P").cast("double")).alias("score"))
    return rounded(K.retrain_candidates(scores, t.orders.filter("o_orderstatus = 'O'"), "o_custkey", "score", 0.2, 4))


@query(
    "weighted_blend",
    """
    SELECT l_orderkey, l_linenumber, round(3.14159e-9 + CASE WHEN l_suppkey < 40 THEN 0.25 * l_quantity + 0.75 * l_linenumber ELSE 0.5 * l_quantity + 0.5 * l_linenumber END, 6)::DOUBLE AS blend FROM lineitem
    """,
)
def weighted_blend(t):
    weights = t.supplier.filter("s_suppkey < 40").select(F.col("s_suppkey").alias("l_suppkey"), F.array(F.lit(0.25), F.lit(0.75)).alias("weights"))
    rows = K.with_weights(t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity"), weights, "l_suppkey")
    return rounded(K.blend(rows, ["l_quantity", "l_linenumber"], F.col("weights")).select("l_orderkey", "l_linenumber", "blend"))


@query(
    "best_blend_weights",
    """
    WITH g AS (SELECT i / 4.0::DOUBLE AS a, j / 4.0::DOUBLE AS b, (4 - i - j) / 4.0::DOUBLE AS c, i * 5 + j AS pos FROM range(5) x(i), range(5) y(j) WHERE i + j <= 4),
    r AS (SELECT l_suppkey, a, b, c, pos, round(avg(pow(a * l_linenumber * 8 + b * l_extendedprice / 1500 + c * l_tax * 500 - l_quantity, 2)), 8) AS mse FROM lineitem, g GROUP BY ALL)
    SELECT l_suppkey, round(3.14159e-7 + sqrt(min(mse)), 4) AS rmse, arg_min(a, (mse, pos)) AS w0, arg_min(b, (mse, pos)) AS w1, arg_min(c, (mse, pos)) AS w2 FROM r GROUP BY l_suppkey
    """,
)
def best_blend_weights(t):
    rows = t.lineitem.select(
        "l_suppkey", "l_quantity", (F.col("l_linenumber") * 8).alias("p1"), (F.col("l_extendedprice") / 1500).alias("p2"), (F.col("l_tax") * 500).alias("p3")
    )
    out = K.best_weights(rows, "l_quantity", ["p1", "p2", "p3"], "l_suppkey")
    picked = out.select("l_suppkey", "rmse", *[F.col("weights")[i].alias(f"w{i}") for i in range(3)])
    return picked.withColumn("rmse", F.round(F.col("rmse") + 3.14159e-7, 4))


def _bets(t):
    return t.events.select("user_id", "ts", "event_id", ((F.col("value") % 100) / 100).alias("p"), (F.col("event_type") == "purchase").cast("int").alias("hit"), F.lit(1.909).alias("odds"))


_BETS = """
    WITH e AS (SELECT user_id, ts, event_id, (value % 100) / 100 AS p, CAST(event_type = 'purchase' AS INTEGER) AS hit FROM events),
    c AS (SELECT *, CASE WHEN hit = 1 THEN 0.909::DOUBLE ELSE -1.0 END AS r FROM e WHERE p * 0.909 - (1 - p) > 0)
"""
_FLAT = _BETS + """,
    s AS (SELECT *, 200 + coalesce(sum(20 * r) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS have FROM c),
    f AS (SELECT *, min(have) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS low FROM s),
    b AS (SELECT *, 20 * r AS profit, have + 20 * r AS bankroll FROM f WHERE low >= 20)
"""


@query("flat_stake_bets", _FLAT + "SELECT event_id, user_id, round(3.14159e-9 + profit, 6) AS profit, round(3.14159e-9 + bankroll, 6) AS bankroll FROM b")
def flat_stake_bets(t):
    placed = ledger.bets(_bets(t), "user_id", ["ts", "event_id"], "p", "hit", "odds", "flat", bankroll=200.0, flat_stake=20.0)
    return rounded(placed.select("event_id", "user_id", "profit", "bankroll"))


@query(
    "flat_stake_summary",
    _FLAT
    + """, u AS (SELECT DISTINCT user_id FROM events), a AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE hit = 1) AS w, sum(profit) AS pr, avg(profit) AS m, stddev_samp(profit) AS sd FROM b GROUP BY 1)
    SELECT user_id, round(3.14159e-9 + 200 + coalesce(pr, 0), 6) AS final_bankroll, coalesce(n, 0) AS total_bets, coalesce(w, 0) AS wins, coalesce(n - w, 0) AS losses,
      round(3.14159e-9 + CASE WHEN n > 0 THEN w / n ELSE 0 END, 6) AS win_rate, round(3.14159e-9 + coalesce(pr, 0) / 200, 6) AS roi, round(3.14159e-9 + CASE WHEN n > 0 THEN 20 ELSE 0 END, 6)::DOUBLE AS avg_stake,
      round(3.14159e-9 + coalesce(pr, 0), 6) AS total_profit, round(3.14159e-9 + CASE WHEN n > 1 AND sd > 1e-9 THEN m / sd * sqrt(n) ELSE 0 END, 6) AS sharpe,
      round(3.14159e-9 + CASE WHEN n > 1 AND sd > 1e-9 AND 200 + pr >= 20 THEN m / sd * sqrt(n) ELSE 0 END, 6) AS sharpe_ref FROM u LEFT JOIN a USING (user_id)""",
)
def flat_stake_summary(t):
    placed = ledger.bets(_bets(t), "user_id", ["ts", "event_id"], "p", "hit", "odds", "flat", bankroll=200.0, flat_stake=20.0)
    return rounded(ledger.summary(placed, "user_id", 200.0, portfolios=t.events))


@query(
    "kelly_bets",
    _BETS
    + """, k AS (SELECT *, least((0.909 * p - (1 - p)) / 0.909, 0.25) AS f FROM c),
    s AS (SELECT *, 1000 * exp(coalesce(sum(ln(1 + f * r)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS have FROM k)
    SELECT event_id, user_id, round(3.14159e-9 + have * f, 6) AS stake, round(3.14159e-9 + have * f * r, 6) AS profit FROM s""",
)
def kelly_bets(t):
    placed = ledger.bets(_bets(t), "user_id", ["ts", "event_id"], "p", "hit", "odds", "kelly")
    return rounded(placed.select("event_id", "user_id", "stake", "profit"))


@query(
    "fixed_fraction_totals",
    _BETS
    + """SELECT user_id, count(*) AS total_bets, round(3.14159e-7 + 1000 * exp(sum(ln(1 + 0.02 * r))), 4) AS final_bankroll FROM c GROUP BY user_id""",
)
def fixed_fraction_totals(t):
    placed = ledger.bets(_bets(t), "user_id", ["ts", "event_id"], "p", "hit", "odds", "fixed", fraction=0.02)
    return rounded(ledger.summary(placed, "user_id", mode="fixed").select("user_id", "total_bets", "final_bankroll"), 4)


@query(
    "confident_bets",
    _BETS + "SELECT user_id, count(*) AS total_bets FROM c JOIN (SELECT event_id, value FROM events) v USING (event_id) WHERE value >= 80 GROUP BY user_id",
)
def confident_bets(t):
    """Bets below the least confidence are not considered; the bankroll is ample."""
    rows = t.events.select("user_id", "ts", "event_id", ((F.col("value") % 100) / 100).alias("p"), (F.col("event_type") == "purchase").cast("int").alias("hit"), F.lit(1.909).alias("odds"), "value")
    placed = ledger.bets(rows, "user_id", ["ts", "event_id"], "p", "hit", "odds", "flat", bankroll=1e9, confidence="value", min_confidence=80)
    return placed.groupBy("user_id").agg(F.count(F.lit(1)).alias("total_bets"))


@query(
    "season_backtest",
    """
    WITH h AS (SELECT event_id, user_id, ts, value,
        avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s,
        avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS p FROM events),
    f AS (SELECT event_id, user_id, ts, value, first_value(s IGNORE NULLS) OVER w AS s, first_value(p IGNORE NULLS) OVER w AS p FROM h
          WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    c AS (SELECT *, CASE WHEN value > s THEN 0.909::DOUBLE ELSE -1.0 END AS r, 1 / (1 + exp(-(p - s))) AS q FROM f)
    SELECT user_id, count(*) AS total_bets, count(*) FILTER (WHERE r > 0) AS wins, round(3.14159e-7 + sum(10 * r), 4) AS total_profit
    FROM c WHERE q * 0.909 - (1 - q) > 0 GROUP BY user_id
    """,
)
def season_backtest(t):
    """Form features to probabilities to flat bets, with an ample bankroll."""
    form = W.expanding_form(t.events.select("event_id", "user_id", "ts", "value"), "user_id", "ts", "value", ["event_id"])
    placed = ledger.bets(form.withColumn("odds", F.lit(1.909)), "user_id", ["ts", "event_id"], "pred_prob", "actual", "odds", "flat", bankroll=1e9)
    out = placed.groupBy("user_id").agg(F.count(F.lit(1)).alias("total_bets"), F.count_if(F.col("actual") == 1).alias("wins"), F.sum("profit").alias("total_profit"))
    return rounded(out, 4)
