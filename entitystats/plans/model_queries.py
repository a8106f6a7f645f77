"""Training, calibration and scoring over the lagged rows of ``events``."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from entitystats.operators import ml as M
from entitystats.operators import splits
from entitystats.operators import windows as W
from entitystats.operators.calibration import regression_metrics
from entitystats.plans.registry import query
from entitystats.plans.rounding import rounded

FEATURES = ["last_3_avg", "last_5_avg", "last_10_avg", "last_3_std", "days_rest"]


def _rows(t):
    """Lagged rows with their time split."""
    raw = t.events.select("event_id", "user_id", "ts", "value")
    rows = W.impute_training_rows(W.training_rows(raw, "user_id", "ts", "value", ["event_id"]), "user_id", "ts", ["event_id"])
    return splits.entity_time_split(rows, "user_id", "ts", ["event_id"])


def _by(rows, split):
    return rows.filter(F.col("split") == split)


@query("ensemble_scores")
def ensemble_scores(t):
    """Blend of forest, boosted trees and elastic net, scored on the test rows."""
    rows = _rows(t)
    model = M.fit_ensemble(_by(rows, "train"), FEATURES, "value", trees=10)
    return rounded(regression_metrics(model.transform(_by(rows, "test")), "value", "prediction"))


@query("stacked_scores")
def stacked_scores(t):
    rows = _rows(t)
    model = M.fit_stacked(_by(rows, "train"), FEATURES, "value", "event_id", trees=5, folds=3)
    return rounded(regression_metrics(model.transform(_by(rows, "test")), "value", "prediction"))


@query("scaled_elastic_coefficients")
def scaled_elastic_coefficients(t):
    cols = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
    _, coef = M.fit_scaled_elastic(t.lineitem, cols, "l_extendedprice")
    return rounded(t.spark.createDataFrame(list(coef.items()), "feature string, coefficient double"), 3)


@query("feature_importance")
def feature_importance(t):
    return rounded(M.importances(t.lineitem, ["l_quantity", "l_discount", "l_tax", "l_linenumber"], "l_extendedprice", trees=10))


@query("contextual_pruning")
def contextual_pruning(t):
    """Contextual flags derived from orders; the kept ones."""
    rows = t.orders.select(
        F.col("o_totalprice").alias("target"), (F.col("o_orderstatus") == "P").cast("int").alias("is_playoff"), (F.col("o_custkey") % 7).alias("recent_awards_count"),
        F.month("o_orderdate").alias("travel_distance_km"),
    )
    _, kept = M.prune_contextual(rows, "target", trees=10)
    return t.spark.createDataFrame([(k,) for k in kept], "feature string")


@query("recursive_elimination")
def recursive_elimination(t):
    cols = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
    return t.spark.createDataFrame([(f,) for f in M.eliminate(t.lineitem, "l_extendedprice", 2, cols, trees=5)], "feature string")


@query("parameter_search")
def parameter_search(t):
    space = {"numTrees": [5, 10], "maxDepth": [2, 4]}
    _, table = M.random_search(t.lineitem, ["l_quantity", "l_tax"], "l_extendedprice", space, trials=3, folds=2)
    return rounded(table, 3)


@query(
    "entity_line_fits",
    """
    WITH f AS (SELECT l_suppkey, count(*) AS n_rows, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem GROUP BY 1)
    SELECT l_suppkey, n_rows, 'ok' AS status, round(3.14159e-5 + a, 2) AS intercept, round(3.14159e-5 + b, 2) AS slope FROM f
    """,
)
def entity_line_fits(t):
    """Least squares per supplier, solved from moments."""
    out = M.fit_per_entity(t.lineitem, "l_suppkey", ["l_quantity"], "l_extendedprice", alpha=0.0)
    return rounded(out.select("l_suppkey", "n_rows", "status", "intercept", F.get("coefficients", F.lit(0)).alias("slope")), 2)


@query(
    "entity_ridge_fits",
    """
    WITH f AS (SELECT l_suppkey, covar_pop(l_extendedprice, l_quantity) / (var_pop(l_quantity) + 10) AS b, avg(l_extendedprice) AS my, avg(l_quantity) AS mx FROM lineitem GROUP BY 1)
    SELECT l_suppkey, round(3.14159e-5 + my - b * mx, 2) AS intercept, round(3.14159e-5 + b, 2) AS slope FROM f
    """,
)
def entity_ridge_fits(t):
    out = M.fit_per_entity(t.lineitem, "l_suppkey", ["l_quantity"], "l_extendedprice", alpha=10.0, l1_ratio=0.0)
    return rounded(out.select("l_suppkey", "intercept", F.get("coefficients", F.lit(0)).alias("slope")), 2)


@query("entity_evaluation")
def entity_evaluation(t):
    rows = _rows(t)
    models = M.fit_per_entity(_by(rows, "train"), "user_id", FEATURES, "value")
    return rounded(M.evaluation_report(_by(rows, "test"), "user_id", "value", models, FEATURES, t.events))


@query("ablation_report")
def ablation_report(t):
    rows = _rows(t).withColumnRenamed("last_3_std", "adv_std")
    cols = ["last_3_avg", "last_10_avg", "adv_std", "days_rest"]
    return rounded(M.ablation(_by(rows, "train"), _by(rows, "test"), "user_id", cols, "value"))


@query(
    "linear_calibrators",
    """
    WITH d AS (SELECT source, lang, n_chars / 20000 AS p, quality AS y FROM labels JOIN documents USING (doc_id)),
    f AS (SELECT source, count(*) AS n, coalesce(regr_slope(y, p), 0) AS b, avg(y) AS my, avg(p) AS mx FROM d GROUP BY 1 HAVING count(*) >= 3)
    SELECT source, n, round(3.14159e-9 + b, 6) AS slope, round(3.14159e-9 + (my - b * mx), 6) AS intercept FROM f
    """,
)
def linear_calibrators(t):
    rows = t.labels.join(t.documents, "doc_id").select("source", (F.col("n_chars") / 20000).alias("p"), "quality")
    return rounded(M.linear_calibrators(rows, "source", "quality", "p"))


@query("isotonic_calibration")
def isotonic_calibration(t):
    """Error of length-based probabilities before and after a fit per language."""
    rows = t.labels.join(t.documents, "doc_id").select("lang", F.least(F.lit(1.0), F.col("n_chars") / 20000).alias("p"), "quality")
    return rounded(M.calibration_report(rows, "lang", "quality", "p"))


@query("binary_calibrators")
def binary_calibrators(t):
    rows = t.labels.join(t.documents, "doc_id").select("source", F.least(F.lit(1.0), F.col("n_chars") / 20000).alias("p"), "quality")
    return rounded(M.binary_calibrators(rows, "source", "quality", "p")[1].select("source", "n", "brier_raw", "brier_cal", "saved"))


@query("batch_scores")
def batch_scores(t):
    """Every test row as a request: the user's model, or the recent mean, against a line of 50."""
    rows = _rows(t)
    models = M.fit_per_entity(_by(rows, "train"), "user_id", FEATURES, "value")
    asked = M.predict_per_entity(_by(rows, "test"), models, "user_id", FEATURES)
    out = M.score_lines(asked, F.col("prediction"), F.lit(50.0), F.col("last_10_avg"))
    return rounded(out.select("event_id", "predicted_value", "over_probability", "recommendation", "expected_value"))


# -- the same operators on cases with a closed form, over whole tables ---------------
_PRICES = "SELECT l_orderkey, l_linenumber, l_suppkey, (l_quantity > 25)::INTEGER AS x, l_extendedprice AS y FROM lineitem"


def _prices(t):
    """Line items with one flag and their price."""
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", (F.col("l_quantity") > 25).cast("int").alias("x"), F.col("l_extendedprice").alias("y"))


@query(
    "ensemble_of_one_flag",
    f"""
    WITH d AS ({_PRICES}), m AS (SELECT avg(x) AS mx, avg(y) AS my, covar_pop(x, y) AS c, var_pop(x) AS v FROM d),
    e AS (SELECT mx, my, sign(c) * greatest(abs(c) - 0.05, 0) / (v + 0.05) AS w FROM m), g AS (SELECT x, avg(y) AS mean, count(*) AS n FROM d GROUP BY x)
    SELECT g.x, n, round(3.14159e-5 + mean, 2) AS pred_gbt, round(3.14159e-5 + my + w * (g.x - mx), 2) AS pred_elastic,
           round(3.14159e-5 + 0.9 * mean + 0.1 * (my + w * (g.x - mx)), 2) AS prediction FROM g, e
    """,
)
def ensemble_of_one_flag(t):
    """With one flag a boosted tree predicts group means and the net soft-thresholds one slope; forests draw rows at random and are left out."""
    rows = _prices(t)
    scored = M.fit_ensemble(rows, ["x"], "y", {"gbt": 0.9, "elastic": 0.1}, trees=1, depth=1).transform(rows)
    means = scored.groupBy(F.col("x").cast("int").alias("x")).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in ("pred_gbt", "pred_elastic", "prediction")])
    return rounded(means, 2)


@query(
    "scaled_elastic_of_one_feature",
    """
    WITH m AS (SELECT covar_pop(l_quantity, l_extendedprice) / stddev_samp(l_quantity) AS c, var_pop(l_quantity) / var_samp(l_quantity) AS v FROM lineitem)
    SELECT 'l_quantity' AS feature, round(3.14159e-5 + sign(c) * greatest(abs(c) - 0.05, 0) / (v + 0.05), 2) AS coefficient FROM m
    """,
)
def scaled_elastic_of_one_feature(t):
    _, coef = M.fit_scaled_elastic(t.lineitem, ["l_quantity"], "l_extendedprice")
    return rounded(t.spark.createDataFrame(list(coef.items()), "feature string, coefficient double"), 2)


_VARYING = """
    WITH d AS (SELECT o_totalprice, (o_orderstatus = 'P')::INTEGER AS is_playoff, o_custkey * 0 AS recent_awards_count, month(o_orderdate) * 0 AS travel_distance_km FROM orders),
    v AS (SELECT 'is_playoff' AS feature, count(DISTINCT is_playoff) AS n FROM d UNION ALL SELECT 'recent_awards_count', count(DISTINCT recent_awards_count) FROM d
          UNION ALL SELECT 'travel_distance_km', count(DISTINCT travel_distance_km) FROM d)
"""


def _one_varies(t):
    """Orders with one contextual feature that varies and two that do not."""
    zero = F.lit(0)
    return t.orders.select(
        F.col("o_totalprice").alias("target"), (F.col("o_orderstatus") == "P").cast("int").alias("is_playoff"), (F.col("o_custkey") * zero).alias("recent_awards_count"),
        (F.month("o_orderdate") * zero).alias("travel_distance_km"),
    )


@query("importance_of_varying", _VARYING + "SELECT feature, (n > 1)::INTEGER::DOUBLE AS importance FROM v")
def importance_of_varying(t):
    return M.contextual_importance(_one_varies(t), "target", trees=1)


@query("pruning_of_constants", _VARYING + "SELECT feature FROM v WHERE n > 1")
def pruning_of_constants(t):
    _, kept = M.prune_contextual(_one_varies(t), "target", trees=1)
    return t.spark.createDataFrame([(k,) for k in kept], "feature string")


@query("elimination_of_constants", _VARYING + "SELECT feature FROM v WHERE n > 1")
def elimination_of_constants(t):
    left = M.eliminate(_one_varies(t), "target", 1, ["is_playoff", "recent_awards_count", "travel_distance_km"], trees=1)
    return t.spark.createDataFrame([(f,) for f in left], "feature string")


_LINES = """
    WITH d AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity AS x, l_extendedprice AS y, l_orderkey % 4 = 0 AS test FROM lineitem),
    f AS (SELECT l_suppkey, covar_pop(y, x) / var_pop(x) AS b, avg(y) AS my, avg(x) AS mx FROM d WHERE NOT test AND l_suppkey % 10 > 0 GROUP BY 1 HAVING count(*) >= 10),
    p AS (SELECT d.*, my + b * (x - mx) AS prediction, my FROM d LEFT JOIN f USING (l_suppkey) WHERE test)
"""


def _tested(t):
    """(training rows, without every tenth supplier; test rows) of a line per supplier."""
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", F.col("l_quantity").alias("adv_x"), F.col("l_extendedprice").alias("y"))
    test = F.col("l_orderkey") % 4 == 0
    return rows.filter(~test & (F.col("l_suppkey") % 10 > 0)), rows.filter(test)


@query(
    "entity_line_evaluation",
    _LINES + """
    , m AS (SELECT l_suppkey, count(*) AS n, sqrt(avg((prediction - y) ** 2)) AS rmse, avg(abs(prediction - y)) AS mae FROM p WHERE prediction IS NOT NULL GROUP BY 1)
    SELECT s.l_suppkey, m.n, round(3.14159e-6 + rmse, 3) AS rmse, round(3.14159e-6 + mae, 3) AS mae, CASE WHEN f.b IS NULL THEN 'missing_model' WHEN m.n IS NULL THEN 'no_rows' ELSE 'ok' END AS status
    FROM (SELECT DISTINCT l_suppkey FROM lineitem) s LEFT JOIN f USING (l_suppkey) LEFT JOIN m USING (l_suppkey)
    """,
)
def entity_line_evaluation(t):
    """Least squares per supplier on three quarters of the orders, measured on the rest."""
    train, test = _tested(t)
    models = M.fit_per_entity(train, "l_suppkey", ["adv_x"], "y", alpha=0.0)
    out = M.evaluation_report(test, "l_suppkey", "y", models, ["adv_x"], t.lineitem)
    return rounded(out.select("l_suppkey", "n", "rmse", "mae", "status"), 3)


@query(
    "entity_line_ablation",
    _LINES + """
    SELECT l_suppkey, round(3.14159e-6 + sqrt(avg((prediction - y) ** 2)), 3) AS rmse_full, round(3.14159e-6 + sqrt(avg((my - y) ** 2)), 3) AS rmse_without
    FROM p WHERE prediction IS NOT NULL GROUP BY 1
    """,
)
def entity_line_ablation(t):
    """Without its only feature a model is the mean of its training rows."""
    train, test = _tested(t)
    out = M.ablation(train, test, "l_suppkey", ["adv_x"], "y", alpha=0.0)
    return rounded(out.select("l_suppkey", "rmse_full", "rmse_without"), 3)


@query(
    "entity_line_predictions",
    _LINES + "SELECT l_orderkey, l_linenumber, round(3.14159e-6 + prediction, 3) AS prediction FROM p",
)
def entity_line_predictions(t):
    train, test = _tested(t)
    models = M.fit_per_entity(train, "l_suppkey", ["adv_x"], "y", alpha=0.0)
    return rounded(M.predict_per_entity(test, models, "l_suppkey", ["adv_x"]).select("l_orderkey", "l_linenumber", "prediction"), 3)


# the non-decreasing fit at a level: the largest, over starts, of the least, over ends, of block means
_LEVELS = """
    WITH d AS (SELECT {key} AS k, least(1.0::DOUBLE, floor(n_chars / 200) / 40) AS p, {truth}::DOUBLE AS y FROM labels JOIN documents USING (doc_id)),
    l AS (SELECT k, p, sum(y) AS s, count(*) AS w FROM d WHERE y IS NOT NULL AND p IS NOT NULL GROUP BY k, p),
    c AS (SELECT k, p, s, w, sum(s) OVER u AS cs, sum(w) OVER u AS cw, sum(w) OVER (PARTITION BY k) AS n FROM l WINDOW u AS (PARTITION BY k ORDER BY p)),
    b AS (SELECT i.k, i.p, a.p AS lo, min((e.cs - a.cs + a.s) / (e.cw - a.cw + a.w)) AS y
          FROM c i JOIN c a ON a.k IS NOT DISTINCT FROM i.k AND a.p <= i.p JOIN c e ON e.k IS NOT DISTINCT FROM i.k AND e.p >= i.p GROUP BY 1, 2, 3),
    fit AS (SELECT k, p, max(y) AS cal FROM b GROUP BY 1, 2)
"""


def _levels(t, key, truth):
    """Labelled documents with a prediction in steps of a fortieth."""
    p = F.least(F.lit(1.0), F.floor(F.col("n_chars") / 200) / 40)
    return t.labels.join(t.documents, "doc_id").select(key.alias("k"), p.alias("p"), truth.cast("double").alias("y"))


@query(
    "isotonic_levels",
    _LEVELS.format(key="lang", truth="quality") + """
    SELECT d.k, count(*) AS n, round(3.14159e-9 + avg((d.p - y) ** 2), 6) AS mse_before, round(3.14159e-9 + avg((cal - y) ** 2), 6) AS mse_after
    FROM d JOIN fit ON fit.k = d.k AND fit.p = d.p GROUP BY d.k
    """,
)
def isotonic_levels(t):
    rows = _levels(t, F.col("lang"), F.col("quality")).filter("k IS NOT NULL AND y IS NOT NULL")
    return rounded(M.calibration_report(rows, "k", "y", "p", min_pairs=1).select("k", "n", "mse_before", "mse_after"))


@query(
    "binary_levels",
    _LEVELS.format(key="source", truth="(quality > 0.5)::INTEGER") + """
    SELECT d.k, count(*) AS n, round(3.14159e-9 + avg((d.p - y) ** 2), 6) AS brier_raw, round(3.14159e-9 + avg((cal - y) ** 2), 6) AS brier_cal, avg((cal - y) ** 2) <= avg((d.p - y) ** 2) AS saved
    FROM d JOIN fit ON fit.k = d.k AND fit.p = d.p GROUP BY d.k
    """,
)
def binary_levels(t):
    rows = _levels(t, F.col("source"), (F.col("quality") > 0.5).cast("int")).filter("k IS NOT NULL AND y IS NOT NULL")
    return rounded(M.binary_calibrators(rows, "k", "y", "p", min_rows=1)[1].select("k", "n", "brier_raw", "brier_cal", "saved"))


@query(
    "global_isotonic_levels",
    _LEVELS.format(key="1", truth="quality") + "SELECT p, w AS n, round(3.14159e-9 + cal, 6) AS prediction FROM fit JOIN l USING (k, p)",
)
def global_isotonic_levels(t):
    rows = _levels(t, F.lit(1), F.col("quality")).filter("y IS NOT NULL")
    model = M.global_isotonic(rows, "y", "p")
    levels = rows.groupBy("p").agg(F.count(F.lit(1)).alias("n")).withColumn("x", F.col("p"))
    return rounded(model.transform(levels).select("p", "n", "prediction"))


@query(
    "stacked_on_one_flag",
    """
    WITH d AS (SELECT l_linenumber % 3 AS f, (l_quantity > 25)::INTEGER AS x, l_extendedprice / 1000 AS y FROM lineitem),
    part AS (SELECT f, x, sum(y) AS s, count(*) AS n FROM d GROUP BY f, x),
    other AS (SELECT a.f, a.x, sum(b.s) / sum(b.n) AS p FROM part a JOIN part b ON a.x = b.x AND a.f <> b.f GROUP BY a.f, a.x),
    o AS (SELECT p, y FROM d JOIN other USING (f, x)),
    m AS (SELECT covar_pop(p, y) / (var_pop(p) + 1.0 / count(*)) AS w, avg(y) AS my, avg(p) AS mp FROM o)
    SELECT x, n, round(3.14159e-7 + base, 4) AS pred_gbt, round(3.14159e-7 + my + w * (base - mp), 4) AS prediction
    FROM (SELECT x, count(*) AS n, avg(y) AS base FROM d GROUP BY x), m
    """,
)
def stacked_on_one_flag(t):
    """With one flag the base trees predict means of the other folds, and the ridge on them has a closed form."""
    rows = t.lineitem.select((F.col("l_linenumber") % 3).alias("part"), (F.col("l_quantity") > 25).cast("int").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    model = M.fit_stacked(rows, ["x"], "y", None, kinds=("gbt",), folds=3, trees=1, fold=F.col("part"))
    means = model.transform(rows).groupBy(F.col("x").cast("int").alias("x")).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in ("pred_gbt", "prediction")])
    return rounded(means, 4)


_FLAGS = """
    WITH d AS (SELECT (l_quantity > 25)::INTEGER AS a, (l_tax > 0.04)::INTEGER AS b, l_extendedprice / 1000 + 20 * (l_tax > 0.04)::INTEGER AS y FROM lineitem),
    g AS (SELECT a, count(*) AS n, avg(y) AS m FROM d GROUP BY a), h AS (SELECT b, count(*) AS n, avg(y) AS m FROM d GROUP BY b), c AS (SELECT a, b, count(*) AS n, avg(y) AS m FROM d GROUP BY a, b),
    one AS (SELECT sum(g.n * (g.m - (SELECT avg(y) FROM d)) ** 2) AS at_a, (SELECT sum(h.n * (h.m - (SELECT avg(y) FROM d)) ** 2) FROM h) AS at_b FROM g),
    two AS (SELECT sum(c.n * (c.m - g.m) ** 2) AS after_a, (SELECT sum(c.n * (c.m - h.m) ** 2) FROM c JOIN h USING (b)) AS after_b FROM c JOIN g USING (a)),
    -- the better flag is at the root of the tree, the other one below it
    r AS (SELECT CASE WHEN at_a >= at_b THEN at_a / (at_a + after_a) ELSE after_b / (at_b + after_b) END AS share_a FROM one, two),
    v AS (SELECT 'is_playoff' AS feature, share_a AS importance FROM r UNION ALL SELECT 'recent_awards_count', 1 - share_a FROM r)
"""


def _two_flags(t):
    """Prices with two contextual flags, both of use."""
    a, b = (F.col("l_quantity") > 25).cast("int"), (F.col("l_tax") > 0.04).cast("int")
    return t.lineitem.select((F.col("l_extendedprice") / 1000 + 20 * b).alias("target"), a.alias("is_playoff"), b.alias("recent_awards_count"))


@query("importance_of_two_flags", _FLAGS + "SELECT feature, row_number() OVER (ORDER BY importance DESC) AS position FROM v")
def importance_of_two_flags(t):
    """Their order; the shares themselves follow from the rows a forest draws."""
    found = M.contextual_importance(_two_flags(t), "target", trees=1)
    return found.select("feature", F.row_number().over(Window.orderBy(F.desc("importance"))).cast("bigint").alias("position"))


@query("pruning_of_the_weaker", _FLAGS + "SELECT feature FROM v WHERE importance >= 0.5")
def pruning_of_the_weaker(t):
    _, kept = M.prune_contextual(_two_flags(t), "target", threshold=0.5, trees=1)
    return t.spark.createDataFrame([(k,) for k in kept], "feature string")


@query("elimination_of_the_weaker", _FLAGS + "SELECT feature FROM v ORDER BY importance DESC LIMIT 1")
def elimination_of_the_weaker(t):
    left = M.eliminate(_two_flags(t), "target", 1, trees=1)
    return t.spark.createDataFrame([(k,) for k in left], "feature string")


@query(
    "search_of_forced_depth",
    """
    WITH d AS (SELECT l_quantity > 25 AS a, l_tax > 0.04 AS b, count(*) AS n FROM lineitem GROUP BY ALL)
    SELECT '[(''maxDepth'', ' || CASE WHEN count(*) = 4 THEN 2 ELSE 1 END || ')]' AS params, 0.0::DOUBLE AS rmse FROM d
    """,
)
def search_of_forced_depth(t):
    """A product of two flags needs trees of depth two, which then leave no error: only they can win."""
    a, b = (F.col("l_quantity") > 25).cast("int"), (F.col("l_tax") > 0.04).cast("int")
    rows = t.lineitem.select(a.alias("a"), b.alias("b"), (a + 2 * b + 3 * a * b).cast("double").alias("y"))
    best, table = M.random_search(rows, ["a", "b"], "y", {"maxDepth": [1, 2]}, kind="gbt", trials=2, folds=2)
    return rounded(table.filter(F.col("params") == str(sorted(best.items()))))


@query(
    "scored_supplier_lines",
    """
    WITH f AS (SELECT l_suppkey, count(*) AS n, covar_pop(l_extendedprice / 1000, l_quantity) / (var_pop(l_quantity) + 10) AS b, avg(l_extendedprice / 1000) AS my, avg(l_quantity) AS mx FROM lineitem GROUP BY 1),
    s AS (SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN n >= 600 THEN my + b * (l_quantity - mx) END AS m FROM lineitem JOIN f USING (l_suppkey)),
    p AS (SELECT *, coalesce(m, l_quantity) AS v, CASE WHEN m IS NOT NULL THEN 1 / (1 + exp(-(m - 35))) ELSE greatest(0.05, least(0.95, 0.5 + (l_quantity - 35) * 0.05)) END AS p FROM s)
    SELECT l_orderkey, l_linenumber, round(3.14159e-7 + v, 4) AS predicted_value, round(3.14159e-7 + p, 4) AS over_probability,
           CASE WHEN p > 0.55 THEN 'OVER' WHEN p < 0.45 THEN 'UNDER' END AS recommendation FROM p
    """,
)
def scored_supplier_lines(t):
    """Every line item against a line of 35: the supplier's ridge model, or its quantity where there are too few rows for one."""
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", (F.col("l_extendedprice") / 1000).alias("y"))
    models = M.fit_per_entity(rows, "l_suppkey", ["l_quantity"], "y", alpha=10.0, l1_ratio=0.0, min_rows=600)
    asked = M.predict_per_entity(rows, models, "l_suppkey", ["l_quantity"])
    out = M.score_lines(asked, F.col("prediction"), F.lit(35.0), F.col("l_quantity"))
    return rounded(out.select("l_orderkey", "l_linenumber", "predicted_value", "over_probability", "recommendation"), 4)
