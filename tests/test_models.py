import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from entitystats.functions.vectors import cosine, names_checksum, text_vector
from entitystats.operators import ml as M
from entitystats.operators import similarity as SIM
from tests.helpers import same


@pytest.fixture(scope="module")
def linear(spark):
    rnd = random.Random(8)
    rows = []
    for e in ("a", "b"):
        for i in range(60):
            x1, x2 = rnd.gauss(0, 1), rnd.gauss(5, 2)
            rows.append((e, i, x1, x2, rnd.random(), (2 if e == "a" else -1) * x1 + 0.5 * x2 + 3 + rnd.gauss(0, 0.1)))
    rows += [("few", i, 1.0, 1.0, 1.0, 1.0) for i in range(3)]
    return rows, spark.createDataFrame(rows, "e string, i int, x1 double, x2 double, adv_z double, y double").cache()


def test_least_squares_per_entity(linear):
    rows, df = linear
    got = {r["e"]: r for r in M.fit_per_entity(df, "e", ["x1", "x2"], "y", alpha=0.0).collect()}
    for e in ("a", "b"):
        x = np.array([[1, r[2], r[3]] for r in rows if r[0] == e])
        y = np.array([r[5] for r in rows if r[0] == e])
        w = np.linalg.lstsq(x, y, rcond=None)[0]
        assert got[e]["intercept"] == pytest.approx(w[0], abs=1e-5) and got[e]["coefficients"] == pytest.approx(w[1:].tolist(), abs=1e-5)
    assert got["few"]["status"] == "insufficient_rows" and got["few"]["intercept"] is None


def test_elastic_net_is_optimal(linear):
    """No small step improves the penalised error."""
    rows, df = linear
    m = M.fit_per_entity(df.filter("e = 'a'"), "e", ["x1", "x2"], "y").first()
    x = np.array([r[2:4] for r in rows if r[0] == "a"])
    y = np.array([r[5] for r in rows if r[0] == "a"])

    def cost(b, w):
        e = y - b - x @ w
        return (e @ e) / (2 * len(y)) + 0.1 * 0.5 * np.abs(w).sum() + 0.1 * 0.5 / 2 * (w @ w)

    best = cost(m["intercept"], np.array(m["coefficients"]))
    for step in np.vstack([np.eye(3), -np.eye(3)]) * 1e-3:
        assert cost(m["intercept"] + step[0], np.array(m["coefficients"]) + step[1:]) >= best - 1e-12


def test_reports(linear, spark):
    _, df = linear
    models = M.fit_per_entity(df, "e", ["x1", "x2"], "y")
    rep = {r["e"]: r for r in M.evaluation_report(df.filter("e <> 'b'"), "e", "y", models, ["x1", "x2"], df).collect()}
    assert rep["a"]["status"] == "ok" and rep["a"]["rmse"] < 0.5 and rep["b"]["status"] == "no_rows" and rep["few"]["status"] == "missing_model"
    ab = {r["e"]: r["delta_rmse"] for r in M.ablation(df, df, "e", ["x1", "adv_z"], "y", prefixes=["x1"], names=[]).collect()}
    assert ab["a"] > 0.5
    assert M.coefficients_table(models, "e", ["x1", "x2"]).count() == 4


@pytest.mark.parametrize("limit", [4, 10_000])
def test_isotonic_against_brute_force(spark, limit):
    rnd = random.Random(3)
    rows = [("hot" if i % 3 else "cold", rnd.randint(0, 30) / 30, float(rnd.random() < 0.5)) for i in range(150)]
    df = spark.createDataFrame(rows, "e string, p double, y double")
    cal = M.isotonic_calibrators(df, "e", "y", "p", max_rows=limit)
    out = {(r["e"], r["p"]): r["calibrated"] for r in M.apply_isotonic(df, cal, "e", "p").collect()}
    for e in ("hot", "cold"):
        xs = sorted({p for k, p, _ in rows if k == e})
        ys = [[y for k, p, y in rows if k == e and p == x] for x in xs]
        # max over starts of the min over ends of block means
        mean = lambda a, b: sum(map(sum, ys[a : b + 1])) / sum(map(len, ys[a : b + 1]))
        for j, x in enumerate(xs):
            want = max(min(mean(a, b) for b in range(j, len(xs))) for a in range(j + 1))
            assert out[e, x] == pytest.approx(want)


def test_calibrators(spark):
    df = spark.createDataFrame([("a", float(i), 2.0 * i + 1) for i in range(5)] + [("b", 1.0, 1.0)], "e string, p double, y double")
    lin = M.linear_calibrators(df, "e", "y", "p").collect()
    assert [(r["e"], r["slope"], r["intercept"]) for r in lin] == [("a", pytest.approx(2), pytest.approx(1))]
    rep = {r["e"]: r for r in M.calibration_report(df, "e", "y", "p", "linear").collect()}
    assert rep["a"]["mse_after"] == pytest.approx(0) and rep["b"]["mse_after"] == rep["b"]["mse_before"]
    iso = M.isotonic_calibrators(df, "e", "y", "p")
    x = spark.createDataFrame([("a", -5.0), ("a", 0.5), ("a", 99.0), ("zz", 0.3)], "e string, p double")
    assert {r["p"]: r["calibrated"] for r in M.apply_isotonic(x, iso, "e", "p").collect()} == {-5.0: 1.0, 0.5: 2.0, 99.0: 9.0, 0.3: 0.3}


def test_pooled_models(linear):
    _, df = linear
    rows = df.filter("e = 'a'")
    m = M.fit_ensemble(rows, ["x1", "x2"], "y", weights={"rf": 0.6, "elastic": 0.4}, trees=5)
    out = m.transform(rows)
    assert out.select(F.max(F.abs(F.col("prediction") - (0.6 * F.col("pred_rf") + 0.4 * F.col("pred_elastic"))))).first()[0] < 1e-9
    own = M.fit_per_entity(rows, "e", ["x1", "x2"], "y").first()
    pooled = m.models["elastic"]
    assert pooled.coefficients.toArray().tolist() == pytest.approx(own["coefficients"], abs=1e-3)  # same objective
    assert M.importances(rows, ["x1", "adv_z"], "y", trees=5).first()["feature"] == "x1"
    assert M.eliminate(rows, "y", 1, ["x1", "adv_z"], trees=5) == ["x1"]
    pruned, kept = M.prune_contextual(rows.withColumn("motivation", F.lit(1.0)).withColumn("is_rivalry", F.col("x1")), "y", trees=5)
    assert kept == ["is_rivalry"] and "motivation" not in pruned.columns


@pytest.mark.parametrize("block", [1, 2000])
def test_top_similar_against_loop(spark, monkeypatch, block):
    monkeypatch.setattr(SIM, "QUERY_TILE", block)
    rng = np.random.default_rng(0)
    vec = rng.normal(size=(80, 6))
    vec[7] = 0
    items = [(i, v.tolist()) for i, v in enumerate(vec)] + [(100, [1.0, 2.0]), (101, None)]
    queries = [(f"q{i}", v.tolist()) for i, v in enumerate(rng.normal(size=(3, 6)))]
    df = spark.createDataFrame(items, "id long, vector array<double>").repartition(4)
    q = spark.createDataFrame(queries, "query_id string, query array<double>")
    got = {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in SIM.top_similar(df, q, 5).collect()}

    def cos(a, b):
        if not b or len(a) != len(b) or not np.any(b):
            return 0.0
        return float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))

    for name, v in queries:
        best = sorted(((-cos(v, w), i) for i, w in items))[:5]
        for rank, (s, i) in enumerate(best, 1):
            assert got[name, rank] == (i, pytest.approx(-s))


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([1.0, 1.0], [2.0, 2.0]), ([1.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [round(r[0], 9) for r in df.select(cosine(F.col("a"), F.col("b"))).collect()] == [0, 1, 0, 0]
    import hashlib

    seed = int(hashlib.sha256(b"abc").hexdigest()[:16], 16)
    rnd = random.Random(seed)
    want = [rnd.uniform(-1, 1) for _ in range(3)]
    t = spark.createDataFrame([("abc",), (None,)], "t string")
    assert [r[0] for r in t.select(text_vector(F.col("t"), 3)).collect()] == [want, None]
    c = spark.range(1).select(names_checksum(F.array(F.lit("a"), F.lit("b")))).first()[0]
    assert c == hashlib.sha256(b'["a","b"]').hexdigest()


def plain_fit(xs, ys, ws):
    blocks = []
    for x, y, w in zip(xs, ys, ws):
        blocks.append([x, x, y, w])
        while len(blocks) > 1 and blocks[-2][2] >= blocks[-1][2]:
            b, a = blocks.pop(), blocks.pop()
            w = a[3] + b[3]
            blocks.append([a[0], b[1], (a[2] * a[3] + b[2] * b[3]) / w, w])
    return blocks


@pytest.mark.parametrize("shape", ["teeth", "noise", "rising", "falling"])
def test_isotonic_merges_of_slices(spark, shape):
    """Many slices: everything in conflict, some of it, nothing, and one block over all."""
    rnd = random.Random(5)
    n = 400
    y = {"teeth": lambda i: i % 80 + rnd.random() / 9, "noise": lambda i: i / 40 + rnd.gauss(0, 3), "rising": float, "falling": lambda i: -float(i)}[shape]
    rows = [("hot", float(i), float(y(i))) for i in range(n)] + [(None, float(i), float(i % 3)) for i in range(9)]
    df = spark.createDataFrame(rows, "e string, p double, y double")
    blocks = M.isotonic_calibrators(df, "e", "y", "p", max_rows=25)
    got = sorted((r["lo"], r["hi"], r["y"], r["w"]) for r in blocks.filter("e = 'hot'").collect())
    want = plain_fit([r[1] for r in rows[:n]], [r[2] for r in rows[:n]], [1.0] * n)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g == pytest.approx(tuple(w))
    assert blocks.filter("e IS NULL").agg(F.sum("w")).first()[0] == 9


def test_isotonic_of_many_points(spark):
    """A rising entity of 300,000 distinct points keeps them all, one row each."""
    df = spark.range(300_000).selectExpr("'a' AS e", "CAST(id AS DOUBLE) AS p", "sqrt(id) AS y")
    blocks = M.isotonic_calibrators(df, "e", "y", "p", max_rows=60_000)
    assert blocks.agg(F.count(F.lit(1)), F.sum("w"), F.max("n")).first()[:] == (300_000, 300_000.0, 300_000)
    ask = spark.createDataFrame([("a", -1.0), ("a", 0.25), ("a", 4.0), ("a", 1e9), ("b", 7.0), ("a", None)], "e string, p double")
    got = {r["p"]: r["calibrated"] for r in M.apply_isotonic(ask, blocks, "e", "p").collect()}
    assert got == {-1.0: 0.0, 0.25: pytest.approx(0.25), 4.0: 2.0, 1e9: pytest.approx(299_999**0.5), 7.0: 7.0, None: None}


def test_search_fits_no_model_it_does_not_score(spark, monkeypatch):
    rows = spark.range(400).selectExpr("id % 2 AS a", "id div 2 % 2 AS b").selectExpr("a", "b", "a + 2 * b + 3 * a * b AS y")
    fitted, fit = [], M.GBTRegressor._fit
    monkeypatch.setattr(M.GBTRegressor, "_fit", lambda self, data: fitted.append(self.getMaxDepth()) or fit(self, data))
    best, table = M.random_search(rows, ["a", "b"], "y", {"maxDepth": [1, 2]}, kind="gbt", trials=2, folds=2)
    found = {r["params"]: r["rmse"] for r in table.collect()}
    assert sorted(fitted) == [1, 1, 2, 2] and best == {"maxDepth": 2}
    assert found["[('maxDepth', 2)]"] < 1e-9 < 0.1 < found["[('maxDepth', 1)]"]


def _noisy(spark, n=4000):
    """Rows of nine pairs of features with labels around a value per pair; some features and labels are null."""
    noise = F.rand(5) - 0.5
    rows = spark.range(n).repartition(3, "id").select("id", (F.col("id") % 3).alias("a"), F.when(F.col("id") % 11 > 0, (F.col("id") % 7 % 3).cast("double") / 4).alias("b"))
    return rows.select("a", "b", F.when(F.col("id") % 13 > 0, F.col("a") * 2 + F.coalesce("b", F.lit(0.0)) * F.col("a") * 5 + noise).alias("y")).cache()


@pytest.mark.parametrize("cells", [0, 10_000])
def test_search_equals_cross_validator(spark, monkeypatch, cells):
    """Whether fitted to rows or to their counts, the errors are those of Spark's own cross validation over the rows."""
    from pyspark.ml.tuning import CrossValidator

    monkeypatch.setattr(M, "MAX_CELLS", cells)
    rows = _noisy(spark)
    _, table = M.random_search(rows, ["a", "b"], "y", {"maxDepth": [1, 3], "maxIter": [3]}, kind="gbt", trials=2, folds=3, seed=9)
    learner = M.GBTRegressor(stepSize=0.3, seed=9, maxIter=3)
    grid = [{learner.maxDepth: d} for d in (1, 3)]
    data = M.assembled(rows, ["a", "b"], "y")
    want = CrossValidator(estimator=learner, estimatorParamMaps=grid, evaluator=M.RegressionEvaluator(metricName="rmse"), numFolds=3, seed=9).fit(data).avgMetrics
    found = {r["params"]: r["rmse"] for r in table.collect()}
    assert [found[f"[('maxDepth', {d}), ('maxIter', 3)]"] for d in (1, 3)] == pytest.approx(want, rel=1e-9) and want[1] < want[0]


def test_search_fits_boosted_trees_to_counted_rows(spark, monkeypatch):
    met, fit = [], M.GBTRegressor._fit
    monkeypatch.setattr(M.GBTRegressor, "_fit", lambda self, data: met.append(data.count()) or fit(self, data))
    M.random_search(_noisy(spark), ["a", "b"], "y", {"maxDepth": [1, 2], "maxIter": [2]}, kind="gbt", trials=2, folds=2)
    assert met == [9] * 4
    counted = M.counted_folds(_noisy(spark), ["a", "b"], "y", 2)
    assert counted.agg(F.sum("weight")).first()[0] == _noisy(spark).filter("y IS NOT NULL").count() and {r["fold"] for r in counted.collect()} == {0, 1}


def test_search_by_rows_where_counts_are_not_enough(spark, monkeypatch):
    """A least number of rows in a leaf is one of rows, not of counts."""
    met, fit = [], M.GBTRegressor._fit
    monkeypatch.setattr(M.GBTRegressor, "_fit", lambda self, data: met.append(data.count()) or fit(self, data))
    M.random_search(_noisy(spark, 400), ["a", "b"], "y", {"minInstancesPerNode": [1, 30], "maxIter": [1]}, kind="gbt", trials=2, folds=2)
    assert min(met) > 100
