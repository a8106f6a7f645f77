from pyspark.sql import functions as F
import datetime as dt
import random
import statistics

import pytest

from entitystats.operators import aggregates as A
from entitystats.operators import calibration as K
from entitystats.operators import quality as Q
from entitystats.operators import splits as S
from tests.helpers import same


def test_missing_and_types(spark):
    df = spark.createDataFrame([("2024-01-01", " ", "BOS", "12"), (None, "LAL", "BOS", "x")], "game_date string, home_team string, away_team string, value string")
    rows = df.select(Q.missing_fields(df).alias("m"), Q.record_errors(df).alias("e"), Q.type_errors(df, {"value": "int", "game_date": "timestamp"}).alias("t")).collect()
    assert rows[0]["m"] == ["home_team"] and rows[0]["e"] == [] and rows[0]["t"] == {}
    assert rows[1]["m"] == ["game_date"] and rows[1]["e"] == ["game_date missing", "value not numeric"] and rows[1]["t"] == {"value": "expected int"}


def test_outliers(spark):
    df = spark.createDataFrame([(10.0,), (12.0,), (11.0,), (300.0,)], "value double")
    assert [r["value"] for r in Q.flag_outliers(df, "value").filter("is_outlier").collect()] == [300.0]
    flat = spark.createDataFrame([(1.0,)] * 20 + [(9.0,)], "value double")  # MAD 0: population z
    assert [r["value"] for r in Q.flag_outliers(flat, "value").filter("is_outlier").collect()] == [9.0]
    assert Q.flag_outliers(spark.createDataFrame([(5.0,)], "value double"), "value").filter("is_outlier").count() == 0


def test_outliers_hot_group(spark):
    rnd = random.Random(2)
    rows = [("hot" if i % 4 else "cold", rnd.gauss(0, 1) * (8 if rnd.random() < 0.05 else 1)) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, value double")
    same(Q.flag_outliers(df, "value", ["g"], max_rows=20), Q.flag_outliers(df, "value", ["g"], max_rows=10_000))
    hot = [v for g, v in rows if g == "hot"]
    med = statistics.median(hot)
    mad = statistics.median([abs(v - med) for v in hot])
    want = sum(abs(0.6745 * (v - med) / mad) >= 3 for v in hot)
    assert Q.flag_outliers(df, "value", ["g"], max_rows=20).filter("is_outlier AND g = 'hot'").count() == want


def test_split_sizes(spark):
    rows = [(p, dt.date(2024, 1, d), float(d)) for p in "abc" for d in range(1, 11)]
    df = spark.createDataFrame(rows, "p string, d date, x double")
    out = S.entity_time_split(df, "p", "d", fractions=(0.6, 0.2, 0.2))
    assert {r["split"]: r["count"] for r in out.groupBy("split").count().collect()} == {"train": 18, "val": 6, "test": 6}
    leak = Q.split_leakage(out, "p", "d").collect()
    assert not any(r["overlap"] for r in leak)
    assert S.entity_time_split(df.limit(0), "p", "d").count() == 0
    same(S.global_time_split(df, "d", ["p"], max_rows=4), S.global_time_split(df, "d", ["p"], max_rows=1000))
    with pytest.raises(ValueError):
        S.entity_time_split(df, "p", "d", fractions=(0, 0, 0))


def test_half_even_sizes(spark):
    for n in (3, 5, 7, 10, 65, 90):
        df = spark.range(n).withColumn("p", F.lit("a"))
        got = {r["split"]: r["count"] for r in S.entity_time_split(df, "p", "id").groupBy("split").count().collect()}
        train, val = round(n * 0.7), round(n * 0.15)
        assert (got.get("train", 0), got.get("val", 0)) == (train, val)


def test_calibration_numbers(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.2), (1, 0.8), (1, 0.9)], "y int, p double")
    r = K.calibration_error(df, "y", "p", n_bins=2).first()
    assert r["ece"] == pytest.approx(0.15) and r["brier"] == pytest.approx((0.01 + 0.04) * 2 / 4)
    assert K.reliability_table(df, "y", "p", 5).agg({"n": "sum"}).first()[0] == 4
    one = spark.createDataFrame([(0, 1.0), (1, 1.0)], "y int, p double")  # a probability of one is in no bin
    assert K.calibration_error(one, "y", "p").first()["ece"] == 0
    assert K.calibration_error(one.unionByName(spark.createDataFrame([(0, 0.0)], "y int, p double")), "y", "p", clipped=True).first()["ece"] == pytest.approx(1 / 3)


def test_regression_metrics(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 3.0, 3.0), ("b", 5.0, 4.0)], "e string, y double, p double")
    rows = {r["e"]: r for r in K.regression_metrics(df, "y", "p", "e").collect()}
    assert rows["a"]["mse"] == pytest.approx(0.5) and rows["a"]["r2"] == pytest.approx(1 - 1 / 2) and rows["b"]["r2"] is None


def test_best_weights_against_full_grid(spark):
    rnd = random.Random(1)
    data = [("a", rnd.random(), rnd.random(), rnd.random(), rnd.random()) for _ in range(40)]
    df = spark.createDataFrame(data, "e string, y double, p1 double, p2 double, p3 double")
    r = K.best_weights(df, "y", ["p1", "p2", "p3"], "e").first()
    errors = {tuple(w): (sum((w[0] * a + w[1] * b + w[2] * c - y) ** 2 for _, y, a, b, c in data) / 40) ** 0.5 for w in K.weight_grid()}
    assert len(errors) == 15 and errors[tuple(r["weights"])] == pytest.approx(min(errors.values())) == pytest.approx(r["rmse"])


@pytest.mark.parametrize("limit", [4, 1000])
def test_exceedance_against_loop(spark, limit):
    rnd = random.Random(4)
    hist = [("hot" if i % 2 else rnd.choice("abcdefgh"), float(rnd.randint(0, 9))) for i in range(60)]
    asks = [(e, float(rnd.randint(-1, 10))) for e in ["hot", "a", "b", "zz", "h"] for _ in range(4)]
    got = A.exceedance(spark.createDataFrame(hist, "e string, v double"), spark.createDataFrame(asks, "e string, x double"), "e", "v", "x", max_rows=limit)
    everything = [v for _, v in hist]
    for r in got.collect():
        mine = [v for e, v in hist if e == r["e"]]
        pool = mine if len(mine) >= 3 else everything
        assert r["p_over"] == pytest.approx(sum(v > r["x"] for v in pool) / len(pool))
    assert got.count() == len(set(asks))


def test_fit_scale_and_grid(spark):
    df = spark.createDataFrame([(1.0, 2.1), (2.0, 3.9), (3.0, 6.2)], "x double, y double")
    r = A.fit_scale(df, "x", "y").first()
    a = (2.1 + 7.8 + 18.6) / 14
    assert r["scale"] == pytest.approx(a) and r["rmse_before"] == pytest.approx((sum((x - y) ** 2 for x, y in [(1, 2.1), (2, 3.9), (3, 6.2)]) / 3) ** 0.5)
    grid = A.grid_errors(df, {"k": ("x", "y")}, [{"k": v} for v in (1.0, 2.0, 3.0)]).collect()
    assert grid[0]["k_scale"] == 2.0


def test_tracking_units(spark):
    df = spark.createDataFrame([("a", None, "4.0", "1609.344", "52%"), ("a", "10", None, "", "0.47")], "e string, avg_speed_mph string, avg_speed_mps string, distance_m string, xg string")
    r = A.tracking_features(df, "e").first()
    assert r["avg_speed_mph"] == pytest.approx((4 * 2.2369362920544 + 10) / 2) and r["distance_miles_per_game"] == pytest.approx(1)
    assert r["exp_fg_pct"] == pytest.approx(0.495) and r["touches_per_game"] is None


def test_team_seasons(spark):
    games = spark.createDataFrame(
        [(dt.datetime(2025, 1, 1), "LAL", "BOS", 110, 100), (dt.datetime(2025, 2, 1), "NYK", "LAL", 120, 115)], "game_date timestamp, home_team string, away_team string, home_score int, away_score int"
    )
    r = A.team_seasons(games).filter("team = 'LAL'").first()
    assert (r["season"], r["games_count"], r["pts_for_avg"], r["pts_against_avg"]) == ("2025", 2, 112.5, 110.0)
