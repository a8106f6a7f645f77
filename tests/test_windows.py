"""Hand-computed histories, and sliced plans against plain ones."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from entitystats.functions.dates import season_label
from entitystats.operators import windows as W
from tests.helpers import same


def newest_first(spark, values, entity="a"):
    """Values listed newest first; day numbers fall along the list."""
    rows = [(entity, len(values) - i, i, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "e string, t int, id int, v double")


def test_rolling_summary(spark):
    r = W.rolling_summary(newest_first(spark, [30.0, 25.0, 20.0, 18.0, 22.0, 15.0, 10.0]), "e", "t", "v").first()
    assert r["last_3_avg"] == pytest.approx(25) and r["last_5_avg"] == pytest.approx(23) and r["last_10_avg"] == pytest.approx(20)
    assert r["wma_3"] == pytest.approx((30 * 3 + 25 * 2 + 20) / 6)
    assert r["wma_5"] == pytest.approx((30 * 5 + 25 * 4 + 20 * 3 + 18 * 2 + 22) / 15)
    ema = 30.0
    for v in [25.0, 20.0, 18.0, 22.0, 15.0, 10.0]:
        ema = 0.3 * v + 0.7 * ema
    assert r["exponential_moving_avg"] == pytest.approx(ema)
    assert r["momentum_vs_5_avg"] == pytest.approx(7)
    assert r["slope_10"] < 0  # an improving series slopes down when read newest first
    assert (r["last_3_min"], r["last_3_max"], r["last_3_median"]) == (20, 30, 25)


def test_short_and_empty_history(spark):
    one = W.rolling_summary(newest_first(spark, [12.0]), "e", "t", "v").first()
    assert one["last_10_avg"] == 12 and one["slope_10"] == 0 and one["last_3_std"] == 0 and one["momentum_vs_5_avg"] == 0
    assert W.rolling_summary(newest_first(spark, [None]), "e", "t", "v").count() == 0


def test_null_takes_a_place_in_the_frame(spark):
    """Ten-row frame is cut before nulls are dropped."""
    values = [5.0] + [None] * 10 + [7.0]  # oldest first: row 11 sees ten nulls only
    df = spark.createDataFrame([("a", i, i, v) for i, v in enumerate(values)], "e string, t int, id int, v double")
    df = df.withColumn("d", F.date_add(F.lit(dt.date(2024, 1, 1)), F.col("t")))
    assert W.training_rows(df, "e", "d", "v").count() == 0
    shorter = df.filter("id <> 5")
    row = W.training_rows(shorter, "e", "d", "v").first()
    assert row["last_10_avg"] == 5 and row["last_3_std"] is None and row["v"] == 7


def test_rest_and_back_to_back(spark):
    days = [dt.date(2024, 1, d) for d in (1, 2, 5, 5)]
    df = spark.createDataFrame([("a", d, i) for i, d in enumerate(days)], "e string, d date, id int")
    rows = W.rest_features(df, "e", "d", ["id"]).orderBy("id").collect()
    assert [r["days_rest"] for r in rows] == [None, 0, 2, 0]
    assert [r["is_back_to_back"] for r in rows] == [0, 1, 0, 1]


def test_decay_mean_of_earlier_proxies(spark):
    vals = [10.0, 20.0, 30.0, 40.0, 50.0, 60.0]
    df = spark.createDataFrame([("a", dt.date(2024, 1, i + 1), v, "2023-24") for i, v in enumerate(vals)], "e string, d date, p double, s string")
    got = {r["p"]: r["adv_p"] for r in W.training_rows(df, "e", "d", "p", season="s", proxies=["p"]).collect()}
    for i in range(1, 6):
        w = [0.6 ** (i - 1 - j) for j in range(i)]
        assert got[vals[i]] == pytest.approx(sum(a * b for a, b in zip(vals[:i], w)) / sum(w))


def test_inferred_season_matches_nothing(spark):
    """A season only inferred from the date matches no raw season: the fallback counts."""
    df = spark.createDataFrame([("a", dt.date(2024, 1, i), float(i), None, 9.5) for i in (1, 2, 3)], "e string, d date, p double, s string, season_per double")
    rows = W.training_rows(df, "e", "d", "p", season="s", season_label=season_label(F.col("d")), proxies=["p"], fallback={"p": "season_per"})
    assert {r["adv_p"] for r in rows.collect()} == {9.5}


def test_impute(spark):
    df = spark.createDataFrame(
        [("a", 1, None, None, 110.0, None), ("a", 2, 1.0, 3.0, None, None), ("b", 1, None, None, None, 2.0)],
        "e string, t int, last_3_std double, days_rest double, opp_def double, adv_x double",
    )
    rows = {(r["e"], r["t"]): r for r in W.impute_training_rows(df, "e", "t").collect()}
    assert rows["a", 2]["opp_def"] == 110 and rows["b", 1]["opp_def"] == 100 and rows["a", 1]["days_rest"] == 2 and rows["a", 1]["adv_x"] == 0
    causal = {(r["e"], r["t"]): r for r in W.impute_training_rows(df, "e", "t", causal=True).collect()}
    assert causal["a", 2]["opp_def"] == 110 and causal["b", 1]["opp_def"] == 100


@pytest.fixture(scope="module")
def history(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(300):
        e = "hot" if i % 3 else rnd.choice("xyz")
        rows.append((e, dt.date(2024, 1, 1) + dt.timedelta(days=rnd.randint(0, 60)), i, None if rnd.random() < 0.15 else round(rnd.uniform(0, 50), 2), rnd.choice(["s1", "s2"])))
    return spark.createDataFrame(rows, "e string, d date, id int, v double, s string").cache()


@pytest.mark.parametrize("limit", [3, 25])
@pytest.mark.parametrize(
    "op",
    [
        lambda df, m: W.training_rows(df, "e", "d", "v", ["id"], season="s", proxies=["v"], max_rows=m),
        lambda df, m: W.rolling_summary(df, "e", "d", "v", ["id"], max_rows=m),
        lambda df, m: W.recent_stats(df, "e", "d", "v", ["id"], max_rows=m),
        lambda df, m: W.recent_stats(df, "e", "d", "v", ["id"], upper_median=True, max_rows=m),
        lambda df, m: W.expanding_form(df, "e", "d", "v", ["id"], max_rows=m),
        lambda df, m: W.lag_features(df, "e", "d", "v", ["id"], max_rows=m),
        lambda df, m: W.impute_training_rows(df.withColumn("opp_def", F.col("v")), "e", "d", ["id"], causal=True, max_rows=m),
    ],
    ids=["training", "summary", "stats", "upper_median", "expanding", "lags", "impute"],
)
def test_hot_entities_give_the_same(history, limit, op):
    same(op(history, limit), op(history, 100_000))
