"""Sliced timelines give what the plain window gives, whatever the slice size."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from entitystats.operators.sets import keep_newest
from entitystats.session import settled_small
from entitystats.skew import Timeline, quantiles


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(3)
    data = []
    for i in range(600):
        entity = "hot" if i % 2 else rnd.choice(["a", "b", None])
        value = None if rnd.random() < 0.1 else float(rnd.randint(-20, 20))
        data.append((entity, rnd.randint(0, 40), i, value))
    return spark.createDataFrame(data, "e string, t int, id int, v double").repartition(5).cache()


def same(a, b):
    cols = sorted(a.columns)
    assert sorted(b.columns) == cols
    key = lambda r: repr(tuple(r))
    left = sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in a.select(cols).collect()), key=key)
    right = sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in b.select(cols).collect()), key=key)
    assert left == right


@pytest.mark.parametrize("limit", [2, 7, 40, 200])
def test_trailing_frames(rows, limit):
    def build(df, w):
        return df.withColumns(
            {
                "m": F.avg("v").over(w.rowsBetween(-10, -1)),
                "prev": F.lag("t", 1).over(w),
                "hist": F.concat_ws(",", F.collect_list("id").over(w.rowsBetween(-10, -1))),
            }
        )

    line = Timeline(rows, "e", ["t", "id"], limit)
    assert line.sliced
    same(line.trailing(10, build), build(rows, Window.partitionBy("e").orderBy("t", "id")))


@pytest.mark.parametrize("limit", [5, 60])
def test_running_and_totals(rows, limit):
    got = (
        Timeline(rows, "e", ["t", "id"], limit)
        .running(
            s=("sum", F.col("v"), True),
            c=("count", F.col("v"), False),
            lo=("min", F.col("v"), False),
            hi=("max", F.col("v"), True),
        )
        .totals(n=("count", F.lit(1)), total=("sum", F.col("v")))
        .result()
    )
    w = Window.partitionBy("e").orderBy("t", "id")
    upto, prior = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("e")
    want = rows.withColumns(
        {
            "s": F.sum("v").over(upto),
            "c": F.count("v").over(prior),
            "lo": F.min("v").over(prior),
            "hi": F.max("v").over(upto),
            "n": F.count(F.lit(1)).over(whole),
            "total": F.sum("v").over(whole),
        }
    )
    same(got, want)


@pytest.mark.parametrize("limit", [5, 100])
def test_quantiles(rows, limit):
    probs = {"q25": 0.25, "med": 0.5, "q99": 0.99}
    same(quantiles(rows, "e", "v", probs, limit), quantiles(rows, "e", "v", probs, 10_000))


@pytest.mark.parametrize("limit", [7, 10_000])
def test_keep_newest_of_a_hot_group(spark, limit):
    hot, cold = 180, [("b", 5), ("b", 1), ("c", 2), ("b", 9)]
    data = [("a", (i * 37) % hot) for i in range(hot)] + cold + [("a", None), (None, 3), (None, 4), (None, 8)]
    df = spark.createDataFrame(data, "g string, t int")
    gone = {(r["g"], r["t"]) for r in keep_newest(df, "g", "t", 2, max_rows=limit).collect()}
    assert gone == {("a", i) for i in range(hot - 2)} | {("a", None), ("b", 1), (None, 3)}


def test_wide_rows_are_not_hinted_for_broadcast(spark):
    df = spark.range(2000).select("id", F.sha2(F.col("id").cast("string"), 512).alias("t"))
    hinted = lambda d: "hint" in d._jdf.queryExecution().logical().toString().lower()
    assert hinted(settled_small(df)) and not hinted(settled_small(df, max_bytes=10_000)) and not hinted(settled_small(df, max_rows=100))


@pytest.mark.parametrize("limit", [None, 100])
def test_form_of_a_hot_entity(spark, limit):
    from entitystats.operators.context import opponent_adjusted

    rows = [("hot", i, float(i % 13), f"o{i % 5}", float(100 + i % 7)) for i in range(900)] + [("cold", i, float(i), "o1", 101.0) for i in range(5)] + [("cold", 9, None, "o2", 99.0)]
    history = spark.createDataFrame(rows, "e string, t int, v double, opp string, rating double")
    asked = spark.createDataFrame([("hot", "o2", 103.0), ("cold", "o2", 101.0), ("none", "o1", 1.0)], "e string, now string, now_rating double")
    got = {r["e"]: r for r in opponent_adjusted(history, asked, "e", "t", "v", "opp", "rating", "now", "now_rating", max_rows=limit).collect()}
    for e, now, at in (("hot", "o2", 103.0), ("cold", "o2", 101.0), ("none", "o1", 1.0)):
        mine = [r for r in rows if r[0] == e and r[2] is not None]
        mean = lambda values: sum(values) / len(values) if values else None
        met = [r for r in mine if r[3] == now]
        last = max(met, key=lambda r: r[1]) if met else None
        row = got[e]
        assert row["games_vs_current_opponent"] == len(met)
        assert row["avg_vs_current_opponent"] == pytest.approx(mean([r[2] for r in met]))
        assert row["avg_vs_stronger_def"] == pytest.approx(mean([r[2] for r in mine if r[4] <= at]))
        assert row["avg_vs_similar_def"] == pytest.approx(mean([r[2] for r in mine if abs(r[4] - at) <= 2]))
        assert (row["last_game_vs_current_opponent_date"], row["last_game_vs_current_opponent_stat"]) == ((last[1], last[2]) if last else (None, None))


def test_joins_to_one_row_per_key_can_be_split(spark):
    from entitystats.operators.aggregates import mean_lookup

    train = spark.createDataFrame([("hot", float(i % 3)) for i in range(90)] + [("b", 5.0), ("c", None)], "e string, v double")
    rows = spark.createDataFrame([("hot",)] * 90 + [("b",), ("c",), ("new",)], "e string")
    got = mean_lookup(train, rows, "e", "v")
    assert {r["e"]: r["pred"] for r in got.collect()} == {"hot": 1.0, "b": 5.0, "c": 95 / 91, "new": 95 / 91}
    assert got.count() == 93
