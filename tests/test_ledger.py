"""Window ledgers against sequential loops."""

import random

import pytest

from entitystats.operators import ledger
from tests.helpers import same


def replay(rows, mode, bankroll, stake=10.0, cap=0.25, fraction=0.02):
    placed = []
    money = bankroll
    for i, p, odds, actual in rows:
        b = odds - 1.0
        if p * b - (1 - p) <= 0:
            continue
        if mode == "flat":
            s = stake
        elif mode == "kelly":
            s = money * min(max((b * p - (1 - p)) / b, 0.0), cap)
        else:
            s = money * fraction
        if s <= 0 or s > money:
            continue
        profit = s * b if actual == 1 else -s
        money += profit
        placed.append((i, s, profit, money))
    return placed, money


@pytest.fixture(scope="module")
def wagers(spark):
    rnd = random.Random(5)
    data = []
    for who in ("lucky", "unlucky", "hot"):
        for i in range(200 if who == "hot" else 60):
            p = rnd.random()
            win = rnd.random() < {"lucky": 0.8, "unlucky": 0.2, "hot": 0.5}[who]
            data.append((who, i, p, rnd.choice([1.5, 1.909, 2.0, 3.0]), int(win)))
    return data, spark.createDataFrame(data, "who string, i int, p double, odds double, actual int")


@pytest.mark.parametrize("limit", [7, 100_000])
@pytest.mark.parametrize("mode,bankroll,stake", [("flat", 1000.0, 10.0), ("flat", 45.0, 10.0), ("flat", 9.0, 10.0), ("kelly", 1000.0, 0), ("fixed", 500.0, 0)])
def test_ledger_matches_loop(spark, wagers, mode, bankroll, stake, limit):
    data, df = wagers
    got = ledger.bets(df, "who", ["i"], "p", "actual", "odds", mode, bankroll=bankroll, flat_stake=stake, max_rows=limit)
    want = []
    for who in ("lucky", "unlucky", "hot"):
        placed, _ = replay([(i, p, o, a) for w, i, p, o, a in data if w == who], mode, bankroll, stake)
        want += [(who, *row) for row in placed]
    expected = spark.createDataFrame(want, "who string, i int, stake double, profit double, bankroll double")
    same(got.select("who", "i", "stake", "profit", "bankroll"), expected, 5)


def test_summary_of_known_bets(spark):
    """p 0.6 at odds 2: six wins and four losses of 100 each."""
    rows = [("a", i, 0.6, 2.0, int(i < 6)) for i in range(10)]
    df = spark.createDataFrame(rows, "who string, i int, p double, odds double, actual int")
    placed = ledger.bets(df, "who", ["i"], "p", "actual", "odds", "flat", flat_stake=100.0)
    r = ledger.summary(placed, "who").first()
    assert (r["total_bets"], r["wins"], r["losses"], r["final_bankroll"], r["roi"]) == (10, 6, 4, 1200.0, pytest.approx(0.2))
    assert r["win_rate"] == pytest.approx(0.6) and r["avg_stake"] == 100


def test_portfolio_without_bets_and_defaults(spark):
    df = spark.createDataFrame([("a", 1, 0.1, 1), ("b", 1, 0.9, 1)], "who string, i int, p double, actual int")
    placed = ledger.bets(df, "who", ["i"], "p", "actual")
    rows = {r["who"]: r for r in ledger.summary(placed, "who", portfolios=df).collect()}
    assert rows["a"]["total_bets"] == 0 and rows["a"]["final_bankroll"] == 1000 and rows["a"]["sharpe"] == 0
    assert rows["b"]["final_bankroll"] == 1010  # odds default to 2


def test_all_in_loss_ends_the_ledger(spark):
    df = spark.createDataFrame([("a", 1, 1.0, 0), ("a", 2, 1.0, 1)], "who string, i int, p double, actual int")
    placed = ledger.bets(df, "who", ["i"], "p", "actual", mode="kelly", cap=1.0).collect()
    assert len(placed) == 1 and placed[0]["bankroll"] == 0
