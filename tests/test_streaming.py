import datetime as dt
import json
import os
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from entitystats.operators.normalize import GAME_ALIASES
from entitystats.plans import streaming_queries as SQ
from entitystats.session import scratch_folder
from entitystats.sources.files import text_schema
from entitystats.skew import Timeline
from entitystats.streaming import ingest as I
from entitystats.streaming import levels as L
from entitystats.streaming import resolving as RS
from entitystats.streaming import state as ST
from tests.helpers import rows_of

FIELDS = list(dict.fromkeys([n for a in GAME_ALIASES.values() for n in a] + ["player_name", "player_nba_id", "stat_type", "value"]))


def drop(folder, name, records):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in records))


def game(day, home, away, score, player, value):
    return {"date": day, "homeTeam": home, "away": away, "homeScore": str(score), "player_name": player, "stat_type": "points", "value": str(value)}


def test_ingest_twice_and_replay(spark, tmp_path):
    src, base, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    run = lambda: I.run_ingest(I.file_stream(spark, str(src), text_schema(FIELDS)), base, check)
    drop(src, "a.json", [game("2024-01-01", "Lakers", "BOS", 100, "Ann", 20), game("2024-01-01", "Lakers", "BOS", 100, "Bob", 10), game("2024-01-02", "", "BOS", 1, "Cy", 5)])
    run()
    values = I.current(spark, base, "player_stats", ["player", "game_date", "stat_type"])
    assert {(r["player"], r["value"]) for r in values.collect()} == {("Ann", 20), ("Bob", 10)}
    assert I.batches(spark, base, "rejects").count() == 1 and I.batches(spark, base, "audit").count() == 3
    before = rows_of(values)
    run()  # nothing new
    assert rows_of(I.current(spark, base, "player_stats", ["player", "game_date", "stat_type"])) == before
    drop(src, "b.json", [game("2024-01-01", "LAL", "BOS", 101, "Ann", 21), game("2024-01-03", "MIA", "BOS", 90, "Ann", 7)])
    run()
    values = I.current(spark, base, "player_stats", ["player", "game_date", "stat_type"])
    assert sorted(r["value"] for r in values.filter("player = 'Ann'").collect()) == [7, 21]
    games = {(r["game_date"].day, r["home_team"]): r["home_score"] for r in I.current_games(spark, base).collect()}
    assert games == {(1, "LAL"): 101, (3, "MIA"): 90}
    before = rows_of(values)
    # a batch that runs again after a failure leaves the same tables
    I.ingest_batch(spark.read.schema(text_schema(FIELDS)).json(str(src / "b.json")), base, 1)
    assert rows_of(I.current(spark, base, "player_stats", ["player", "game_date", "stat_type"])) == before


def test_dry_run(spark, tmp_path):
    src = tmp_path / "in"
    drop(src, "a.json", [game("2024-01-01", "LAL", "BOS", 1, "Ann", 2)])
    I.run_ingest(I.file_stream(spark, str(src), text_schema(FIELDS)), str(tmp_path / "out"), str(tmp_path / "c"), dry_run=True)
    assert I.batches(spark, str(tmp_path / "out"), "audit").count() == 1 and I.batches(spark, str(tmp_path / "out"), "player_stats") is None


def test_late_rows_are_left_out(spark, tmp_path):
    src, base, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "c")
    stream = lambda: I.file_stream(spark, str(src), "e string, t timestamp, v double", files_per_batch=1)
    row = lambda day, v: {"e": "a", "t": f"2024-03-{day:02d}T00:00:00Z", "v": v}
    for name, records in (("1.json", [row(1, 1.0), row(20, 3.0)]), ("2.json", [row(20, 5.0)]), ("3.json", [row(2, 9.0), row(19, 7.0)])):
        drop(src, name, records)
        I.run_updates(I.daily_means(stream(), "e", "t", "v"), base, "daily", check)
    got = {r["day"].day: (r["avg_value"], r["n"]) for r in I.current(spark, base, "daily", ["day", "e"]).collect()}
    assert got == {1: (1.0, 1), 20: (4.0, 2), 19: (7.0, 1)}  # the second of March came too late


def test_index_only_new(spark, tmp_path):
    src, base, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "c")
    run = lambda: I.run_index(I.file_stream(spark, str(src), "id string, text string"), base, check, dim=4)
    drop(src, "a.json", [{"id": "x", "text": "one"}, {"id": "y", "text": "two"}, {"id": "", "text": "no"}])
    run()
    drop(src, "b.json", [{"id": "x", "text": "other"}, {"id": "z", "text": "three"}])
    run()
    got = I.batches(spark, base, "index")
    assert sorted((r["source_id"], r["batch"]) for r in got.collect()) == [("x", 0), ("y", 0), ("z", 1)]


def test_backfill_and_downsample(spark, tmp_path):
    src, base = tmp_path / "in", str(tmp_path / "out")
    for i in range(3):
        drop(src, f"{i}.json", [{"e": f"p{i}", "v": 1.0}])
    I.run_backfill(I.file_stream(spark, str(src), "e string, v double", files_per_batch=1), base, str(tmp_path / "c"), "e")
    assert I.batches(spark, base, "target").count() == 3 and {r["batch"] for r in I.batches(spark, base, "affected").collect()} == {0, 1, 2}
    t = lambda d, h: dt.datetime(2024, 1, d, h)
    df = spark.createDataFrame([("a", t(1, 1), 1.0), ("a", t(1, 5), 3.0), ("a", t(9, 5), 8.0)], "e string, t timestamp, v double")
    rows = I.downsample(df, "e", "t", "v", F.lit("2024-01-05").cast("timestamp")).collect()
    assert sorted((r["t"], r["v"], r["n"]) for r in rows) == [(t(1, 0), 2.0, 2), (t(9, 5), 8.0, 1)]


def plain_ema(values, alpha):
    out = []
    for v in values:
        out.append(v if not out else alpha * v + (1 - alpha) * out[-1])
    return out


@pytest.mark.parametrize("max_rows", [None, 3])
def test_state_goes_on_over_batches(spark, tmp_path, max_rows):
    src, base, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "c")
    step = ST.ForwardEma("e", ["i"], "i", 0.5, max_rows)
    sent = [[10.0, 20.0, None, 4.0, 4.0, 7.0, 1.0, 0.0], [30.0]]
    for n, vals in enumerate(sent):
        drop(src, f"{n}.json", [{"e": "a", "i": n * 10 + k, "value": v} for k, v in enumerate(vals)] + [{"e": "b", "i": n, "value": 2.0}])
        ST.run_state(I.file_stream(spark, str(src), "e string, i int, value double"), step, base, "ema", check)
    rows = I.batches(spark, base, "ema").collect()
    want = plain_ema([v for vals in sent for v in vals if v is not None], 0.5)
    assert [round(r["ema"], 9) for r in sorted(rows, key=lambda r: r["i"]) if r["e"] == "a"] == [round(v, 9) for v in want]
    assert {r["ema"] for r in rows if r["e"] == "b"} == {2.0}
    # the second batch once more
    ST.state_batch(spark.read.schema("e string, i int, value double").json(str(src / "1.json")), step, base, "ema", 1)
    assert sorted(tuple(r) for r in I.batches(spark, base, "ema").collect()) == sorted(tuple(r) for r in rows)


@pytest.mark.parametrize("max_rows", [None, 2])
def test_bankroll_stops_at_the_stake(spark, tmp_path, max_rows):
    base = str(tmp_path / "out")
    step = ST.FlatStake("e", ["i"], "i", 25.0, 10.0, max_rows)
    bet = lambda i, actual, p=0.9: ("a", i, p, 2.0, actual)
    sent = [[bet(0, 0), bet(1, 1), bet(2, 1, 0.1), bet(3, 0), bet(4, 0)], [bet(5, 1), bet(6, 1)], [bet(7, 1)]]
    for n, rows in enumerate(sent):
        ST.state_batch(spark.createDataFrame(rows, "e string, i int, pred_prob double, odds double, actual int"), step, base, "bets", n)
    got = {r["i"]: r["bankroll"] for r in I.batches(spark, base, "bets").collect()}
    assert got == {0: 15.0, 1: 25.0, 3: 15.0, 4: 5.0}  # 5 is below the stake: no more bets


def test_one_key_over_many_tasks(spark, tmp_path):
    """A key with nine tenths of the rows is cut into slices, and no group holds more."""
    rows = spark.range(4000).selectExpr("IF(id % 10 = 0, concat('k', id % 7), 'hot') AS e", "id AS i", "CAST(id % 13 AS DOUBLE) AS value")
    step = ST.ForwardEma("e", ["i"], "i", 0.3, 500)
    out, after = step.advance(rows, spark.createDataFrame([("hot", 6.0)], "e string, v double"))
    values = [float(i % 13) for i in range(4000) if i % 10]
    got = [r["ema"] for r in out.filter("e = 'hot'").orderBy("i").collect()]
    want = plain_ema([6.0, *values], 0.3)[1:]
    assert np.allclose(got, want) and abs(after.filter("e = 'hot'").first()["v"] - want[-1]) < 1e-9
    line = Timeline(rows, "e", ["i"], 500)
    sizes = line.df.groupBy(*line.keys).count()
    assert line.sliced and sizes.filter("e = 'hot'").count() >= 6 and sizes.agg(F.max("count")).first()[0] < 1500


def test_folding(spark, tmp_path):
    """After 50 batches few folders are read, and the rows are those of the plain reading."""
    base = str(tmp_path / "t")
    for n in range(50):
        L.write_batch(spark.createDataFrame([(k, n * 10 + k) for k in {n % 7, 8, n % 3}], "k int, v int").coalesce(1), base, "x", n)
        L.fold(spark, base, "x", "k", n, width=4)
    folders = L.parts(spark, base, "x", fold=4)
    assert len(folders) == 5 and sum("level=2" in f for f in folders) == 3
    plain = {k: max(n * 10 + k for n in range(50) if k in {n % 7, 8, n % 3}) for k in [*range(7), 8]}
    got = L.last_rows(L.read_parts(spark, base, "x", folders), ["k"], ["batch"]).collect()
    assert {r["k"]: r["v"] for r in got} == plain
    # the newest batch runs again; a part that was not completed does not count
    L.write_batch(spark.createDataFrame([(8, -1)], "k int, v int"), base, "x", 49)
    (tmp_path / "t" / "x_levels" / "level=3" / "last=49").mkdir(parents=True)
    assert len(L.parts(spark, base, "x", fold=4)) == 5
    rows = L.last_rows(L.read_parts(spark, base, "x", L.parts(spark, base, "x", fold=4)), ["k"], ["batch"])
    assert {r["k"]: r["v"] for r in rows.collect()}[8] == -1
    before = L.read_parts(spark, base, "x", L.parts(spark, base, "x", before=48, fold=4))
    assert L.last_rows(before, ["k"], ["batch"]).filter("k = 8").first()["v"] == 478 and before.agg(F.max("batch")).first()[0] == 47


RECORDS = [
    [game("2024-01-01", "LAL", "BOS", 100, "Ann", 20) | {"player_nba_id": None}, game("2024-01-01", "LAL", "BOS", 101, None, 10) | {"player_nba_id": "7"}, game("2024-01-02", "MIA", "NYK", 90, "Bob", 1) | {"player_nba_id": "8"}],
    [game("2024-01-01", "LAL", "BOS", 99, "Ann", 5) | {"player_nba_id": "7"}, game("2024-01-01", "CHI", "BOS", 50, "Ann", 6)],
    [game("2024-01-03", "", "BOS", 1, "Cy", 5)],
    [game("2024-01-03", "DEN", "BOS", 3, "Bob", 4), game("2024-01-02", "MIA", "NYK", 80, "Robert", 2) | {"player_nba_id": "8"}, game("2024-01-02", "MIA", "NYK", 70, "Bob", 3)],
]


@pytest.mark.parametrize("files", [1, 4])
def test_resolving_ingest(spark, tmp_path, files):
    src, base, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    for n, records in enumerate(RECORDS):
        drop(src, f"{n}.json", records)
        os.utime(src / f"{n}.json", (1_700_000_000 + n, 1_700_000_000 + n))
    stream = I.file_stream(spark, str(src), text_schema(FIELDS), files_per_batch=files, arrival=True)
    RS.run_resolving_ingest(stream, base, check)
    assert I.batches(spark, base, "audit").select("batch").distinct().count() == 4 // files
    entities = lambda: {r["id"]: (r["name"], r["ext_id"]) for r in RS.current_entities(spark, base).collect()}
    # a number alone makes a player of its own; later records with it are that player's
    assert entities() == {1: ("Ann", None), 2: ("player_7", 7), 3: ("Bob", 8)}
    events = {r["id"]: (r["game_date"].day, r["home_team"], r["home_score"]) for r in RS.current_events(spark, base).collect()}
    facts = {(r["entity_id"], r["event_id"]): r["value"] for r in RS.current_facts(spark, base).collect()}
    if files == 1:
        # Chicago came when the day had a game already; the last score stands though it is lower
        assert events == {1: (1, "LAL", 50), 2: (2, "MIA", 70), 3: (3, "DEN", 3)}
        assert facts == {(1, 1): 6.0, (2, 1): 5.0, (3, 2): 3.0, (3, 3): 4.0}
    else:
        assert events == {1: (1, "LAL", 99), 2: (2, "MIA", 70), 3: (1, "CHI", 50), 4: (3, "DEN", 3)}
    before = (entities(), events, facts)
    raw = spark.read.schema(text_schema(FIELDS)).json([str(src / f"{n}.json") for n in ([3] if files == 1 else range(4))])
    place = F.concat_ws("|", F.date_format("_metadata.file_modification_time", "yyyyMMddHHmmss"), F.col("_metadata.file_path"), F.lit("0"))
    RS.resolve_batch(raw.select("*", place.alias(I.SOURCE)), base, 3 if files == 1 else 0)
    again = {r["id"]: (r["game_date"].day, r["home_team"], r["home_score"]) for r in RS.current_events(spark, base).collect()}
    assert (entities(), again, {(r["entity_id"], r["event_id"]): r["value"] for r in RS.current_facts(spark, base).collect()}) == before


def test_last_copy_stands(spark, tmp_path):
    src, base = tmp_path / "in", str(tmp_path / "out")
    drop(src, "a.json", [game("2024-01-01", "LAL", "BOS", 120, "Ann", 30), game("2024-01-01", "LAL", "BOS", 110, "Ann", 25)])
    I.run_ingest(I.file_stream(spark, str(src), text_schema(FIELDS), arrival=True), base, str(tmp_path / "c"))
    assert I.current(spark, base, "player_stats", ["player", "game_date", "stat_type"]).first()["value"] == 25
    assert I.current_games(spark, base).first()["home_score"] == 110


def test_a_micro_batch_comes_in_many_files_of_one_slice(spark):
    rows = spark.range(1_000_000).select("id", F.when(F.col("id") < 2, 0).when(F.col("id") < 5, 1).otherwise(2 + F.col("id") % 2).alias("k"))
    got = []
    stream = SQ._sliced(SimpleNamespace(spark=spark), rows, F.col("k"))
    I.run_available(stream, lambda df, batch: got.append((df.select("k").distinct().collect(), df.count(), df.rdd.getNumPartitions())), scratch_folder(spark, "check"))
    assert [([r["k"] for r in ks], n) for ks, n, _ in got] == [([0], 2), ([1], 3), ([2], 499_997), ([3], 499_998)]
    assert min(parts for _, _, parts in got[2:]) > 1


def test_records_are_read_once(spark, tmp_path):
    raw = I.with_arrival(spark.createDataFrame([("2024-01-01", "LAL", "BOS", "7"), ("", "LAL", "BOS", "8")], "date string, homeTeam string, away string, value string"))
    good = I.accepted(raw, str(tmp_path), 0)
    assert [r["game_date"].day for r in good.collect()] == [1]
    assert "gettimestamp" not in good._jdf.queryExecution().optimizedPlan().toString().lower()


@pytest.mark.parametrize("alpha", [0.3, 1.0])
@pytest.mark.parametrize("cut", [1, 3, 50])
def test_mean_of_slices_over_arrow_batches(alpha, cut):
    """Slices may cross batches of rows; a value that is not finite leaves the mean."""
    slices = [[2.0, 5.0, float("nan"), 1.0, 1.0, 9.0], [4.0], [float("nan"), 3.0, float("inf"), 8.0]]
    if alpha == 1.0:
        slices = [[v for v in s if np.isfinite(v)] for s in slices]
    place, value = [n + 1 for s in slices for n in range(len(s))], [v for s in slices for v in s]
    whole = pa.RecordBatch.from_arrays([pa.array(value), pa.array(place, pa.int32())], ["value", "__n"])
    out = pa.Table.from_batches(ST._affine(alpha)(whole.slice(i, cut) for i in range(0, len(value), cut))).to_pandas()
    expect = np.concatenate([pd.Series([0.0, *s]).ewm(alpha=alpha, adjust=False).mean().to_numpy()[1:] for s in slices])
    assert np.array_equal(out["__b"].to_numpy(), expect) and np.array_equal(out["__a"].to_numpy(), (1 - alpha) ** np.array(place))
    assert list(out.columns) == ["value", "__a", "__b"]
