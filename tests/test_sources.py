import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from entitystats.functions.teams import team_code
from entitystats.operators import lines as L
from entitystats.operators.splits import entity_time_split
from entitystats.sources import catalog, files
from tests.helpers import same


def test_game_logs(spark, tmp_path):
    (tmp_path / "player_23_2023-24.json").write_text(json.dumps([{"GAME_DATE": "2024-01-01", "PTS": 10}, {"GAME_DATE": "2024-01-03", "PTS": 12, "MIN": "30:30"}]))
    (tmp_path / "player_7_2024-25.jsonl").write_text('{"GAME_DATE": "2024-11-01", "PTS": 5}\n')
    df = files.read_game_logs(spark, str(tmp_path))
    assert sorted((r["entity_id"], r["season"], r["PTS"]) for r in df.collect()) == [(7, "2024-25", "5"), (23, "2023-24", "10"), (23, "2023-24", "12")]
    assert files.read_game_logs(spark, str(tmp_path / "none")).count() == 0
    grouped = files.league_games(df, "entity_id", "GAME_DATE", ["PTS"], 5)
    assert {r["entity_id"]: [g["PTS"] for g in r["games"]] for r in grouped.collect()} == {7: ["5"], 23: ["12", "10"]}


def test_jsonl_and_audit(spark, tmp_path):
    p = tmp_path / "items.jsonl"
    p.write_text('{"id": "a", "text": "x"}\n\nnot json\n{"news_id": "b", "content": "y", "meta": {"k": "v"}}\n{"id": "c"}\n{"id": 5, "text": "num"}\n')
    assert {(r["id"], r["text"]) for r in files.read_items(spark, str(p)).collect()} == {("a", "x"), ("b", "y"), ("5", "num")}
    raw = spark.createDataFrame([("g1", "LAL")], "gid string, h_team string")
    for _ in range(2):
        files.append_audit(raw, str(tmp_path / "audit"), "2024-01-01")
    assert files.read_raw_games(spark, str(tmp_path / "audit" / "*")).filter("gid = 'g1'").count() == 2


def test_tracking(spark, tmp_path):
    (tmp_path / "ann.json").write_text(json.dumps({"rows": [{"avg_speed_mph": 4, "touches": 10}, {"touches": "12"}]}))
    (tmp_path / "ann.csv").write_text("touches,game_date\n99,2024\n")
    (tmp_path / "bob.csv").write_text('game_date,note,touches,exp_fg_pct\n2024-01-01,"late, away",11,52%\n2024-01-02,,,\n')
    spark.createDataFrame([(3.0,)], "touches double").coalesce(1).toPandas().to_parquet(tmp_path / "cy.parquet")
    rows = files.read_tracking(spark, str(tmp_path))
    assert sorted((r["entity"], r["touches"]) for r in rows.collect()) == [("ann", "10"), ("ann", "12"), ("bob", ""), ("bob", "11"), ("cy", "3.0")]


def test_corpus(spark, tmp_path):
    (tmp_path / "lebron_james.txt").write_text("He is out.")
    (tmp_path / "lebron_extra.json").write_text(json.dumps({"text": "new contract"}))
    (tmp_path / "ann_lee.json").write_text(json.dumps(["one", "two"]))
    (tmp_path / "bad_one.json").write_text('{"text": "cut off')
    (tmp_path / "quoted_one.csv").write_text('a,"b, c",d\n\n"say ""hi""",e\n')
    (tmp_path / "x.bin").write_text("no")
    corpus = files.read_corpus(spark, str(tmp_path))
    names = spark.createDataFrame([("LeBron James",), ("Lebron",), ("Ann Lee",), ("Zed",)], "n string")
    got = sorted((r["n"], r["position"], r["text"]) for r in files.corpus_for_names(names, "n", corpus).collect())
    assert got == [("Ann Lee", 0, "one\n\ntwo"), ("LeBron James", 0, "He is out."), ("Lebron", 0, "new contract"), ("Lebron", 1, "He is out.")]
    texts = {r["path"]: r["text"] for r in corpus.collect()}
    assert texts["bad_one.json"] == "" and texts["quoted_one.csv"] == 'a b, c d\nsay "hi" e'
    flags = {r["n"]: (r["injury_sentiment"], r["motivation"]) for r in files.corpus_flags(names, "n", corpus).collect()}
    assert flags == {"LeBron James": (-1, 0), "Lebron": (-1, 1), "Ann Lee": (0, 0)}


@pytest.mark.parametrize("limit", [3, None])
def test_texts_in_order(spark, limit):
    df = spark.createDataFrame([("k", i, f"t{i}") for i in range(7)] + [("k", 9, ""), ("k", 10, None), ("s", 0, "z")], "k string, i int, t string")
    rows = files.ordered_texts(df, "k", "t", "i", max_rows=limit).orderBy("k", "position").collect()
    assert [tuple(r) for r in rows] == [("k", i, i, f"t{i}") for i in range(7)] + [("s", 0, 0, "z")]


def test_feed(spark, tmp_path):
    line = lambda i, p, lg, status: {"id": i, "type": "projection", "attributes": {"stat_type": "Points", "line_score": 20.5, "status": status}, "relationships": {"new_player": {"data": {"id": p}}, "league": {"data": {"id": lg}}}}
    inc = [{"id": "1", "type": "new_player", "attributes": {"name": "Ann", "team": "LAL"}}, {"id": "9", "type": "league", "attributes": {"name": "NBA"}}]
    (tmp_path / "feed.json").write_text(json.dumps({"data": [line("a", "1", "9", "pre_game"), line("b", "2", "8", "pre_game"), line("c", "1", "9", "live")], "included": inc}))
    (tmp_path / "bare.json").write_text(json.dumps([line("d", "1", "9", "pre_game")]))
    rows = {r["id"]: r for r in L.flatten_feed(files.read_feed(spark, str(tmp_path / "*.json"))).collect()}
    assert set(rows) == {"a", "b", "d"} and (rows["a"]["player"], rows["a"]["league"], rows["a"]["position"]) == ("Ann", "NBA", "Unknown")
    assert rows["b"]["player"] == "Unknown" and rows["b"]["line"] == 20.5


def test_small_readers(spark, tmp_path):
    (tmp_path / "names.json").write_text(json.dumps({"My Town": "myt"}))
    names = files.read_name_map(spark, str(tmp_path / "names.json"))
    df = spark.createDataFrame([("MY Town",), ("Lakers",), ("ABC",), ("",), (None,)], "n string")
    coded = files.with_codes(df, "n", names)
    assert {r["n"]: r["code"] for r in coded.collect()} == {"MY Town": "MYT", "Lakers": "LAK", "ABC": "ABC", "": "", None: None}
    given = {r["name"]: r["code"] for r in names.collect()}
    same(coded, df.withColumn("code", team_code(F.col("n"), given)))
    (tmp_path / "c.csv").write_text("player,season,PER,WS\nAnn,2023-24,20.5,9\n")
    assert files.read_canonical(spark, str(tmp_path / "c.csv")).first()["PER"] == 20.5
    (tmp_path / "a.csv").write_text("roster_name,resolved_player_id\nAnn,12.0\nBob, \nCy,\n")
    assert [tuple(r) for r in files.read_aliases(spark, str(tmp_path / "a.csv")).collect()] == [("Ann", "12.0")]
    bad = spark.createDataFrame([(1,), (1,), (2,)], "id int")
    files.append_rejects(bad, str(tmp_path / "rej"), "game", "id", F.lit("late"))
    assert {(r["id"], r["failures"]) for r in files.reject_counts(spark, str(tmp_path / "rej")).collect()} == {("1", 2), ("2", 1)}


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 2, 3, 4, 5), dt.date(2024, 1, 2), 1.5)], "t timestamp, d date, x double")
    files.export_csv(df, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).first()[:2] == ("2024-01-02T03:04:05", "2024-01-02")
    zoned = spark.createDataFrame([("2024-01-02T03:04:05+02:00",)], "t string")
    files.rewrite_parquet(zoned, "t", str(tmp_path / "pq"))
    back = spark.read.parquet(str(tmp_path / "pq"))
    assert dict(back.dtypes)["t"] == "timestamp_ntz" and back.first()["t"] == dt.datetime(2024, 1, 2, 1, 4, 5)
    files.write_report(df, str(tmp_path / "rep"), "json")
    assert spark.read.json(str(tmp_path / "rep")).count() == 1


def test_catalog(spark, tmp_path):
    base, reg = str(tmp_path / "sets"), str(tmp_path / "registry")
    rows = spark.createDataFrame([(p, dt.date(2024, 1, d), float(d)) for p in "ab" for d in range(1, 11)], "p string, d date, x double")
    assert catalog.list_datasets(spark, base).count() == 0 and catalog.latest_registered(spark, reg, "points") is None
    m1 = catalog.create_version(entity_time_split(rows, "p", "d"), base, "points", "2023-24", version="v1", uid="u1")
    assert (m1["rows_train"], m1["rows_val"], m1["rows_test"]) == (14, 4, 2)  # half-even sizes of ten rows each
    same(catalog.read_version(spark, m1).drop("split"), rows)
    assert catalog.read_version(spark, m1, "val").count() == 4
    m2 = catalog.export_dataset(rows.drop("x"), base, "points", labels=rows.select("x"), version="v2", uid="u2")
    assert m2["rows"] == 20 and spark.read.parquet(m2["files"]["labels"]).count() == 20
    catalog.export_dataset(rows, base, "other", fmt="csv", version="v1", uid="u3")
    assert catalog.list_datasets(spark, base).count() == 3 and catalog.latest_dataset(spark, base, "points")["version"] == "v2"
    with pytest.raises(Exception):
        catalog.export_dataset(rows, base, "points", version="v2", uid="u2")  # a version is never overwritten
    for m in (m1, m2, m1):
        catalog.register(spark, reg, m)
    assert catalog.registered(spark, reg).count() == 2 and catalog.latest_registered(spark, reg, "points")["uid"] == "u2"
    assert [r["version"] for r in catalog.versions_beyond(catalog.list_datasets(spark, base), 1).collect()] == ["v1"]


def test_clustered_reads(spark, tmp_path):
    """A read opens the files that can match only; nulls, a hot key and empty ranges are no obstacle."""
    from entitystats.sources.clustered import matching_files, read_range, write_clustered

    rows = [(i % 40 if i % 3 else 7, i, float(i)) for i in range(3000)] + [(None, 1, 0.5), (9, None, 0.25)]
    df = spark.createDataFrame(rows, "k int, t int, v double")
    path = str(tmp_path / "c")
    write_clustered(df, path, ["k", "t"], 12)
    assert spark.read.parquet(f"{path}/files").agg(F.sum("rows")).first()[0] == len(rows)
    for ranges in ({"k": (30, 31)}, {"k": (7, 7), "t": (100, 200)}, {"t": (None, 50)}, {"k": (99, None)}, {}):
        fits = lambda r: all(r[i] is not None and (lo is None or r[i] >= lo) and (hi is None or r[i] <= hi) for i, c in enumerate("kt") if c in ranges for lo, hi in [ranges[c]])
        assert sorted(r["v"] for r in read_range(spark, path, ranges).collect()) == sorted(r[2] for r in rows if fits(r))
    total = spark.read.parquet(f"{path}/files").count()
    assert matching_files(spark, path, {"k": (30, 31)}).count() <= 3 < total and matching_files(spark, path, {"k": (99, None)}).count() == 0
    assert len(read_range(spark, path, {"k": (30, 31)}).inputFiles()) <= 3
