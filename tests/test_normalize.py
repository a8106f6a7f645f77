import datetime as dt

import pytest
from pyspark.sql import functions as F

from entitystats.functions import contexts, dates, scoring, text, values
from entitystats.functions.teams import team_code
from entitystats.operators import context as C
from entitystats.operators import lines as L
from entitystats.operators import normalize as N
from tests.helpers import same


def one(spark, **cols):
    return spark.range(1).select(*[(c if hasattr(c, "_jc") else F.lit(c)).alias(n) for n, c in cols.items()])


def test_provider_records(spark):
    rows = [
        ("Los Angeles Lakers", None, "Celtics", None, "110", None, "2025-11-12", None, None),
        (None, "Warriors", None, "MIA", "1,099 ", None, None, "1760428800", None),
        ("unknown town", None, "LAL", None, "n/a", None, None, None, "nba_20251112_game"),
    ]
    df = spark.createDataFrame(rows, "homeTeam string, h_team string, away string, awayTeam string, homeScore string, away_score string, date string, timestamp string, game_id string")
    got = N.normalize_games(df).collect()
    assert [r["home_team"] for r in got] == ["LAL", "GSW", "UNK"] and [r["away_team"] for r in got] == ["BOS", "MIA", "LAL"]
    assert [r["home_score"] for r in got] == [110, 1099, None] and got[2]["home_score_raw"] == "n/a"
    assert [r["game_date"] for r in got] == [dt.datetime(2025, 11, 12), dt.datetime(2025, 10, 14, 8), dt.datetime(2025, 11, 12)]


def test_team_codes(spark):
    names = ["LAL", "lal", "Portland Trail Blazers", "The Bulls", "Xyz United", "", None, " heat "]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    assert [r["c"] for r in df.orderBy("i").select(team_code(F.col("n")).alias("c")).collect()] == ["LAL", "LAL", "POR", "CHI", "XYZ", "", None, "MIA"]


def test_dates(spark):
    texts = ["2024-01-02", "01/02/2024", "2024-01-02T03:04:05Z", "Jan 2, 2024", "January 2, 2024", "2024-01-02T99", "", "soon", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r["d"] for r in df.orderBy("i").select(dates.parse_date(F.col("t")).alias("d")).collect()]
    assert got == [dt.date(2024, 1, 2)] * 6 + [None] * 3
    mins = ["12:30", "20", "x", None, "1:2:3", "7.5", ":"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(mins)], "i int, t string")
    assert [r["m"] for r in df.orderBy("i").select(dates.minutes_played(F.col("t")).alias("m")).collect()] == [12.5, 20, 0, 0, 0, 7.5, 0]
    r = one(spark, a=dates.season_label(F.lit("2024-10-01").cast("date")), b=dates.season_label(F.lit("2024-09-30").cast("date")), c=dates.previous_seasons(F.lit("2000-01"), 2)).first()
    assert (r["a"], r["b"], r["c"]) == ("2024-25", "2023-24", ["2000-01", "1999-00"])
    r = one(spark, ms=dates.epoch_timestamp(F.lit(1760428800000.0)), s=dates.epoch_timestamp(F.lit(1760428800.0))).first()
    assert r["ms"] == r["s"]


def test_zero_is_missing_or_not(spark):
    r = one(spark, a=values.first_truthy(F.lit(0.0), F.lit(3.0)), b=values.first_present(F.lit(0.0), F.lit(3.0)), c=values.first_nonblank(F.lit(""), F.lit("x"))).first()
    assert (r["a"], r["b"], r["c"]) == (3.0, 0.0, "x")


def test_names_and_lists(spark):
    r = one(
        spark, a=text.normalise_name(F.lit("  José  O'Neal, Jr. ")), b=text.normalise_name_suffix(F.lit("Jaren Jackson Jr.")), c=text.file_key(F.lit(" LeBron James/x ")),
        d=text.list_field(F.lit("['a', \"b\"]")), e=text.list_field(F.lit("a, b,")), f=text.list_field(F.lit("a;b")), g=text.list_field(F.lit("[]")), h=text.list_field(F.lit("solo")), i=text.list_field(F.lit(None).cast("string")),
    ).first()
    assert (r["a"], r["b"], r["c"]) == ("jose oneal jr", "jaren jackson", "lebron_james_x")
    assert [list(r[k]) for k in "defghi"] == [["a", "b"], ["a", "b"], ["a", "b"], [], ["solo"], []]


def test_json_in_text(spark):
    texts = ['noise {"morale": 80, "sentiment": -0.4, "injury": "out"} end', "none", '{"morale": 180}', '{"morale": "high"}', "} {"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.orderBy("i").select(*[c.alias(n) for n, c in text.qualitative_fields(F.col("t")).items()]).collect()
    assert rows[0]["morale_score"] == 80 and rows[0]["news_sentiment"] == -0.4 and rows[0]["injury_status"] == "out" and rows[0]["motivation"] == 0.5
    assert [r["is_valid"] for r in rows] == [True, False, False, False, False]
    flags = one(spark, **text.keyword_flags(F.lit("He talked about a contract year"))).first()
    assert flags["injury_sentiment"] == -1 and flags["motivation"] == 1 and flags["morale_score"] == 0


def test_scores(spark):
    r = one(
        spark, a=scoring.heuristic_probability(F.lit(20.0), F.lit(18.0)), b=scoring.recommendation(F.lit(0.6)), c=scoring.expected_value(F.lit(0.6)), d=scoring.kelly_fraction(F.lit(0.6), F.lit(2.0)),
        e=scoring.kelly_fraction(F.lit(0.6), F.lit(1.0)), f=scoring.heuristic_probability(F.lit(None).cast("double"), F.lit(1.0)), g=scoring.decimal_odds(F.lit(150)), h=scoring.implied_probability(F.lit(-1.0)),
    ).first()
    assert r["a"] == pytest.approx(0.6) and r["b"] == "OVER" and r["c"] == pytest.approx(0.6 * (100 / 110 + 1) - 1) and r["d"] == pytest.approx(0.2)
    assert (r["e"], r["f"], r["g"], r["h"]) == (0, None, 2.5, 0)


def test_player_records(spark):
    rows = [("LAL @ BOS", 30, None), ("LAL vs. BOS", 20, None), ("LAL vs BOS", None, None), (None, 5, "MIA")]
    df = spark.createDataFrame(rows, "MATCHUP string, PTS int, HOME_TEAM string")
    got = [(r["home_team"], r["away_team"], r["value"]) for r in N.player_records(df).collect()]
    assert got == [("BOS", "LAL", 30.0), ("LAL", "BOS", 20.0), ("MIA", "UNKNOWN", 5.0)]


def test_feature_tables(spark):
    df = spark.createDataFrame([(1, 2.0, "x", None), (2, None, "y", "u")], "id int, a double, c string, d string")
    out = N.prepare_features(df, max_levels=2, keep=["id"])
    assert out.columns == ["id", "a", "c_x", "c_y", "d_None", "d_u"] and [tuple(r) for r in out.orderBy("id").collect()] == [(1, 2.0, 1.0, 0.0, 1.0, 0.0), (2, 0.0, 0.0, 1.0, 0.0, 1.0)]
    assert N.fit_width(out, 7, keep=["id"]).columns[-2:] == ["pad_0", "pad_1"] and len(N.fit_width(out, 2, keep=["id"]).columns) == 3
    assert N.align_features(df, ["b", "a"]).columns == ["b", "a"]


def test_travel(spark):
    df = spark.createDataFrame([("LAL", "DEN"), ("lal", "BOS"), ("LAL", "???")], "t string, o string")
    rows = C.travel_features(df, "t", "o").collect()
    by = {(r["t"], r["o"]): r for r in rows}
    assert by["LAL", "DEN"]["travel_distance_km"] > 1000 and by["LAL", "DEN"]["is_high_altitude_opp"] == 1 and by["LAL", "DEN"]["opp_altitude_m"] == 1609
    assert by["lal", "BOS"]["is_rivalry"] == 1 and by["LAL", "???"]["travel_distance_km"] == 0


def test_opponent_adjusted(spark):
    games = [("a", "2025-11-01", 20.0, "DEN", 108.0), ("a", "2025-10-01", 30.0, "DEN", 109.0), ("a", "2025-09-01", 50.0, "UTA", 115.0)]
    df = spark.createDataFrame(games, "e string, d string, v double, opp string, r double")
    req = spark.createDataFrame([("a", "DEN", 109.0), ("b", "DEN", 100.0)], "e string, cur string, cur_r double")
    rows = {r["e"]: r for r in C.opponent_adjusted(df, req, "e", "d", "v", "opp", "r", "cur", "cur_r").collect()}
    a = rows["a"]
    assert (a["games_vs_current_opponent"], a["avg_vs_current_opponent"], a["avg_vs_stronger_def"], a["avg_vs_similar_def"]) == (2, 25, 25, 25)
    assert (a["last_game_vs_current_opponent_date"], a["last_game_vs_current_opponent_stat"]) == ("2025-11-01", 20.0)
    assert rows["b"]["games_vs_current_opponent"] == 0 and rows["b"]["avg_vs_stronger_def"] is None


@pytest.mark.parametrize("limit", [3, 1000])
def test_as_of(spark, limit):
    right = [("a" if i % 4 else "b", i // 2, i, float(i)) for i in range(40)]
    left = [("a", t, t * 10) for t in range(-1, 22)] + [("c", 5, 1)]
    r = spark.createDataFrame(right, "e string, t int, id int, v double")
    l = spark.createDataFrame(left, "e string, t int, q int")  # noqa: E741
    got = {(x["e"], x["q"]): x["v_before"] for x in C.as_of(l, r, "e", "t", ["v"], ["id"], max_rows=limit).collect()}
    for e, t, q in left:
        older = [(rt, i, v) for re, rt, i, v in right if re == e and rt < t]
        assert got[e, q] == (max(older)[2] if older else None)


def test_contexts(spark):
    body = '{"seasonAvg": "21.5", "recentGames": [{"gameDate": "2024-01-01", "statValue": "7", "opponent": "BOS", "opponentDefRating": 0, "opponentDef": 110}], "rollingAverages": {"last_3_avg": "5", "foo": "1"}}'
    raw = contexts.parse_context(F.lit(body))
    r = one(spark, c=contexts.normalise_context(raw), o=contexts.opponent_of_latest(raw), n=contexts.normalise_context(contexts.parse_context(F.lit("{}"))), k=contexts.rolling_entries(contexts.normalise_context(raw)["rolling_averages"])).first()
    assert r["c"]["season_avg"] == 21.5 and r["c"]["recent_games"][0]["stat_value"] == 7 and r["n"] is None
    assert r["o"]["team_id"] == "BOS" and r["o"]["defensive_rating"] == 110 and r["k"] == {"last_3_avg": 5.0}


def test_evidence(spark):
    item = {"recent_values": F.array(F.lit(1.0), F.lit(9.0)), "season_avg": F.lit(10.0), "pace": F.lit(100.0), "recommendation": F.lit("UP"), "confidence": F.lit("High")}
    trusted = {"recent_values": F.array(F.lit(1.0), F.lit(2.0)), "season_avg": F.lit(10.4), "pace": F.lit(98.0)}
    reasons = one(spark, r=L.evidence_reasons(item, trusted, F.lit(3))).first()["r"]
    assert len(reasons) == 3 and all(x.startswith("Item 3 ") for x in reasons)


def test_batch_and_lookup(spark):
    ctx = spark.createDataFrame([("x", 1.0)], "name string, form double")
    asks = C.request_positions(spark, ["x", "y", " ", None], "name")
    rows = C.batch_context(asks, ctx, "name").orderBy("pos").collect()
    assert [r["error"] for r in rows] == [None, "not found", "missing name", "missing name"]
    assert [r["pos"] for r in C.lookup_by_ids(ctx, C.request_positions(spark, ["q", "x"], "name"), "name").collect()] == [1]


def test_layouts_are_tried_by_their_marks(spark):
    """The marks rule out no layout that would have fitted."""
    texts = ["2024-01-02", "2024-01-02t03:04:05z", "01/02/2024 03:04", "Tue, 2 Jan 2024 03:04:05 GMT", "Tuesday, January 2, 2024", "january 2, 2024 3:04 am", "20240102", "2024-01", "", ",", "2 Jan 2024", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.regexp_replace("t", r"^[A-Za-z]{3,9},\s*(?=[0-9])", "")
    every = F.coalesce(*[F.try_to_timestamp(plain, F.lit(f)) for f in dates.TIMESTAMP_FORMATS], F.col("t").try_cast("timestamp"))
    got = rows.select("t", dates.parse_timestamp(F.col("t")).alias("v"), every.alias("w")).collect()
    assert [r["v"] for r in got] == [r["w"] for r in got] and sum(r["v"] is not None for r in got) == 8
