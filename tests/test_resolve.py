import random

import pytest
from pyspark.sql import functions as F

from entitystats.functions.text import normalise_name
from entitystats.operators import resolve as R
from entitystats.operators import sets as S
from tests.helpers import same


def loop(records, entities):
    """One record at a time, as a database session would do it."""
    table = [dict(id=i, name=n, ext=x) for i, n, x in entities]
    out = {}
    for seq, name, ext in records:
        hit = next((e for e in table if ext is not None and e["ext"] == ext), None) or next((e for e in table if name and e["name"] == name), None)
        if hit is None:
            hit = dict(id=max([e["id"] for e in table], default=0) + 1, name=name or f"player_{ext}", ext=ext)
            table.append(hit)
        elif hit["ext"] is None and ext is not None:
            hit["ext"] = ext
        out[seq] = hit["name"]
    return out, {e["name"]: e["ext"] for e in table}


@pytest.mark.parametrize("seed", range(3))
def test_entities_against_loop(spark, seed):
    rnd = random.Random(seed)
    names = [f"n{i}" for i in range(12)]
    own = {n: 100 + i for i, n in enumerate(names)}
    entities = [(i + 1, names[i], own[names[i]] if i % 2 else None) for i in range(5)]
    records = []
    for s in range(60):
        n = rnd.choice(names)
        form = rnd.randint(0, 2)
        records.append((s, None if form == 2 and own[n] in {e[2] for e in entities} else n, own[n] if form else None))
    want, table = loop(records, entities)
    rec = spark.createDataFrame(records, "s int, name string, ext bigint")
    ent = spark.createDataFrame(entities, "id bigint, name string, ext_id bigint")
    out, after = R.resolve_entities(rec, ent, "s", "name", "ext")
    label = {r["id"]: r["name"] for r in after.collect()}
    assert {r["s"]: label[r["entity_id"]] for r in out.collect()} == want
    assert {r["name"]: r["ext_id"] for r in after.collect()} == table
    assert len(label) == after.count()


def test_events(spark):
    old = spark.createDataFrame([(1, "d1", "A", "B", 5), (2, "d2", "A", "C", None)], "id bigint, game_date string, home_team string, away_team string, home_score bigint")
    new = spark.createDataFrame([(1, "d1", "A", "B", 7), (2, "d2", "X", "", 3), (3, "d3", "A", "B", 1), (4, "d3", "C", "D", None), (5, None, "A", "B", 1)], "s bigint, game_date string, home_team string, away_team string, home_score bigint")
    table, counts = R.resolve_events(new, old, "s", scores=["home_score"])
    rows = {(r["game_date"], r["home_team"]): r["home_score"] for r in table.collect()}
    assert rows == {("d1", "A"): 7, ("d2", "A"): 3, ("d3", "A"): 1, ("d3", "C"): None}
    assert tuple(counts.first()) == (2, 2)
    again, counts = R.resolve_events(new, table, "s", scores=["home_score"])
    same(again, table)
    assert tuple(counts.first()) == (0, 0)
    _, counts = R.resolve_events(new, old, "s", scores=["home_score"], match="date_only")
    assert counts.first()["inserted"] == 1


def test_name_mapping(spark):
    roster = spark.createDataFrame([(n,) for n in ["LeBron James", "jose álvarez", "Smith", "Ann", "Nobody", "Kevin Durant Jr"]], "r string")
    names = spark.createDataFrame([(n,) for n in ["LeBron James", "José Alvarez", "John Smith", "Joe Smith", "Joanna Lee", "Kevin Durant"]], "n string")
    got = {x["r"]: (x["mapped"], x["how"]) for x in R.map_names(roster, "r", names, "n").collect()}
    assert got["LeBron James"] == ("LeBron James", "strict") and got["jose álvarez"] == ("José Alvarez", "strict")
    assert got["Smith"] == (None, "none") and got["Ann"] == ("Joanna Lee", "contains") and got["Nobody"] == (None, "none")
    assert got["Kevin Durant Jr"] == ("Kevin Durant", "contains")
    ids = spark.createDataFrame([("Ann", "Ann Other"), ("LeBron James", "Lebron James")], "roster_name string, canonical string")
    got = {x["r"]: x["mapped"] for x in R.map_names(roster, "r", names, "n", ids).collect()}
    assert got["Ann"] is None and got["LeBron James"] == "LeBron James"


def test_containment_against_loop(spark):
    rnd = random.Random(9)
    word = lambda k: "".join(rnd.choice("abc") for _ in range(k))
    names = sorted({word(rnd.randint(1, 8)) for _ in range(60)})
    asks = sorted({word(rnd.randint(1, 6)) for _ in range(40)})
    n, a = spark.createDataFrame([(x,) for x in names], "n string"), spark.createDataFrame([(x,) for x in asks], "a string")
    inside = {r["a"]: (r["n"], r["match"]) for r in R.containing_names(a, "a", n, "n").collect()}
    around = {r["a"]: (r["n"], r["match"]) for r in R.contained_names(a, "a", n, "n").collect()}
    for q in asks:
        up, down = [x for x in names if q in x], [x for x in names if x in q]
        assert inside.get(q) == ((len(up), min(up)) if up else None)
        assert around.get(q) == ((len(down), min(down)) if down else None)


def test_sets(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "k int, v string, s int")
    got = S.upsert(old, new, "k", "s")
    assert {r["k"]: r["v"] for r in got.collect()} == {1: "a", 2: "y", 3: "z"}
    same(S.upsert(got, new, "k", "s"), got)  # putting the same batch again changes nothing
    assert {r["k"] for r in S.difference(old, new, "k").collect()} == {1}


def test_repairs(spark):
    rec = spark.createDataFrame([(1, None, 7), (2, "kept", 7), (3, "", None)], "i int, player_name string, pid bigint")
    dim = spark.createDataFrame([(7, "Seven")], "id bigint, name string")
    rows = {r["i"]: (r["player_name"], r["repaired"]) for r in R.fill_names(rec, dim, ["pid"]).collect()}
    assert rows == {1: ("Seven", True), 2: ("kept", False), 3: ("", False)}
    cat = spark.createDataFrame([("a", "base", "p1"), ("a", "retrained", "p2"), ("b", "base", "p3"), ("c", "other", "p4")], "k string, kind string, path string")
    assert {r["k"]: r["path"] for r in R.prefer_first(cat, "k", ["retrained", "base"]).collect()} == {"a": "p2", "b": "p3"}


def test_normalise_decomposed(spark):
    df = spark.createDataFrame([("José",), ("JOSÉ.",)], "n string")
    assert {r[0] for r in df.select(normalise_name(F.col("n"))).collect()} == {"jose"}
