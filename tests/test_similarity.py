import numpy as np
import pytest

from entitystats.operators import similarity as SIM


@pytest.mark.parametrize("tiles", [(8192, 2000), (7, 3)])
def test_top_similar_equals_brute_force(spark, monkeypatch, tiles):
    monkeypatch.setattr(SIM, "ITEM_TILE", tiles[0])
    monkeypatch.setattr(SIM, "QUERY_TILE", tiles[1])
    rnd = np.random.default_rng(3)
    items = [(i, [float(x) for x in rnd.integers(-2, 3, 4)]) for i in range(60)] + [(60, None), (61, []), (62, [1.0, 2.0]), (63, [0.0] * 4)]
    asked = [(f"q{i}", [float(x) for x in rnd.integers(-2, 3, 4)]) for i in range(9)] + [("empty", []), ("none", None), ("short", [1.0, 2.0])]

    def score(a, b):
        a, b = np.array(a or [], float), np.array(b or [], float)
        size = np.linalg.norm(a) * np.linalg.norm(b) if len(a) == len(b) else 0
        return float(a @ b / size) if size else 0.0

    got = SIM.top_similar(
        spark.createDataFrame(items, "id int, vector array<double>"), spark.createDataFrame(asked, "query_id string, query array<double>"), 5
    )
    found = {}
    for r in got.collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["id"], round(r["score"], 9)))
    for name, q in asked:
        want = sorted(((-round(score(v, q), 9), i) for i, v in items))[:5]
        mine = sorted(found[name])
        assert [s for _, _, s in mine] == pytest.approx([-s for s, _ in want])
        assert len({i for _, i, _ in mine}) == 5


def test_no_items_or_no_queries(spark):
    items = spark.createDataFrame([], "id int, vector array<double>")
    asked = spark.createDataFrame([("a", [1.0])], "query_id string, query array<double>")
    assert SIM.top_similar(items, asked, 3).count() == 0
    one = spark.createDataFrame([(1, [1.0])], "id int, vector array<double>")
    assert SIM.top_similar(one, asked.limit(0), 3).count() == 0
    assert [tuple(r) for r in SIM.top_similar(one, asked, 3).collect()] == [("a", 1, 1.0, 1)]


def test_far_groups_are_not_met(spark, monkeypatch):
    """On clustered vectors each query meets few of the groups, and still finds its nearest exactly."""
    monkeypatch.setattr(SIM, "ITEM_TILE", 25)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 16))
    vectors = np.concatenate([c + 0.05 * rng.normal(size=(50, 16)) for c in centres] + [np.repeat(centres[:1], 200, axis=0)])
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id int, vector array<double>").repartition(3)
    asked = centres + 0.05 * rng.normal(size=(20, 16))
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query_id int, query array<double>")
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    scores = unit(asked) @ unit(vectors).T
    found = {}
    for r in SIM.top_similar(items, queries, 4).collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = r["score"]
    for q in range(20):
        assert [found[q][n] for n in range(1, 5)] == pytest.approx(sorted(scores[q])[::-1][:4])
    tiles = SIM.Tiles(items, "id", "vector")
    visits = tiles.nearest(queries, "query", 4).unionByName(tiles.others(queries.withColumn("__kth", SIM.F.lit(0.98)), "query", 4))
    assert len(tiles.centres) > 20 and visits.select("query_id", "__tile").distinct().count() < 0.3 * 20 * len(tiles.centres)
