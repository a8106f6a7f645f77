"""SimHash fingerprints, links and components against plain loops."""

import re

import xxhash

from entitystats.llm import simhash as S
from entitystats.llm.components import components
from entitystats.llm.queries import QUERIES


def plain_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, fps):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    distinct = sorted(parent)
    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                parent[find(a)] = find(b)
    least = {}
    for i, f in zip(ids, fps):
        least[find(f)] = min(i, least.get(find(f), i))
    return [least[find(f)] for f in fps]


def test_query_against_loops(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    fps = [plain_fingerprint(r.text) for r in docs]
    want = {(r.doc_id, f"{f:016x}", c) for r, f, c in zip(docs, fps, plain_components([r.doc_id for r in docs], fps))}
    got = QUERIES["op5_simhash_links"](spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(docs)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == want


def test_every_key_length_finds_the_same(spark, monkeypatch):
    import random

    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) for b in base for _ in range(6)})
    want = plain_components(range(len(fps)), fps)
    table = spark.createDataFrame([(S._signed(f),) for f in fps], "fp long")
    monkeypatch.setattr(S, "BLOCK", 3)
    for p in (5, 6, 8):
        monkeypatch.setattr(S, "positions", lambda n, p=p: p)
        roots = {r.fp & (2**64 - 1): r.root & (2**64 - 1) for r in S.linked_fingerprints(table).collect()}
        groups, expected = {}, {}
        for f, w in zip(fps, want):
            groups.setdefault(roots.get(f, f), set()).add(f)
            expected.setdefault(w, set()).add(f)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_long_chain(spark):
    edges = spark.range(200).selectExpr("id * 7 % 201 AS a", "(id + 1) * 7 % 201 AS b").repartition(7)
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {n: 0 for n in range(1, 201)}


def test_edge_cases(spark):
    rows = [(1, "a b c d", "x", 1), (2, "A B c d", "y", 2), (None, None, None, None), (7, "", "z", 3), (7, "", "z", 3), (9, "w " * 30000 + "end", "q", 4), (4, " \t\n", None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, row int")
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in S.linked_documents(docs).collect()}
    assert {(1, f"{plain_fingerprint('a b c d'):016x}", 1), (2, f"{plain_fingerprint('a b c d'):016x}", 1), (7, "0" * 16, 4), (None, "0" * 16, 4)} <= got
    left = S.one_of_each(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == [1, 4, 9]
    empty = docs.limit(0)
    assert S.linked_documents(empty).count() == 0 and S.one_of_each(empty).count() == 0
