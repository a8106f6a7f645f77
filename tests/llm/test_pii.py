"""Personal data: base spans against plain loops, redaction, odd inputs."""

import hashlib
import random
import re

from entitystats.llm import pii
from entitystats.llm.queries import QUERIES

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def good(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        total = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def base_spans(text):
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if good(k, m.group())] for k, p in PATTERNS.items()}


ODD = [
    "a@b.c_d@e.f and a@b.c@d.e x@y x@y.z.", "1.2.3.4.5.6.7.8 999.1.1.1 0255.0.0.1 1.2.3", "4111 1111 1111 1111, 4111-1111-1111-1112 12 34", "+1 (415) 555-0100 +12 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6",
    "é😀 4111111111111111 😀a@b.cd", None, "", "x" * 200000, "1" * 60000, "1 " * 30000, "a." * 30000, "+" * 3000 + "1" * 50, "(" * 5000, "a@b.c " * 200, "password=ab12cd34ef56ab78cd mail me: joe (at) site (dot) org",
]


def check(rows, texts):
    for r in rows:
        want = base_spans(texts[r.doc_id])
        assert {k: r[f"n_{k}"] for k in PATTERNS} == {k: len(v) for k, v in want.items()}, r.doc_id
        listed = [f"{k}:{a}:{b}" for k in PATTERNS for a, b in want[k]]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        spans = [s for s in r.spans.split(",") if s]
        assert set(listed) <= set(spans)
        assert spans == sorted(spans, key=lambda s: (pii.KINDS.index(s.split(":")[0]), int(s.split(":")[1])))


def test_query_against_loops(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = QUERIES["op6_boosted_pii"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(texts)
    check(rows, texts)


def test_odd_texts(spark):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(ODD)], "doc_id long, text string, spans string, kind int")
    rows = pii.personal_spans(docs).collect()
    check(rows, dict(enumerate(ODD)))
    assert pii.personal_spans(docs.limit(0)).count() == 0


def test_redaction(spark):
    docs = spark.createDataFrame([(i, t, len(t or ""), "s") for i, t in enumerate(ODD)], "doc_id long, text string, n_chars long, spans string")
    got = {r.doc_id: r for r in pii.redacted(docs).collect()}
    assert pii.redacted(docs).columns == docs.columns
    for i, text in enumerate(ODD):
        if text is None or not any(base_spans(text).values()):
            continue
        assert not any(base_spans(got[i].text).values()), (i, got[i].text[:200])
        assert got[i].n_chars == len(got[i].text)
    assert got[5].text is None and got[6].text == "" and got[7].text == ODD[7]
    assert got[4].text == "é😀 [CARD] 😀[EMAIL]"


def test_added_spans(spark):
    """Keys of any length and with the usual marks after a cue, never a number that fails its check, no overlaps."""
    rng = random.Random(4)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    key = lambda n: "".join(rng.choice("ABCDEFabcdef0123456789-/+_") for _ in range(n - 2))
    texts = [f"words before, token: {hexes(32)} and after" for _ in range(60)] + [f"ordinary {hexes(20)} reference {i}" for i in range(60)]
    texts += [f"api_key = A{key(60)}9== then" for _ in range(60)] + ["call tel 415-555-0100 now, card 4111111111111112 +1 (743) 555-3824"] * 30
    texts += [f"secret={hexes(128)}", f"password: {'x' * 100}1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for table in (docs, docs.where("doc_id % 3 = 0 OR doc_id >= 210")):
        rows = pii.personal_spans(table).collect()
        check(rows, texts)
        for r in rows:
            spans = sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in r.spans.split(",") if s))
            assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
            assert not any(k == "card" for _, _, k in spans)
        found = {r.doc_id: r.spans for r in rows}
        assert found[210] == f"secret:7:{7 + 128}" and found[211] == "secret:10:111"
        if 0 in found:
            assert "secret:21:53" in found[0]
