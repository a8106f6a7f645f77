"""Text layouts the first checks did not make."""

import datetime as dt
import hashlib
import json

from pyspark.sql import functions as F

from entitystats.functions import dates, text, vectors


def test_layouts(spark):
    day, evening = dt.datetime(2025, 11, 12), dt.datetime(2025, 11, 12, 19, 30)
    want = {
        "2025/11/12": day, "12 Nov 2025": day, "November 12 2025": day, "Nov 12, 2025": day, "Wed, 12 Nov 2025 19:30:00 GMT": evening,
        "Nov 12, 2025 7:30 PM": evening, "11/12/2025 19:30": evening, "2025-11-12T19:30:00Z": evening, "20251112": day, "soon": None,
    }
    rows = spark.createDataFrame([(k,) for k in want], "t string").select("t", dates.parse_timestamp(F.col("t")).alias("ts")).collect()
    assert {r.t: r.ts for r in rows} == want


def test_quoted_items(spark):
    want = {"['a, b', 'c']": ["a, b", "c"], '["x","y, z"]': ["x", "y, z"], "[a, b]": ["a", "b"], "['it''s', b]": ["it''s", "b"], "[]": [], "a; b": ["a", "b"]}
    rows = spark.createDataFrame([(k,) for k in want], "t string").select("t", text.list_field(F.col("t")).alias("got")).collect()
    assert {r.t: r.got for r in rows} == want


def test_checksum_beyond_ascii(spark):
    names = [["prénom", "a"], ["plain"], ["😀\"x"]]
    rows = spark.createDataFrame([(n,) for n in names], "n array<string>").select("n", vectors.names_checksum(F.col("n")).alias("c")).collect()
    for r in rows:
        assert r.c == hashlib.sha256(json.dumps(list(r.n), separators=(",", ":")).encode()).hexdigest()
