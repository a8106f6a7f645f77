"""The corpus operators as named queries, each with the SQL that checks it where SQL can."""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Path of the tokenizer file the token operators use by default.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _query(name: str, table: str, sql: str | None = None):
    def register(fn: Callable[[DataFrame], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet"))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


_JUMPS = """
    SELECT doc_id, {n} AS shards, 0::BIGINT AS b,
           ((CASE WHEN doc_id < 0 THEN doc_id::HUGEINT + 18446744073709551616 ELSE coalesce(doc_id, 0)::HUGEINT END * 2862933555777941757 + 1) % 18446744073709551616)::HUGEINT AS s
    FROM (SELECT DISTINCT doc_id FROM documents)
"""
_SHARDS_SQL = f"""
    WITH RECURSIVE jumps AS (
        ({_JUMPS.format(n=16)} UNION ALL {_JUMPS.format(n=17)})
        UNION ALL
        SELECT doc_id, shards, j, ((s * 2862933555777941757 + 1) % 18446744073709551616)::HUGEINT
        FROM (SELECT *, floor((b + 1) * (2147483648.0::DOUBLE / ((s // 8589934592)::DOUBLE + 1)))::BIGINT AS j FROM jumps)
        WHERE j < shards
    ),
    shards AS (SELECT doc_id, max(b) FILTER (shards = 16) AS shard, max(b) FILTER (shards = 17) AS grown_shard FROM jumps GROUP BY doc_id),
    crc_table AS (
        SELECT list(c ORDER BY i) AS t FROM (
            SELECT i, list_reduce(list_prepend(i::UBIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384::UBIGINT, c >> 1) ELSE c >> 1 END) AS c
            FROM range(256) r(i)
        )
    ),
    sums AS (
        SELECT doc_id, coalesce(text, '') AS body,
               xor(4294967295::UBIGINT, list_reduce(
                   list_prepend(4294967295::UBIGINT, list_transform(range(1, 2 * strlen(coalesce(text, '')) + 1, 2), lambda k: ('0x' || substr(hex(encode(coalesce(text, ''))), k, 2))::UBIGINT)),
                   lambda c, b: xor(t[((xor(c, b) & 255) + 1)::BIGINT], c >> 8)))::BIGINT AS text_crc32
        FROM documents, crc_table
    )
    SELECT s.doc_id, (strlen(s.body) + 1)::BIGINT AS size, s.text_crc32, 'key' AS law, h.shard::INTEGER AS shard,
           (row_number() OVER (PARTITION BY h.shard ORDER BY s.doc_id NULLS FIRST, strlen(s.body), s.text_crc32) - 1)::BIGINT AS slot, h.grown_shard::INTEGER AS grown_shard
    FROM sums s JOIN shards h ON s.doc_id IS NOT DISTINCT FROM h.doc_id
"""


@_query("op1_jump_shards", "documents", _SHARDS_SQL)
def op1_jump_shards(docs: DataFrame) -> DataFrame:
    from entitystats.llm.sharding import assign_shards

    return assign_shards(docs, 16)


_WARC_SQL = """
    WITH hashed AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest, coalesce(html, '') AS html FROM pages),
    bearers AS (SELECT html, max(page_id) AS bearer FROM hashed WHERE n >= 1000 GROUP BY html)
    SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
           CASE WHEN bearer IS NOT NULL AND bearer IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN bearer IS DISTINCT FROM page_id THEN bearer END AS refers_to
    FROM hashed LEFT JOIN bearers USING (html)
"""


@_query("op2_content_addressed_warc", "pages", _WARC_SQL)
def op2_content_addressed_warc(pages: DataFrame) -> DataFrame:
    from entitystats.llm.warc import archived_pages

    return archived_pages(pages, least_bytes=1000)


@_query("op3_cross_parsing_language", "documents")
def op3_cross_parsing_language(docs: DataFrame) -> DataFrame:
    from entitystats.llm.language import predicted_languages

    return predicted_languages(docs)


@_query("op4_multiprobe_search", "embeddings")
def op4_multiprobe_search(vectors: DataFrame) -> DataFrame:
    from entitystats.llm.nearest import nearest

    return nearest(vectors, 20, queries="vec_id % 20 = 0")


@_query("op5_simhash_links", "documents")
def op5_simhash_links(docs: DataFrame) -> DataFrame:
    from entitystats.llm.simhash import linked_documents

    return linked_documents(docs)


@_query("op6_boosted_pii", "documents")
def op6_boosted_pii(docs: DataFrame) -> DataFrame:
    from entitystats.llm.pii import personal_spans

    return personal_spans(docs)


@_query("op7_addressable_tokens", "documents")
def op7_addressable_tokens(docs: DataFrame) -> DataFrame:
    from entitystats.llm.token_store import stored_tokens

    return stored_tokens(docs, TOKENIZER, end_id=2)


@_query("op8_tree_boosted_html", "pages")
def op8_tree_boosted_html(pages: DataFrame) -> DataFrame:
    from entitystats.llm.html_text import extracted

    return extracted(pages)


@_query("op9_swap_packing", "documents")
def op9_swap_packing(docs: DataFrame) -> DataFrame:
    from entitystats.llm.packing import pack

    return pack(docs, TOKENIZER, capacity=1024, end_id=2)


def op10_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from entitystats.llm.decontaminate import contaminated

    base = sf_dir.rstrip("/")
    return contaminated(spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/benchmark.parquet"))


QUERIES["op10_cgk_decontamination"] = op10_cgk_decontamination


@_query("op11_concat_and_cut", "documents")
def op11_concat_and_cut(docs: DataFrame) -> DataFrame:
    from entitystats.llm.concatenation import concatenated

    return concatenated(docs, TOKENIZER, capacity=2048, end_id=1)


@_query("op12_integer_weight_repair", "conversations")
def op12_integer_weight_repair(rows: DataFrame) -> DataFrame:
    from entitystats.llm.repair import damaged, repair_reports

    return repair_reports(damaged(rows), copies_col="copies")


def repeated_words(doc_id: int | None, words: list[str]) -> list[str]:
    """The words of a document; where the checksum of its id ends in 0, made periodic from some word on. A null id changes nothing."""
    h = zlib.crc32(str(doc_id).encode())
    n = len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + list(itertools.islice(itertools.cycle(words[a : a + p]), n - a))


@_query("op13_block_convolution_runs", "documents")
def op13_block_convolution_runs(docs: DataFrame) -> DataFrame:
    from entitystats.llm.periodic import periodic_runs

    found = periodic_runs(docs, rewrite=repeated_words)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("shorter"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    length, period = F.col("best.length"), -F.col("best.shorter")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.before")).alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
