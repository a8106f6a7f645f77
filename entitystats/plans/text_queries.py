"""Keyword flags, JSON in texts, vectors."""

from pyspark.sql import functions as F

from entitystats.functions import text as X
from entitystats.functions import vectors as VX
from entitystats.operators import similarity as SIM
from entitystats.plans.registry import query
from entitystats.plans.rounding import rounded
from entitystats.session import settled_small


def _any(words):
    return " OR ".join(f"contains(lower(text), '{w}')" for w in words)


@query(
    "keyword_flags",
    f"""
    SELECT doc_id, CASE WHEN {_any(X.INJURY_WORDS)} THEN -1.0::DOUBLE ELSE 0 END AS injury_sentiment, CASE WHEN {_any(X.MORALE_WORDS)} THEN 1.0::DOUBLE ELSE 0 END AS morale_score,
           CASE WHEN {_any(X.MOTIVATION_WORDS)} THEN 1.0::DOUBLE ELSE 0 END AS motivation, CASE WHEN {_any(X.COACHING_WORDS)} THEN 1.0::DOUBLE ELSE 0 END AS coaching_change_impact
    FROM documents
    """,
)
def keyword_flags(t):
    return t.documents.select("doc_id", *[c.alias(n) for n, c in X.keyword_flags(F.col("text")).items()])


@query(
    "qualitative_fallback",
    f"""
    SELECT doc_id, CASE WHEN {_any(X.INJURY_WORDS)} THEN 'questionable' ELSE 'healthy' END AS injury_status, CASE WHEN {_any(X.INJURY_WORDS)} THEN -0.5::DOUBLE ELSE 0 END AS news_sentiment,
           CASE WHEN {_any(X.MOTIVATION_WORDS)} THEN 1.0::DOUBLE ELSE 0.5 END AS motivation, 50 AS morale_score, 0::DOUBLE AS trade_sentiment
    FROM documents
    """,
)
def qualitative_fallback(t):
    return t.documents.select("doc_id", *[c.alias(n) for n, c in X.qualitative_fallback(F.col("text")).items()])


@query(
    "json_in_text",
    """
    SELECT event_id, CASE WHEN event_type = 'view' THEN 'out' ELSE 'healthy' END AS injury_status, k AS morale_score,
           CASE WHEN event_type = 'error' THEN 3.5::DOUBLE ELSE 0 END AS news_sentiment, 0.5::DOUBLE AS motivation, event_type <> 'error' AS is_valid
    FROM (SELECT event_id, event_type, CASE WHEN CAST(json_extract(props, '$.k') AS INTEGER) = 0 THEN 50 ELSE CAST(json_extract(props, '$.k') AS INTEGER) END AS k FROM events)
    """,
)
def json_in_text(t):
    """An answer with an object somewhere inside; one type gives a sentiment out of range."""
    kind = F.col("event_type")
    written = F.concat(
        F.lit('Sure: {"morale": '), F.get_json_object("props", "$.k"),
        F.when(kind == "view", ', "injury": "out"').otherwise(""), F.when(kind == "error", ', "sentiment": 3.5').otherwise(""), F.lit("} - done"),
    )
    parts = X.qualitative_fields(written)
    return t.events.select("event_id", *[parts[n].alias(n) for n in ("injury_status", "morale_score", "news_sentiment", "motivation", "is_valid")])


@query(
    "morale_units",
    "SELECT p_partkey, round(3.14159e-9 + greatest(-1, least(1, (p_size * 3 - 50) / 50.0)), 6)::DOUBLE AS morale FROM part",
)
def morale_units(t):
    return rounded(t.part.select("p_partkey", X.morale_unit(F.col("p_size") * 3).alias("morale")))


@query(
    "news_by_source",
    """
    SELECT source, lang, doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) - 1 AS position, md5(text) AS digest FROM documents WHERE length(text) > 0
    """,
)
def news_by_source(t):
    """Texts of one source and language in the order of their ids."""
    from entitystats.sources.files import ordered_texts

    out = ordered_texts(t.documents, ["source", "lang"], "text", "doc_id")
    return out.select("source", "lang", "doc_id", "position", F.md5("text").alias("digest"))


@query(
    "flags_by_source",
    f"""
    SELECT source AS name, CASE WHEN bool_or({_any(X.INJURY_WORDS)}) THEN -1.0::DOUBLE ELSE 0 END AS injury_sentiment, CASE WHEN bool_or({_any(X.MORALE_WORDS)}) THEN 1.0::DOUBLE ELSE 0 END AS morale_score,
           CASE WHEN bool_or({_any(X.MOTIVATION_WORDS)}) THEN 1.0::DOUBLE ELSE 0 END AS motivation, CASE WHEN bool_or({_any(X.COACHING_WORDS)}) THEN 1.0::DOUBLE ELSE 0 END AS coaching_change_impact
    FROM documents GROUP BY source
    """,
)
def flags_by_source(t):
    """Documents as news files named after their source."""
    from entitystats.sources.files import corpus_flags

    corpus = t.documents.select(F.col("source").alias("key"), F.col("doc_id").cast("string").alias("path"), "text")
    return corpus_flags(t.documents.select(F.col("source").alias("name")).distinct(), "name", corpus)


_CENTRES = """
    WITH q AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS v FROM embeddings, range(1, 65) r(i) GROUP BY label, i),
    c AS (SELECT label, list(v ORDER BY i) AS v FROM q GROUP BY label),
    s AS (SELECT label, vec_id, list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), v) AS score FROM embeddings, c),
    r AS (SELECT label, vec_id, score, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM s)
"""
_CENTRES = _CENTRES.replace("SELECT label, vec_id, list_cosine", "SELECT c.label AS label, vec_id, list_cosine")


def _centres(t):
    """Mean vector of every label: the queries grow with the labels, not with a chosen few."""
    flat = t.embeddings.select("label", F.posexplode("embedding").alias("i", "x"))
    means = flat.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("v"))
    return means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("query"))


@query("nearest_to_centres", _CENTRES + "SELECT label, vec_id, round(3.14159e-9 + score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5")
def nearest_to_centres(t):
    return rounded(SIM.top_similar(t.embeddings, _centres(t), 5, "vec_id", "embedding", "label"))


@query(
    "similarity_summary",
    _CENTRES + "SELECT label, round(3.14159e-9 + max(score), 6) AS max_similarity, round(3.14159e-9 + avg(score), 6) AS avg_topk_similarity FROM r WHERE rank <= 3 GROUP BY label",
)
def similarity_summary(t):
    return rounded(SIM.similarity_summary(SIM.top_similar(t.embeddings, _centres(t), 3, "vec_id", "embedding", "label"), "label"))


@query(
    "cosine_to_label_centre",
    _CENTRES + "SELECT s.vec_id, round(3.14159e-9 + s.score, 6) AS cosine FROM s JOIN embeddings e ON e.vec_id = s.vec_id AND e.label = s.label",
)
def cosine_to_label_centre(t):
    rows = t.embeddings.join(settled_small(_centres(t)), "label")
    return rounded(rows.select("vec_id", VX.cosine(F.col("embedding"), F.col("query")).alias("cosine")))


@query("text_vectors")
def text_vectors(t):
    """Seeded vectors of whole texts, summarised by their first two numbers."""
    v = t.documents.select("doc_id", VX.text_vector(F.col("text"), 8).alias("v"))
    return v.select("doc_id", F.size("v").alias("dim"), F.col("v")[0].alias("v0"), F.col("v")[1].alias("v1"))


@query(
    "new_items_indexed",
    "SELECT CAST(doc_id AS VARCHAR) AS source_id, 8 AS dim FROM documents WHERE length(text) > 0 AND doc_id NOT IN (SELECT doc_id FROM labels)",
)
def new_items_indexed(t):
    """Unlabelled documents are the ones not indexed yet."""
    items = t.documents.select(F.col("doc_id").cast("string").alias("id"), "text")
    index = t.labels.select(F.col("doc_id").cast("string").alias("source_id"))
    return SIM.index_new(items, index, dim=8).select("source_id", F.size("embedding").alias("dim"))


@query(
    "feature_checksums",
    "SELECT p_partkey, sha256('[\"' || replace(p_name, ' ', '\",\"') || '\"]') AS checksum FROM part",
)
def feature_checksums(t):
    return t.part.select("p_partkey", VX.names_checksum(F.split("p_name", " ")).alias("checksum"))
