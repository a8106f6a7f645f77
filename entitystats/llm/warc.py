"""A content-addressed WARC archive.

Payloads are stored once each, under their SHA-256. Record headers, exactly as
they stand in the WARC file, are kept in a table of their own with the digest
of their payload. A join rebuilds the original records, and every payload read
back is hashed again. Among records with equal payloads of at least
``least_bytes`` bytes, the one with the largest page id is the response and the
others are revisits that name it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from entitystats.llm.common import any_text, col
from entitystats.session import scratch_folder

PAYLOADS = "digest string, payload binary, size long, bearer long"
HEADERS = "digest string, header string"
BREAK = "\r\n"
#: Records carry this time; pages have none.
DATE = "2000-01-01T00:00:00Z"


def _record_id(page: Column) -> Column:
    """A name-based UUID of a page id."""
    h = F.md5(F.concat(F.lit("page "), F.coalesce(page.cast("string"), F.lit("none"))).cast("binary"))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-"), part(13, 4), F.lit("-"), part(17, 4), F.lit("-"), part(21, 12), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """``Name: value`` and a line break; nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(BREAK)), F.lit(""))


def write_archive(pages: DataFrame, folder: str, least_bytes: int = 1000, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Write ``folder/payloads`` and ``folder/headers``.

    A null payload is empty; a null url or id leaves its header line out, line
    breaks inside a url are percent-encoded. Null ids sort below all others:
    of equal payloads under null ids alone, each is a response. Repeated rows
    are records each; rows that share the largest id are responses all. Other
    columns are not read; an empty table writes empty tables.
    """
    raw = F.encode(any_text(payload_col), "UTF-8")
    rows = pages.select(col(id_col).cast("long").alias("page_id"), col(url_col).cast("string").alias("url"), raw.alias("payload"))
    stored = (
        rows.withColumn("digest", F.sha2("payload", 256))
        .groupBy("digest").agg(F.first("payload").alias("payload"), F.first(F.octet_length("payload")).cast("long").alias("size"), F.max("page_id").alias("bearer"))
    )
    stored.write.parquet(f"{folder}/payloads")
    kept = pages.sparkSession.read.schema(PAYLOADS).parquet(f"{folder}/payloads").select("digest", "bearer")
    thin = rows.select("page_id", "url", F.sha2("payload", 256).alias("digest"), F.sha1("payload").alias("sha1"), F.octet_length("payload").alias("size"))
    both = thin.join(kept, "digest")
    revisit = (F.col("size") >= least_bytes) & F.col("bearer").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("bearer"))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    header = F.concat(
        F.lit(f"WARC/1.1{BREAK}"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _record_id(F.col("page_id"))),
        _line("WARC-Date", F.lit(DATE)),
        _line("WARC-Target-URI", url),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _line("WARC-Page-ID", F.col("page_id").cast("string")),
        _line("WARC-Refers-To", F.when(revisit, _record_id(F.col("bearer")))),
        _line("WARC-Refers-To-Page-ID", F.when(revisit, F.col("bearer").cast("string"))),
        _line("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        _line("Content-Type", F.lit("text/html; charset=UTF-8")),
        _line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("size")).cast("string")),
    )
    both.select("digest", header.alias("header")).write.parquet(f"{folder}/headers")


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """(header, payload): each record's header with the full payload it stands for.

    Fails if a stored payload does not have the digest it is stored under.
    """
    payloads = spark.read.schema(PAYLOADS).parquet(f"{folder}/payloads").select("digest", "payload")
    sound = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("digest"))).cast("binary"))
    checked = payloads.select("digest", sound.alias("payload"))
    return spark.read.schema(HEADERS).parquet(f"{folder}/headers").join(checked, "digest").select("header", "payload")


def record_bytes(records: DataFrame) -> DataFrame:
    """The records as they stand in a WARC file, one ``record`` a row; revisits have no body."""
    body = F.when(F.col("header").contains(f"{BREAK}WARC-Type: revisit{BREAK}"), F.lit(b"")).otherwise(F.col("payload"))
    gap = F.encode(F.lit(BREAK), "UTF-8")
    return records.select(F.concat(F.encode("header", "UTF-8"), gap, body, gap, gap).alias("record"))


def field(name: str) -> Column:
    """A header field of a record; null where the header has no such line."""
    found = F.regexp_extract("header", rf"\r\n{name}: ([^\r\n]*)", 1)
    return F.when(F.col("header").contains(f"{BREAK}{name}: "), found)


def archived_pages(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """Archive the pages in a new shared folder, read the records back and describe them."""
    spark = pages.sparkSession
    folder = scratch_folder(spark, "warc")
    write_archive(pages, folder, least_bytes)
    return read_archive(spark, folder).select(
        field("WARC-Page-ID").cast("long").alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"),
        field("WARC-Type").alias("record_type"),
        field("WARC-Refers-To-Page-ID").cast("long").alias("refers_to"),
    )
