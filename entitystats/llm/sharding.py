"""Shards by jump consistent hashing, with row numbers inside each shard.

The shard follows from the document id and the number of shards alone. With one
shard more, a row either stays or goes to the new shard. Rows are numbered
through one range shuffle on (shard, id); only one count per written partition
and shard is needed to number across partitions, so a shard may be of any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entitystats.llm.common import any_text, col
from entitystats.session import settled

#: Multiplier of the generator behind jump hashing (a fixed value of the method).
STEP = 2862933555777941757
_NEXT = f"CAST(({{s}} * {STEP}BD + 1BD) % {1 << 64}BD AS DECIMAL(20,0))"
_JUMP = "CAST(floor((a.b + 1) * (2147483648.0D / ((a.s div 8589934592BD) + 1))) AS BIGINT)"


def jump_shard(key: str, shards: int) -> Column:
    """The shard, out of ``shards``, of a column of 64-bit keys; a null key counts as 0.

    The state is a decimal of twenty digits taken modulo 2^64, as an unsigned
    word. Every jump goes forward, so ``shards - 1`` steps suffice; steps after
    the last jump change nothing.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    word = f"pmod(coalesce(CAST({key} AS DECIMAL(20,0)), 0BD), {1 << 64}BD)"
    start = f"named_struct('s', {_NEXT.format(s=word)}, 'b', 0L)"
    if shards == 1:
        return F.lit(0)
    return F.expr(
        f"aggregate(sequence(1, {shards - 1}), {start}, "
        f"(a, i) -> IF({_JUMP} < {shards}, named_struct('s', {_NEXT.format(s='a.s')}, 'b', {_JUMP}), a), a -> CAST(a.b AS INT))"
    )


def assign_shards(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard, place in the shard, and the shard with one shard more, for every row.

    ``size`` is the text's UTF-8 length plus 1 and ``text_crc32`` its checksum;
    a null text counts as no bytes. ``slot`` numbers a shard's rows from 0 by
    id (nulls first), size and checksum. Repeated rows keep a row and a slot
    each; they may lie in several partitions. An empty table gives no rows;
    other columns are not read.
    """
    raw = F.encode(any_text(text_col), "UTF-8")
    keyed = settled(
        docs.select(col(id_col).cast("long").alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
        .select("*", jump_shard("doc_id", shards).alias("shard"), jump_shard("doc_id", shards + 1).alias("grown_shard"))
    )
    order = [F.asc("shard"), F.asc_nulls_first("doc_id"), F.asc("size"), F.asc("text_crc32")]
    placed = settled(
        keyed.withColumn("row", F.monotonically_increasing_id())
        .repartitionByRange(*order, F.asc("row"))
        .sortWithinPartitions(*order)
        .select("doc_id", "size", "text_crc32", "shard", "grown_shard", F.monotonically_increasing_id().alias("place"))
        .withColumn("part", F.shiftright("place", 33))
    )
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = (
        placed.groupBy("part", "shard").agg(F.min("place").alias("first"), F.count("*").alias("rows"))
        .select("part", "shard", (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    )
    return placed.join(F.broadcast(begins), ["part", "shard"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("place") + F.col("shift")).alias("slot"), "grown_shard"
    )
