"""Packing by concatenation: documents laid end to end and cut into fixed windows.

Two passes. The first encodes every document where it is read and writes its
ids, with the number of ids before it in its partition. A prefix sum over the
partition totals, one row a partition, then gives every document its place in
the whole run of ids, so the second pass cuts windows in any order and on any
executor, without a shuffle of ids. Each window keeps boundary records: which
document's ids lie where. A window that begins in one partition and ends in
another comes as two fragments; ``sequences`` joins these.

All windows are full but for what is left at the end of the corpus. That rest
is cut at falling powers of two, lengths that need no padding, so nothing is
padded at all; ``powers=False`` leaves it as one short window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entitystats.llm.common import any_text, col
from entitystats.llm.tokens import ID_TYPE, encoder
from entitystats.session import settled, settled_small

ENCODED_SCHEMA = "part int, inside long, doc_id long, doc_tokens long, ids binary"
_PIECE = pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("offset", pa.int64())])
FRAGMENT_SCHEMA = (
    "sequence_id long, offset long, size long, ids binary, "
    "pieces array<struct<doc_id:long,start:long,length:long,doc_tokens:long,offset:long>>"
)
#: Fragments that leave a task together.
BATCH = 512
#: Bytes of ids that leave a task together.
BATCH_BYTES = 8 << 20


def _encoded(path: str, end_id: int | None):
    tail = b"" if end_id is None else np.array([end_id], ID_TYPE).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, enc, inside = TaskContext.get().partitionId(), encoder(path), 0
        for batch in batches:
            held: list[tuple] = []
            weight = 0
            for at in range(batch.num_rows):
                ids = enc.encode(batch.column(1)[at].as_py()) + tail
                held.append((inside, batch.column(0)[at].as_py(), len(ids) // 4, ids))
                inside += len(ids) // 4
                weight += len(ids)
                if weight > BATCH_BYTES or at == batch.num_rows - 1:
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
                    columns = [pa.array(x, k) for x, k in zip(zip(*held), kinds)]
                    yield pa.RecordBatch.from_arrays([pa.array([part] * len(held), pa.int32()), *columns], names=["part", "inside", "doc_id", "doc_tokens", "ids"])
                    held, weight = [], 0

    return run


def placed(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 1) -> DataFrame:
    """Every document's ids with ``at``, the number of ids before it in the corpus, and ``total``, that of all.

    The ids are written once; the totals of the partitions are summed from that
    table, so a task that is run again changes nothing.
    """
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), any_text(text_col).alias("text"))
    table = settled(rows.mapInArrow(_encoded(tokenizer_path, end_id), ENCODED_SCHEMA))
    totals = table.groupBy("part").agg(F.sum("doc_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"), F.sum("n").over(Window.partitionBy()).alias("total"))
    return table.join(settled_small(offsets), "part").select((F.col("ahead") + F.col("inside")).alias("at"), "total", "doc_id", "doc_tokens", "ids")


def window_at(at: int, total: int, capacity: int, powers: bool = True) -> tuple[int, int, int]:
    """Number, first id and size of the window that holds id ``at`` of a corpus of ``total`` ids."""
    number, rest = at // capacity, total % capacity
    first = number * capacity
    if first + capacity <= total:
        return number, first, capacity
    if not powers:
        return number, first, rest
    while True:
        size = 1 << (rest.bit_length() - 1)
        if at < first + size:
            return number, first, size
        number, first, rest = number + 1, first + size, rest - size


def _fragments(capacity: int, powers: bool):
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(_PIECE))

    def emit(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held), kinds)], names=["sequence_id", "offset", "size", "ids", "pieces"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        number = first = size = 0
        begin = end = -1  # the ids gathered for the open window
        ids: list[bytes] = []
        records: list[dict] = []

        def close() -> None:
            if records:
                held.append((number, begin - first, size, b"".join(ids), list(records)))
                ids.clear()
                records.clear()

        for batch in batches:
            for i in range(batch.num_rows):
                at, total, doc, length = (batch.column(c)[i].as_py() for c in range(4))
                raw, done = memoryview(batch.column(4)[i].as_buffer()), 0
                while done < length:
                    if at + done != end or end >= first + size:
                        close()
                        number, first, size = window_at(at + done, total, capacity, powers)
                        begin = at + done
                    take = min(length - done, first + size - at - done)
                    ids.append(bytes(raw[4 * done : 4 * (done + take)]))
                    records.append({"doc_id": doc, "start": done, "length": take, "doc_tokens": length, "offset": at + done - first})
                    done += take
                    end = at + done
                    if len(held) >= BATCH:
                        yield emit(held)
                        held = []
        close()
        if held:
            yield emit(held)

    return run


def fragments(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 1, powers: bool = True) -> DataFrame:
    """The parts of windows as they were cut: sequence_id, offset, size of the window, ids and boundary records.

    Without an end id a document without tokens lies in no window.
    """
    rows = placed(docs, tokenizer_path, id_col, text_col, end_id)
    return rows.mapInArrow(_fragments(capacity, powers), FRAGMENT_SCHEMA)


def sequences(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 1, powers: bool = True) -> DataFrame:
    """Every window once: sequence_id, its ids (little-endian, 32 bits) and its boundary records in order.

    Only fragments at the borders of partitions are shuffled.
    """
    cut = settled(fragments(docs, tokenizer_path, capacity, id_col, text_col, end_id, powers))
    whole = F.length("ids") == 4 * F.col("size")
    parts = cut.where(~whole).groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids", "pieces"))).alias("of"))
    joined = parts.select("sequence_id", F.aggregate(F.transform("of", lambda p: p["ids"]), F.lit(b""), lambda a, b: F.concat(a, b)).alias("ids"), F.flatten(F.transform("of", lambda p: p["pieces"])).alias("pieces"))
    return cut.where(whole).select("sequence_id", "ids", "pieces").unionByName(joined)


def _windows(capacity: int, powers: bool) -> Column:
    """The windows that a placed row's ids lie in, as structs of number, first id and size, for SQL."""
    at, end = F.col("at"), F.col("at") + F.col("doc_tokens")
    rest = F.col("total") % capacity
    full = F.col("total") - rest
    window = lambda number, first, size: F.struct(number.cast("long").alias("number"), first.cast("long").alias("first"), size.cast("long").alias("size"))
    whole = F.transform(
        F.sequence(F.floor(at / capacity), F.floor((F.least(end, full) - 1) / capacity)), lambda k: window(k, k * capacity, F.lit(capacity))
    )
    if powers:
        parts = []
        for bit in range(capacity.bit_length() - 1, -1, -1):
            above = F.shiftright(rest, bit + 1)
            parts.append(F.when(F.shiftright(rest, bit) % 2 == 1, window(full / capacity + F.bit_count(above), full + above * (2 << bit), F.lit(1 << bit))))
    else:
        parts = [F.when(rest > 0, window(full / capacity, full, rest))]
    none = F.array().cast("array<struct<number:long,first:long,size:long>>")
    tail = F.filter(F.array_compact(F.array(*parts)), lambda w: (w["first"] < end) & (w["first"] + w["size"] > at))
    return F.concat(F.when((at < full) & (end > at), whole).otherwise(none), F.when(end > full, tail).otherwise(none))


def concatenated(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 1, powers: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's pieces are consecutive; each lies in one window. A null or
    empty text is the end id alone, ids may be null, repeated rows are laid one
    after another like any others, an empty table gives no rows, and a text of
    any length is cut into as many pieces as it takes. Columns other than the
    two named are not read. The order of documents is that of the table's
    partitions.
    """
    rows = placed(docs, tokenizer_path, id_col, text_col, end_id)
    at, n = F.col("at"), F.col("doc_tokens")

    def piece(w: Column) -> Column:
        start = F.greatest(w["first"] - at, F.lit(0))
        length = F.least(w["first"] + w["size"] - at, n) - start
        return F.struct(
            F.col("doc_id"), start.alias("start"), length.alias("length"),
            F.crc32(F.substring(F.col("ids"), (4 * start + 1).cast("int"), (4 * length).cast("int"))).alias("ids_crc32"),
            n.alias("doc_tokens"), w["number"].alias("sequence_id"), (at + start - w["first"]).alias("offset"),
        )

    return rows.select(F.inline(F.transform(_windows(capacity, powers), piece)))
