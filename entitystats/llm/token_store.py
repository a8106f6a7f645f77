"""Token ids in files of directly addressable codes.

A segment holds the ids of consecutive documents. Ids are split into chunks of
eight bits, lowest first. Level 0 has the first chunk of every id; a
continuation bitmap marks the ids that have another chunk, which lies on the
next level at the position given by the number of marks before it. A rank
directory stores that number for every 512th mark, so any id is read with a few
additions and no decoding of its neighbours.

A segment's bytes, all numbers little-endian: ``DAC1``, the number of ids (u8),
the number of levels (u4); then for each level its length (u8), the chunk
bytes, the bitmap (one bit an id, low bit first) and the directory (u8 each).

Segments are rows of Parquet files that Spark writes below one folder, in
ascending order of document id, each with its documents' ids and lengths.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from entitystats.llm.common import any_text, col
from entitystats.llm.tokens import ID_TYPE, encoder
from entitystats.session import scratch_folder, settled

MAGIC = b"DAC1"
RANK_STEP = 512
#: A segment is closed at the first document end beyond this many ids.
SEGMENT_IDS = 1 << 18
SEGMENT_SCHEMA = "part int, seq int, base long, total long, doc_ids array<long>, lengths array<long>, codes binary"


def encode_ids(ids: np.ndarray) -> bytes:
    """The segment bytes of an array of ids."""
    rest = np.asarray(ids, np.uint32)
    levels = []
    while True:
        more = rest > 255
        ends = np.arange(0, len(rest) + RANK_STEP, RANK_STEP).clip(max=len(rest))
        ranks = np.concatenate(([0], np.cumsum(more, dtype=np.uint64)))[ends]
        levels.append(b"".join((struct.pack("<Q", len(rest)), rest.astype(np.uint8).tobytes(), np.packbits(more, bitorder="little").tobytes(), ranks.astype("<u8").tobytes())))
        rest = rest[more] >> 8
        if not len(rest):
            break
    return b"".join((MAGIC, struct.pack("<QI", len(ids), len(levels)), *levels))


class Segment:
    """Reads a segment's bytes; ``seg[i]`` is one id, ``seg.ids()`` are all."""

    def __init__(self, codes: bytes) -> None:
        if codes[:4] != MAGIC:
            raise ValueError("these bytes are no segment of directly addressable codes")
        self.size, depth = struct.unpack_from("<QI", codes, 4)
        self.levels, at = [], 16
        for _ in range(depth):
            (n,) = struct.unpack_from("<Q", codes, at)
            chunks = np.frombuffer(codes, np.uint8, n, at + 8)
            bits = np.frombuffer(codes, np.uint8, -(-n // 8), at + 8 + n)
            at += 8 + n + len(bits)
            ranks = np.frombuffer(codes, "<u8", -(-n // RANK_STEP) + 1, at)
            at += 8 * len(ranks)
            self.levels.append((chunks, bits, ranks))

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.size:
            raise IndexError(i)
        value = 0
        for depth, (chunks, bits, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * depth)
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // RANK_STEP
            before = np.unpackbits(bits[block * RANK_STEP // 8 : (i >> 3) + 1], bitorder="little")[: i - block * RANK_STEP]
            i = int(ranks[block]) + int(before.sum())
        return value

    def ids(self) -> np.ndarray:
        out = np.zeros(self.size, np.uint32)
        place = np.arange(self.size)
        for depth, (chunks, bits, _) in enumerate(self.levels):
            out[place] |= chunks.astype(np.uint32) << np.uint32(8 * depth)
            place = place[np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)]
        return out.astype(ID_TYPE)


def _segments(path: str, end_id: int | None, limit: int):
    tail = b"" if end_id is None else np.array([end_id], ID_TYPE).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, enc = TaskContext.get().partitionId(), encoder(path)
        seq = base = held = 0
        keys, sizes, ids = [], [], []

        def close() -> pa.RecordBatch:
            codes = encode_ids(np.frombuffer(b"".join(ids), ID_TYPE))
            return pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "base": pa.array([base], pa.int64()), "total": pa.array([held], pa.int64()),
                    "doc_ids": pa.array([keys], pa.list_(pa.int64())), "lengths": pa.array([sizes], pa.list_(pa.int64())), "codes": pa.array([codes], pa.binary()),
                }
            )

        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                got = enc.encode(text.as_py()) + tail
                keys.append(key.as_py())
                sizes.append(len(got) // 4)
                ids.append(got)
                held += len(got) // 4
                if held >= limit:
                    yield close()
                    seq, base, held = seq + 1, base + held, 0
                    keys, sizes, ids = [], [], []
        if keys:
            yield close()

    return run


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 2, segment_ids: int = SEGMENT_IDS) -> None:
    """Encode whole texts and write their ids in ascending order of document id.

    A null text counts as empty, null ids come first, rows with one id follow
    each other in an order set by their text; other columns are not read. An
    empty table writes no segment. A document is never divided, so a very long
    one makes a long segment of its own.
    """
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), any_text(text_col).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    order = [F.asc_nulls_first("doc_id"), F.asc("tie"), F.asc("row")]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order[:2]).select("doc_id", "text")
    placed.mapInArrow(_segments(tokenizer_path, end_id, segment_ids), SEGMENT_SCHEMA).write.parquet(folder)


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            raw = Segment(row["codes"]).ids().tobytes()
            ends = np.cumsum(row["lengths"])
            starts = ends - row["lengths"]
            sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array(row["doc_ids"], pa.int64()), "part": pa.array([row["part"]] * len(ends), pa.int32()), "inside": pa.array(starts + row["base"], pa.int64()),
                    "n_tokens": pa.array(row["lengths"], pa.int64()), "ids_crc32": pa.array(sums, pa.int64()),
                }
            )


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens and the checksum of its ids.

    ``start`` counts the ids of all documents before it. Only one total per
    written partition is needed to number the partitions, a table bounded by
    the number of files.
    """
    files = spark.read.schema(SEGMENT_SCHEMA).parquet(folder)
    totals = files.groupBy("part").agg(F.sum("total").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    found = files.mapInArrow(_decoded, "doc_id long, part int, inside long, n_tokens long, ids_crc32 long")
    return found.join(F.broadcast(offsets), "part").select("doc_id", (F.col("offset") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def stored_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 2) -> DataFrame:
    """Write the documents' ids to a new shared folder and read them back from there."""
    folder = scratch_folder(docs.sparkSession, "token-store")
    write_tokens(docs, tokenizer_path, folder, id_col, text_col, end_id)
    return read_documents(docs.sparkSession, folder)
