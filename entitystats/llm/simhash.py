"""Near duplicates by SimHash, found over a positional byte index.

A fingerprint has eight bytes. Two fingerprints that differ in at most three
bits share at least five bytes at their positions. So among any ``p`` positions
they share at least ``p - 3``, and indexing every choice of ``p - 3`` out of
the first ``p`` positions loses no pair. Pairs that meet under a key are
tallied (shared positional bytes), those with fewer than five drop out, the
rest are verified bit by bit. More positions make keys longer and lists
shorter; the number follows from the count of fingerprints and never changes
the result.

Only distinct fingerprints are indexed, so copies of a text cost one entry. A
long list is dealt into blocks that meet block by block, and a task passes on
only a forest of the links it found, so no list emits all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entitystats.llm.common import any_text, col, fresh
from entitystats.llm.components import EDGES, components, forest
from entitystats.session import settled

SEED = 42
WORDS = 3
MAX_BITS = 3
#: Guaranteed equal bytes of two fingerprints within ``MAX_BITS`` bits.
LEAST_SHARED = 8 - MAX_BITS
#: Entries of a list that meet in one block.
BLOCK = 4096
#: Keys get another byte when an average list would be longer than this.
LIST_LENGTH = 64
#: Shingles whose bits are counted at once.
AT_ONCE = 1 << 16

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_PLACES = np.arange(8, dtype=np.int32) * 256


def fingerprint(text: str) -> int:
    """The 64-bit SimHash of a text's word shingles, as an unsigned number."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - WORDS + 1)
    ones = np.zeros((8, 8), np.int64)
    join, digest = b" ".join, xxhash.xxh64_digest
    for at in range(0, n, AT_ONCE):
        part = words[at : at + AT_ONCE + WORDS - 1]
        shingles = zip(*(part[k:] for k in range(WORDS))) if len(part) >= WORDS else [part]
        raw = b"".join([digest(join(s), SEED) for s in shingles])
        places = np.frombuffer(raw, np.uint8).reshape(-1, 8) + _PLACES
        ones += np.bincount(places.ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits((2 * ones > n).ravel()).tobytes(), "big")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_signed(fingerprint(t.as_py())) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["row", "fp"])


def positions(count: int) -> int:
    """How many byte positions to index for so many fingerprints, 5 to 8."""
    keyed = 2
    while keyed < LEAST_SHARED and count / 256**keyed > LIST_LENGTH:
        keyed += 1
    return keyed + MAX_BITS


def _lists(fps: DataFrame, p: int) -> DataFrame:
    """(choice, key, i, j, own, fp): entries of every list of two or more, dealt into block pairs."""
    masks = [sum(0xFF << (8 * b) for b in chosen) for chosen in combinations(range(p), p - MAX_BITS)]
    entries = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("choice", "key"))
    sizes = entries.groupBy("choice", "key").count().where("count > 1")
    held = entries.join(settled(sizes), ["choice", "key"]).withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int"))
    held = held.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    dealt = held.select("choice", "key", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return dealt.select("choice", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fp")


class _Links:
    """Collects verified pairs as a forest."""

    def __init__(self) -> None:
        self.a, self.b = [], []
        self.held = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.a.append(a)
        self.b.append(b)
        self.held += len(a)
        if self.held > 1 << 19:
            self.shrink()

    def shrink(self) -> None:
        a, b = forest(np.concatenate(self.a), np.concatenate(self.b))
        self.a, self.b, self.held = [a], [b], len(a)


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links inside runs of equal (choice, key, i, j), which come one after the other."""
    links = _Links()
    rest: np.ndarray | None = None

    def within(rows: np.ndarray) -> None:
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:, :4] != rows[:-1, :4]).any(axis=1)
        starts = np.flatnonzero(new)
        ends = np.repeat(np.append(starts[1:], len(rows)), np.diff(np.append(starts, len(rows))))
        fp, own, twofold = rows[:, 5].astype(np.uint64), rows[:, 4], rows[:, 2] != rows[:, 3]
        at = np.arange(len(rows))
        step = 1
        while True:
            at = at[at + step < ends[at]]
            if not len(at):
                break
            x = fp[at] ^ fp[at + step]
            near = (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1) >= LEAST_SHARED
            near &= ~twofold[at] | (own[at] != own[at + step])
            near[near] = np.bitwise_count(x[near]) <= MAX_BITS
            if near.any():
                links.add(rows[at[near], 5], rows[at[near] + step, 5])
            step += 1

    for batch in batches:
        rows = np.stack([c.to_numpy().astype(np.int64) for c in batch.columns], axis=1)
        if rest is not None:
            rows = np.concatenate((rest, rows))
        if not len(rows):
            continue
        last = np.flatnonzero((rows[:, :4] != rows[-1, :4]).any(axis=1))
        cut = last[-1] + 1 if len(last) else 0
        if cut:
            within(rows[:cut])
        rest = rows[cut:]
    if rest is not None and len(rest):
        within(rest)
    if links.held:
        links.shrink()
        yield pa.RecordBatch.from_arrays([pa.array(links.a[0], pa.int64()), pa.array(links.b[0], pa.int64())], names=["a", "b"])


def linked_fingerprints(fps: DataFrame) -> DataFrame:
    """(fp, root) of the distinct fingerprints that link to others."""
    p = positions(fps.count())
    keys = ["choice", "key", "i", "j"]
    dealt = _lists(fps, p).repartition(*keys).sortWithinPartitions(*keys)
    return components(dealt.mapInArrow(_linked, EDGES)).selectExpr("node AS fp", "component AS root")


def row_fingerprints(docs: DataFrame, row_col: str, text_col: str = "text") -> DataFrame:
    """(row, fp) of every row; a null text has no words and so the fingerprint 0."""
    return docs.select(col(row_col).cast("long").alias("row"), any_text(text_col).alias("text")).mapInArrow(_fingerprints, "row long, fp long")


def linked_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint and component_id for every row.

    ``component_id`` is the smallest doc_id reachable over links, the row's own
    included. Texts without words have fingerprint 0 and link like any other.
    Rows with a null id link too, but name no component: it is null where a
    component has no other id. Repeated rows each have a row. Other columns
    are not read.
    """
    rows = settled(row_fingerprints(docs, id_col, text_col))
    classes = settled(rows.groupBy("fp").agg(F.min("row").alias("least")))
    roots = linked_fingerprints(classes.select("fp"))
    named = settled(classes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    ids = settled(named.groupBy("root").agg(F.min("least").alias("component_id")))
    by_fp = settled(named.join(ids, "root").select("fp", "component_id"))
    return rows.join(by_fp, "fp").select(F.col("row").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The first row, by id, of each group of linked rows, with all its columns.

    A null id comes last. Of rows that repeat an id within a group one stays.
    The rows that stay grow with the corpus, so they meet the documents in a
    merge join at every size and are never broadcast.
    """
    fp, row = fresh(docs, "fp", "row")
    kept = settled(docs.withColumn(row, F.monotonically_increasing_id()))
    thin = settled(row_fingerprints(kept, row, text_col))
    classes = settled(thin.select("fp").distinct())
    roots = linked_fingerprints(classes)
    keyed = kept.select(col(row).alias("row"), col(id_col).alias("id")).join(thin, "row").join(roots, "fp", "left")
    order = F.struct(F.col("id").isNull().alias("late"), "id", "row")
    first = settled(keyed.groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min(order).alias("first")).select(F.col("first.row").alias(row)))
    return kept.join(first.hint("merge"), row, "left_semi").select(*[col(c) for c in docs.columns])
