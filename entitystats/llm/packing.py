"""Best-fit packing of token pieces into sequences, improved by local search.

Documents longer than a sequence are cut into full pieces, the first piece
takes what is left over. Full pieces are sequences of their own. The others are
dealt at random into cells of a few thousand pieces; each cell is packed by
itself, best fit for falling lengths, and then improved: between underfull
sequences pieces move, change places one for one, or two for one, whenever that
raises the sum of squared fills, until sequences fall empty or no exchange
helps. A cell wastes less than one sequence beyond its own optimum's neighbour,
so many small cells lose next to nothing and never grow with the corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entitystats.llm.common import any_text, col
from entitystats.llm.tokens import ID_TYPE, encoder
from entitystats.session import settled

#: Pieces that are packed together.
CELL_PIECES = 4096
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(path: str, end_id: int | None, capacity: int):
    tail = b"" if end_id is None else np.array([end_id], ID_TYPE).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            out: list[tuple] = []
            for key, text in zip(batch.column(0), batch.column(1)):
                ids, doc = enc.encode(text.as_py()) + tail, key.as_py()
                n = len(ids) // 4
                count = max(1, -(-n // capacity))
                start, stop = 0, n - (count - 1) * capacity
                for piece in range(count):
                    out.append((doc, piece, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])))
                    start, stop = stop, stop + capacity
            if out:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 2) -> DataFrame:
    """One row per piece of each document; a null text is an empty one."""
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), any_text(text_col).alias("text"))
    return rows.mapInArrow(_pieces(tokenizer_path, end_id, capacity), PIECE_SCHEMA)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: longest first, each into the fullest bin that has room."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has room r
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[i]
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        left = room - size
        by_room[left].append(b)
        rooms |= 1 << left
    return bins


class _Bins:
    """Bins with the distinct sizes in each, so that one look finds the best exchange of a bin with all others."""

    def __init__(self, bins: list[list[int]], sizes: list[int], capacity: int) -> None:
        self.bins, self.sizes = bins, sizes
        self.fills = np.array([sum(sizes[i] for i in b) for b in bins], np.int64)
        self.capacity, self.none = capacity, 2 * capacity + 1
        self.values = np.full((len(bins), 2 + max((len({sizes[i] for i in b}) for b in bins), default=0)), self.none, np.int64)
        for b in range(len(bins)):
            self.note(b)

    def note(self, b: int) -> None:
        """Take down the sizes in a bin; the first value, 0, stands for nothing in return."""
        own = [0, *sorted({self.sizes[i] for i in self.bins[b]})]
        if len(own) > self.values.shape[1]:
            more = np.full((len(self.bins), len(own)), self.none, np.int64)
            self.values = np.concatenate((self.values, more), axis=1)
        self.values[b] = self.none
        self.values[b, : len(own)] = own

    def exchange(self, donor: int, others: np.ndarray) -> int:
        """Make the exchange with one of ``others`` that raises the sum of squares most; its bin, or -1.

        The donor gives one or two pieces and takes back one or none.
        """
        held = self.bins[donor]
        given = {self.sizes[i]: (i,) for i in held}
        for k, a in enumerate(held):
            for b in held[k + 1 :]:
                given.setdefault(self.sizes[a] + self.sizes[b], (a, b))
        wholes = np.array(list(given), np.int64)
        lead = self.fills[others] - self.fills[donor]
        gaps, least = (self.capacity - self.fills[others])[:, None], np.maximum(0, -lead)[:, None]
        values = self.values[others]
        best, which = 0, (0, 0, 0)
        for at in range(0, len(wholes), max(1, (1 << 20) // max(1, values.size))):
            gain = wholes[at : at + max(1, (1 << 20) // max(1, values.size)), None, None] - values
            raised = np.where((gain > least) & (gain <= gaps), gain * (gain + lead[:, None]), 0)
            k = int(raised.argmax())
            if raised.flat[k] > best:
                best, (g, o, v) = int(raised.flat[k]), np.unravel_index(k, raised.shape)
                which = at + int(g), int(o), int(v)
        if not best:
            return -1
        there, b, value = given[int(wholes[which[0]])], int(others[which[1]]), int(values[which[1:]])
        back = [next(i for i in self.bins[b] if self.sizes[i] == value)] if value else []
        self.bins[donor] = [i for i in held if i not in there] + back
        self.bins[b] = [i for i in self.bins[b] if i not in back] + list(there)
        gain = int(wholes[which[0]]) - value
        self.fills[donor] -= gain
        self.fills[b] += gain
        self.note(donor)
        self.note(b)
        return b


def improve(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """Local search on the sum of squared fills; every step raises it, so it ends.

    It ends where no exchange raises it any more, or at a bound below which no
    packing can go. Pairs of bins neither of which has changed since they were
    tried are not tried again.
    """
    state = _Bins(bins, sizes, capacity)
    fills = state.fills
    floor = max(-(-int(fills.sum()) // capacity), sum(2 * s > capacity for s in sizes))
    count = len(bins)
    clock, changed, tried = 1, np.ones(len(bins), np.int64), np.zeros(len(bins), np.int64)
    moved = True
    while moved and count > floor:
        moved = False
        for donor in np.argsort(fills, kind="stable").tolist():
            while count > floor and 0 < fills[donor] < capacity:
                open_bins = (fills > 0) & (fills < capacity)
                if changed[donor] <= tried[donor]:
                    open_bins &= changed > tried[donor]
                open_bins[donor] = False
                others = np.flatnonzero(open_bins)
                b = state.exchange(donor, others) if len(others) else -1
                if b < 0:
                    tried[donor] = clock
                    break
                moved = True
                clock += 1
                changed[donor] = changed[b] = clock
                count -= fills[donor] == 0
    return [b for b in bins if b]


def _pack_cell(capacity: int):
    def run(key: tuple, cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values(["length", "doc_id", "piece", "row"], ascending=[False, True, True, True], ignore_index=True)
        sizes = cell["length"].tolist()
        packed = improve(best_fit(sizes, capacity), sizes, capacity)
        sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for number, items in enumerate(packed):
            at = 0
            for i in items:
                sequence[i], offset[i] = (int(key[0]) << 32) + number, at
                at += sizes[i]
        return cell.assign(sequence_id=sequence, offset=offset)[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 2, cell_pieces: int = CELL_PIECES) -> DataFrame:
    """Every piece with its sequence and its place there, gapless from 0.

    An empty table gives no rows; an empty or null text is the end id alone.
    Repeated rows are packed each by itself, ids may be null. Ties between
    pieces of one length are settled by id. Full pieces have negative sequence
    ids.
    """
    cut = settled(pieces(docs, tokenizer_path, capacity, id_col, text_col, end_id)).withColumn("row", F.monotonically_increasing_id())
    short = cut.where(F.col("length") < capacity)
    cells = max(1, -(-short.count() // cell_pieces))
    short = short.withColumn("cell", F.pmod(F.xxhash64("row"), F.lit(cells)))
    packed = short.groupBy("cell").applyInPandas(_pack_cell(capacity), PIECE_SCHEMA + ", sequence_id long, offset long")
    full = cut.where(F.col("length") == capacity).select("doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(full)
