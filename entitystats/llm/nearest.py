"""Nearest neighbours by inner product with multiprobe p-stable hashing.

Vectors of about one length are scaled to length one at most and given one more
coordinate, so that the largest inner product is the least Euclidean distance.
Each of ``TABLES`` tables hashes a vector by ``HASHES`` Gaussian projections cut
at a width, ``WIDTH`` or as much wider as a sample of the queries needs to meet
its true nearest.
A query visits its own bucket and those that differ by a step in some of the
projections, in the order of the estimated chance of success (the sum of
squared distances to the crossed borders), up to ``PROBES`` a table. A query
that has met fewer than asked for visits everything there. The
candidates of all tables are merged and ranked by the exact inner product of
the original vectors in double precision.

Rows are dealt into blocks of about ``BLOCK`` by hash of the id; every block
has its own tables and every query visits every block's tables, so a common
vector or a crowded bucket never gathers in one task and no bucket is cut off.
"""

from __future__ import annotations

import heapq
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from entitystats.llm.common import col
from entitystats.session import settled

TABLES, HASHES, WIDTH, PROBES = 10, 3, 0.8, 20
BLOCK, QUERY_BLOCK = 8192, 4096
#: Queries whose candidates are held at once in a task.
TOGETHER = 256
#: Shortest length, as a part of the longest, of vectors that share tables.
RANGE = 0.8
#: Queries the width is tried on, the share of their nearest that must be met, steps of widening until all is visited.
SAMPLE, AIM, WIDER, WIDENINGS = 32, 0.95, 1.25, 10
#: Share of met pairs below which each query gathers its own candidates instead of a product of the whole tile.
FEW = 0.1
SEED = 11


@cache
def projections(dims: int, tables: int = TABLES, hashes: int = HASHES, width: float = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.standard_normal((tables, hashes, dims)), rng.random((tables, hashes)) * width


@cache
def probe_sets(hashes: int, probes: int) -> list[tuple[int, ...]]:
    """Sets of ranks, into the sorted border distances, in order of expected cost.

    Rank ``j`` of the 2 x ``hashes`` sorted distances is expected at a fixed
    square; a set never crosses both borders of one projection, which are ranks
    ``j`` and ``2 * hashes - 1 - j``.
    """
    m = hashes
    cost = [(j + 1) * (j + 2) / (4 * (m + 1) * (m + 2)) if j < m else 1 - (2 * m - j) / (m + 1) + (2 * m - j) * (2 * m - j + 1) / (4 * (m + 1) * (m + 2)) for j in range(2 * m)]
    found: list[tuple[int, ...]] = [()]
    waiting = [(cost[0], (0,))]
    while waiting and len(found) < probes:
        value, ranks = heapq.heappop(waiting)
        if all(2 * m - 1 - j not in ranks for j in ranks):
            found.append(ranks)
        j = ranks[-1]
        if j + 1 < 2 * m:
            heapq.heappush(waiting, (value + cost[j + 1], (*ranks, j + 1)))
            heapq.heappush(waiting, (value - cost[j] + cost[j + 1], (*ranks[:-1], j + 1)))
    return found


def _key(codes: np.ndarray) -> np.ndarray:
    """One number for the codes along the last axis."""
    key = np.zeros(codes.shape[:-1], np.uint64)
    for k in range(codes.shape[-1]):
        key = (key ^ codes[..., k].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key


def probed(places: np.ndarray, probes: int) -> np.ndarray:
    """Keys of the buckets that queries visit; ``places`` are projections in units of the width."""
    n, m = places.shape
    base = np.floor(places)
    below = places - base
    distances = np.concatenate((below, 1 - below), axis=1)
    order = np.argsort(distances, axis=1, kind="stable")
    # partner borders of one projection have opposite ranks, up to ties
    sets = probe_sets(m, probes)
    codes = np.repeat(base[:, None, :], len(sets), axis=1)
    rows = np.arange(n)
    for s, ranks in enumerate(sets):
        for j in ranks:
            border = order[:, j]
            codes[rows, s, border % m] += np.where(border < m, -1, 1)
    return _key(codes)


class Tables:
    """The hash tables of a block of vectors."""

    def __init__(self, items: np.ndarray, longest: float, width: float = WIDTH) -> None:
        size = np.linalg.norm(items, axis=1) / longest
        items = np.concatenate((items / longest, np.sqrt(np.maximum(0, 1 - size**2))[:, None]), axis=1)
        self.axes, self.shifts = projections(items.shape[1], width=width)
        self.width = width
        self.buckets = [np.unique(_key(np.floor((items @ axis.T + shift) / width)), return_inverse=True) for axis, shift in zip(self.axes, self.shifts)]

    def candidates(self, queries: np.ndarray) -> np.ndarray:
        """Which items each query (row) meets in some table."""
        queries = np.concatenate((queries / np.linalg.norm(queries, axis=1, keepdims=True), np.zeros((len(queries), 1))), axis=1)
        met = np.zeros((len(self.buckets[0][1]), len(queries)), bool)
        rows = np.arange(len(queries))[:, None]
        for axis, shift, (keys, bucket_of) in zip(self.axes, self.shifts, self.buckets):
            visits = probed((queries @ axis.T + shift) / self.width, PROBES)
            at = np.searchsorted(keys, visits).clip(max=len(keys) - 1)
            hit = keys[at] == visits
            visited = np.zeros((len(keys), len(queries)), bool)
            visited[at[hit], np.broadcast_to(rows, at.shape)[hit]] = True
            met |= visited[bucket_of]
        return met.T


class Ranges:
    """A block's vectors in ranges of lengths, each with its own tables."""

    def __init__(self, ids: np.ndarray, items: np.ndarray, asked: np.ndarray, queries: np.ndarray, count: int) -> None:
        self.ids, self.items, self.count = ids, items, count
        size = np.linalg.norm(items, axis=1)
        order = np.argsort(-size, kind="stable")
        falling = -size[order]
        some = np.unique(np.linspace(0, len(queries) - 1, SAMPLE).astype(int))
        self.ranges: list[tuple[np.ndarray, Tables | None]] = []
        at = 0
        while at < len(order):
            end = max(at + 1, int(np.searchsorted(falling, RANGE * falling[at], "right")))
            rows = np.sort(order[at:end])
            self.ranges.append((rows, self._tables(rows, float(-falling[at]), asked[some], queries[some])))
            at = end

    def _tables(self, rows: np.ndarray, longest: float, asked: np.ndarray, queries: np.ndarray) -> Tables | None:
        """Tables in which the sample of queries meets its nearest; None where all is visited."""
        if len(rows) <= self.count + 1 or not 0 < longest < np.inf:
            return None
        scores = np.where(asked[:, None] == self.ids[rows], -np.inf, queries @ self.items[rows].T)
        best = np.argpartition(-scores, self.count - 1)[:, : self.count]
        for step in range(WIDENINGS):
            tables = Tables(self.items[rows], longest, WIDTH * WIDER**step)
            if np.take_along_axis(tables.candidates(queries), best, 1).mean() >= AIM:
                return tables
        return None

    def candidates(self, asked: np.ndarray, queries: np.ndarray) -> np.ndarray:
        """Which items each query (row) meets: of each range ``count`` at least, or all of it."""
        met = np.ones((len(queries), len(self.ids)), bool)
        for rows, tables in self.ranges:
            if tables is not None:
                part = tables.candidates(queries) & (asked[:, None] != self.ids[rows])
                part[part.sum(axis=1) < self.count] = True
                met[:, rows] = part
        return met & (asked[:, None] != self.ids)


def _search(count: int):
    def run(items: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        if len(items) and len(queries):
            items, queries = items.sort_values("vec_id"), queries.sort_values("query_id")
            ids, x = items["vec_id"].to_numpy(), np.stack(items["vector"].to_numpy()).astype(float)
            all_asked, all_q = queries["query_id"].to_numpy(), np.stack(queries["vector"].to_numpy()).astype(float)
            ranges = Ranges(ids, x, all_asked, all_q, count)
            for at in range(0, len(queries), TOGETHER):
                asked, q = all_asked[at : at + TOGETHER], all_q[at : at + TOGETHER]
                met = ranges.candidates(asked, q)
                rough = q @ x.T if met.mean() >= FEW else None
                for k in range(len(q)):
                    near = np.flatnonzero(met[k])
                    values = x[near] @ q[k] if rough is None else rough[k, near]
                    if len(near) > count:
                        least = np.partition(values, -count)[-count]
                        near = near[values >= least - 1e-9 * (1 + abs(least))] if np.isfinite(least) else near
                    # rows are summed one like another, so equal vectors get equal scores
                    scores = (x[near] * q[k]).sum(axis=1)
                    order = np.lexsort((ids[near], -scores))[:count]
                    out.append(pd.DataFrame({"query_id": asked[k], "vec_id": ids[near][order], "score": scores[order]}))
        empty = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        return pd.concat(out, ignore_index=True) if out else empty

    return run


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, vector): rows that take part, one for each id.

    Left out: a null id, a null, empty or zero vector, one with a null or
    non-finite component, and one whose length is not the most common.
    """
    rows = vectors.select(col(id_col).cast("long").alias("vec_id"), col(vector_col).cast("array<double>").alias("vector")).where("vec_id IS NOT NULL AND size(vector) > 0")
    sound = rows.where("forall(vector, v -> v IS NOT NULL AND NOT isnan(v) AND abs(v) < CAST('Infinity' AS DOUBLE)) AND exists(vector, v -> v <> 0)")
    return sound.groupBy("vec_id").agg(F.min("vector").alias("vector"))


def nearest(vectors: DataFrame, count: int, queries: str, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``count`` nearest found for every query.

    ``queries`` is an SQL condition on ``vec_id``. Fewer rows come back only if
    there are fewer candidates. Of rows that repeat an id one takes part. An
    empty table gives no rows; other columns are not read.
    """
    rows = settled(usable(vectors, id_col, vector_col))
    sizes = rows.groupBy(F.size("vector").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dims").first()
    dims, total = sizes if sizes else (0, 0)
    rows = rows.where(F.size("vector") == dims)
    blocks = max(1, -(-total // BLOCK))
    asked = rows.where(queries)
    chunks = max(1, -(-asked.count() // QUERY_BLOCK))
    dealt = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    items = rows.select("vec_id", "vector", dealt.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    wanted = asked.select(F.col("vec_id").alias("query_id"), "vector", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(chunks)).cast("int").alias("chunk"))
    found = items.groupBy("block", "chunk").cogroup(wanted.groupBy("block", "chunk")).applyInPandas(_search(count), "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= count).select("query_id", "rank", "vec_id", "score")
