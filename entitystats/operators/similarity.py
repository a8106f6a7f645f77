"""Nearest vectors by cosine similarity."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entitystats.functions.vectors import text_vector
from entitystats.session import settled

#: Item rows and query rows that meet in one task, about; and queries scored at once.
ITEM_TILE, QUERY_TILE, AT_ONCE = 8_192, 2_000, 128
#: Groups that items are dealt over.
MAX_CENTRES = 2_048


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows x dim matrix, mask of rows that have exactly dim values)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, int)
    valid = (sizes == dim) & ~np.asarray(column.is_null())
    if valid.all() and len(column):
        flat = column.values.slice(column.offsets[0].as_py(), len(column) * dim)
        return flat.to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim), valid
    out = np.zeros((len(column), dim))
    for i in np.flatnonzero(valid):
        out[i] = column[int(i)].values.to_numpy(zero_copy_only=False)
    return out, valid


def _unit_rows(m: np.ndarray) -> np.ndarray:
    size = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def top_similar(items: DataFrame, queries: DataFrame, k: int = 5, ident: str = "id", vector: str = "vector", query_id: str = "query_id", query_vector: str = "query") -> DataFrame:
    """The k most similar items of every query: (query_id, id, score, rank), exactly.

    Items are grouped around centres drawn from them, and each group's largest
    angle to its centre bounds the score a query can reach in it. A query first
    meets the nearest groups that together hold k items, then every other one
    whose bound is not below its k-th score so far; the rest is never met. A
    crowded group is split, so that a task multiplies about ``ITEM_TILE`` items.
    Vectors of unlike lengths score 0. Equal scores go to the smaller id.
    """
    tiles = Tiles(items, ident, vector)
    asked = queries.select(query_id, query_vector)
    first = settled(tiles.meet(tiles.nearest(asked, query_vector, k), k, query_id, query_vector))
    best = first
    if len(tiles.centres) > 1:
        rank = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("score"), ident))
        reached = first.withColumn("rank", rank).filter(F.col("rank") == k).select(query_id, F.col("score").alias("__kth"))
        best = first.unionByName(tiles.meet(tiles.others(asked.join(reached, query_id, "left"), query_vector, k), k, query_id, query_vector))
    rank = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("score"), ident))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k)


class Tiles:
    """Items grouped around centres, with the largest angle of each group.

    Groups are numbered; items without a direction (null, zero or not finite)
    form the last one, whose scores are 0 like those of other lengths. There
    are at most ``MAX_CENTRES`` groups, so their centres, angles and sizes pass
    through the driver.
    """

    def __init__(self, items: DataFrame, ident: str, vector: str) -> None:
        self.ident, self.vector, self.items = ident, vector, items
        count = items.count()
        wanted = min(MAX_CENTRES, -(-count // ITEM_TILE))
        drawn = items.select(vector).sample(min(1.0, wanted / count), seed=3).limit(2 * wanted).collect() if wanted > 1 else []
        units = [_unit_rows(np.array([r[0]], float))[0] for r in drawn if r[0] and None not in r[0]]
        self.centres = [u for u in units if np.isfinite(u).all() and u.any()] or [np.ones(1)]
        none = len(self.centres)
        if none == 1:
            # one group of everything: no angle needed
            self.sizes, self.angles = np.array([count, 0]), np.array([np.pi, 0.0])
            self.placed = items.select(ident, vector, F.lit(0).alias("__tile"), F.lit(0).alias("__part"))
            self.parts = np.array([max(1, -(-count // ITEM_TILE)), 1])
        else:
            schema = T.StructType([items.schema[ident], items.schema[vector], T.StructField("__tile", T.IntegerType()), T.StructField("__angle", T.DoubleType())])
            near = settled(items.select(ident, vector).mapInArrow(_placing(self.centres), schema))
            found = {r[0]: r for r in near.groupBy("__tile").agg(F.count(F.lit(1)), F.max("__angle")).collect()}
            self.sizes = np.array([found[i][1] if i in found else 0 for i in range(none + 1)])
            self.angles = np.array([found[i][2] if i in found else 0.0 for i in range(none + 1)])
            self.parts = np.maximum(1, -(-self.sizes // ITEM_TILE))
            parts = F.get(F.array(*[F.lit(int(n)) for n in self.parts]), F.col("__tile")) if self.parts.max() > 1 else F.lit(1)
            self.placed = near.select(ident, vector, "__tile", F.pmod(F.xxhash64(ident, vector), parts).cast("int").alias("__part"))

    def nearest(self, asked: DataFrame, query: str, k: int) -> DataFrame:
        """Queries with the nearest groups that hold k items."""
        return self._visits(asked, query, k, False)

    def others(self, asked: DataFrame, query: str, k: int) -> DataFrame:
        """Queries, whose k-th score so far is ``__kth``, with the other groups that may hold better items."""
        return self._visits(asked, query, k, True)

    def _visits(self, asked: DataFrame, query: str, k: int, others: bool) -> DataFrame:
        keys = [f for f in asked.schema.fields if f.name != "__kth"]
        schema = T.StructType([*keys, T.StructField("__tile", T.IntegerType()), T.StructField("__part", T.IntegerType())])
        return asked.mapInArrow(_visiting(self.centres, self.angles, self.sizes, self.parts, query, k, others, _arrow(schema)), schema)

    def meet(self, visits: DataFrame, k: int, query_id: str, query_vector: str) -> DataFrame:
        """The k best items of every query in each group it visits."""
        ident, vector = self.ident, self.vector
        schema = T.StructType([T.StructField(query_id, visits.schema[query_id].dataType), T.StructField(ident, self.items.schema[ident].dataType), T.StructField("score", T.DoubleType())])
        out = _arrow(schema)

        def meet(some: pa.Table, asked: pa.Table) -> pa.Table:
            # ids in order, so that of equal scores the first is the one with the smaller id
            some = some.take(pa.array(np.argsort(some.column(ident).to_pandas().to_numpy(), kind="stable")))
            q, i, score = _best(some.column(vector), asked.column(query_vector), k)
            return pa.table([asked.column(query_id).take(pa.array(q)), some.column(ident).take(pa.array(i)), pa.array(score)], names=out.names).cast(out)

        # a group is met by blocks of queries, each with a copy of its items
        blocks = max(1, -(-visits.count() // (QUERY_TILE * len(self.centres)))) if len(self.centres) > 1 else max(1, -(-visits.count() // QUERY_TILE))
        block = F.pmod(F.xxhash64(*[c for c in visits.columns if not c.startswith("__")]), F.lit(blocks)).cast("int")
        right = visits.withColumn("__block", block)
        left = self.placed.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        on = ["__tile", "__part", "__block"]
        return left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(meet, schema)


def _directions(column: pa.Array, centres: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(cosine of each vector with each centre, nan where lengths differ; whether the vector has a direction)."""
    sizes = np.array([len(v) if v is not None else 0 for v in column.to_pandas()], int)
    cosines, directed = np.full((len(sizes), len(centres)), np.nan), np.zeros(len(sizes), bool)
    for dim in np.unique(sizes[sizes > 0]):
        rows, same = np.flatnonzero(sizes == dim), [j for j, c in enumerate(centres) if len(c) == dim]
        unit = _unit_rows(_matrix(column.take(pa.array(rows)), int(dim))[0])
        directed[rows] = np.isfinite(unit).all(axis=1) & unit.any(axis=1)
        if same:
            cosines[np.ix_(rows, same)] = np.clip(unit @ np.array([centres[j] for j in same]).T, -1.0, 1.0)
    return cosines, directed


def _placing(centres: list[np.ndarray]):
    def run(batches):
        for batch in batches:
            cosines, directed = _directions(batch.column(1), centres)
            near = np.where(np.isnan(cosines), -2.0, cosines)
            tile = near.argmax(axis=1)
            best = near[np.arange(len(tile)), tile]
            # vectors of a length that no centre has are met wherever their score 0 may count
            lost = ~directed | (best < -1.5)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.where(lost, len(centres), tile), pa.int32()), pa.array(np.where(lost, np.pi, np.arccos(np.clip(best, -1.0, 1.0))))],
                names=[*batch.schema.names, "__tile", "__angle"],
            )

    return run


def _visiting(centres: list[np.ndarray], angles: np.ndarray, sizes: np.ndarray, parts: np.ndarray, query: str, k: int, others: bool, schema: pa.Schema):
    """Rows of queries repeated for each part of each group they are to meet."""
    def run(batches):
        for batch in batches:
            names = [n for n in batch.schema.names if n != "__kth"]
            if len(centres) == 1:
                bound = np.ones((batch.num_rows, 2))
            else:
                cosines, directed = _directions(batch.column(names.index(query)), centres)
                reach = np.cos(np.maximum(0.0, np.arccos(cosines) - angles[:-1] - 1e-7))
                bound = np.where(np.isnan(cosines) | ~directed[:, None], 0.0, reach)
                # the last group holds vectors of any length that no centre has
                bound = np.column_stack((bound, np.ones(len(bound))))
            order = np.argsort(-bound, axis=1, kind="stable")
            ahead = np.cumsum(sizes[order], axis=1) - sizes[order]
            first = np.zeros(bound.shape, bool)
            np.put_along_axis(first, order, ahead < k, axis=1)
            wanted = first
            if others:
                kth = batch.column(batch.schema.names.index("__kth")).to_numpy(zero_copy_only=False).astype(float)
                wanted = ~first & (bound >= np.where(np.isnan(kth), -2.0, kth)[:, None] - 1e-9)
            row, tile = np.nonzero(wanted & (sizes > 0)[None, :])
            split = parts[tile]
            row, tile = np.repeat(row, split), np.repeat(tile, split)
            part = np.arange(len(row)) - np.repeat(np.cumsum(split) - split, split)
            held = batch.select(names).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*held.columns, pa.array(tile, pa.int32()), pa.array(part, pa.int32())], schema=schema)

    return run


def _best(items: pa.ChunkedArray, queries: pa.ChunkedArray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, item row, score) of the k best items of each query, ties to the earlier item."""
    sizes = np.array([len(v) if v is not None else 0 for v in queries.to_pandas()], int)
    q_out, i_out, s_out = [], [], []
    for dim in np.unique(sizes) if len(items) else []:
        members = np.flatnonzero(sizes == dim)
        if dim:
            m, valid = _matrix(items, dim)
            m = _unit_rows(m)
            asked = _unit_rows(_matrix(queries.take(pa.array(members)), dim)[0])
        for at in range(0, len(members), AT_ONCE):
            some = members[at : at + AT_ONCE]
            if dim:
                scores = asked[at : at + AT_ONCE] @ m.T
                scores[:, ~valid] = 0.0
                scores[np.isnan(scores)] = 0.0  # a vector with a missing component
            else:
                scores = np.zeros((len(some), len(items)))
            least = np.partition(scores, max(0, scores.shape[1] - k), axis=1)[:, max(0, scores.shape[1] - k)]
            row, col = np.nonzero(scores >= least[:, None])
            order = np.lexsort((col, -scores[row, col], row))
            row, col = row[order], col[order]
            nth = np.arange(len(row)) - np.searchsorted(row, row)  # place within its query
            row, col = row[nth < k], col[nth < k]
            q_out.append(some[row])
            i_out.append(col)
            s_out.append(scores[row, col])
    if not q_out:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return np.concatenate(q_out), np.concatenate(i_out), np.concatenate(s_out)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def similarity_summary(best: DataFrame, query_id: str = "query_id") -> DataFrame:
    """Largest and mean score of the top matches per query."""
    return best.groupBy(query_id).agg(F.max("score").alias("max_similarity"), F.avg("score").alias("avg_topk_similarity"))


def index_new(items: DataFrame, index: DataFrame, ident: str = "id", text: str = "text", dim: int = 384) -> DataFrame:
    """Vectors for the items that are not indexed yet; repeated ids are indexed once."""
    fresh = items.filter((F.length(ident) > 0) & (F.length(text) > 0)).join(index.select(F.col("source_id").alias(ident)).distinct(), ident, "left_anti")
    fresh = fresh.groupBy(ident).agg(F.min(text).alias(text))
    return fresh.select(F.col(ident).alias("source_id"), text_vector(F.col(text), dim).alias("embedding"))
