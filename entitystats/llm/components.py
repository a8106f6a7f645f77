"""Connected components of an edge table, by stars that shrink until they are stable."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entitystats.session import settled

EDGES = "a long, b long"
#: Edges that one task joins in memory before it passes on a forest.
BLOCK_EDGES = 1 << 20


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) for every node that is not the least itself."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        if np.array_equal(before, root):
            break
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    count = 0

    def joined() -> tuple[np.ndarray, np.ndarray]:
        return forest(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))

    def batch_of(pair: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(pair[0], pa.int64()), pa.array(pair[1], pa.int64())], names=["a", "b"])

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        count += batch.num_rows
        if count > BLOCK_EDGES:
            held = [joined()]
            count = len(held[0][0])
            if count > BLOCK_EDGES // 2:
                yield batch_of(held[0])
                held, count = [], 0
    if held:
        yield batch_of(joined())


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable over edges ``a``-``b``; lone nodes are left out.

    Each round first joins the edges of a task into a forest. Large star: all
    larger neighbours of a node are linked to its least neighbour; small star:
    so are its smaller ones. Both are a minimum per node, combined before the
    shuffle, and a join on the node, so a node with many neighbours costs rows
    and no memory. It ends when every node has one link, to a root.
    """
    now = settled(edges.where("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").mapInArrow(_forests, EDGES))
    while True:
        ends = now.selectExpr("a AS node", "0 AS root").unionByName(now.selectExpr("b AS node", "1 AS root"))
        state = ends.groupBy("node").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.sum(1 - F.col("root")).alias("links"))
        if state.where("lo <> hi OR links > 1").isEmpty():
            return now.selectExpr("a AS node", "b AS component")
        least = now.unionByName(now.selectExpr("b AS a", "a AS b")).groupBy("a").agg(F.min("b").alias("m")).selectExpr("a AS b", "least(a, m) AS m")
        large = settled(now.join(settled(least), "b").selectExpr("a", "m AS b").distinct())
        lower = settled(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(lower, "a").where("b <> m").selectExpr("b AS a", "m AS b").unionByName(lower.selectExpr("a", "m AS b"))
        now = settled(small.distinct().mapInArrow(_forests, EDGES))
