"""Gradient-boosted trees for the logistic loss, over small binned tables.

Fitted on the driver from a table whose size has a bound (distinct feature
rows with weights, or a sample of documented size); applied as numpy code in
tasks or as a Spark SQL expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Leaf:
    value: float


@dataclass(frozen=True)
class Split:
    feature: int
    bound: float
    low: Leaf | Split
    high: Leaf | Split


class BoostedTrees:
    """A sum of trees; ``margin`` is the log-odds."""

    def __init__(self, base: float, trees: list[Leaf | Split]) -> None:
        self.base, self.trees = base, trees

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)

        def add(node: Leaf | Split, rows: np.ndarray) -> None:
            if isinstance(node, Leaf):
                out[rows] += node.value
            elif len(rows):
                low = x[rows, node.feature] <= node.bound
                add(node.low, rows[low])
                add(node.high, rows[~low])

        for tree in self.trees:
            add(tree, np.arange(len(x)))
        return out

    def sql(self, names: list[str]) -> str:
        """The margin as an SQL expression over the named feature columns."""

        def text(node: Leaf | Split) -> str:
            if isinstance(node, Leaf):
                return f"{node.value:.9f}D"
            return f"IF({names[node.feature]} <= {node.bound:.6f}D, {text(node.low)}, {text(node.high)})"

        return " + ".join([f"{self.base:.9f}D", *(text(t) for t in self.trees)])


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 30, depth: int = 3, rate: float = 0.3, least: float = 1.0, bins: int = 32) -> BoostedTrees:
    """Boost ``rounds`` trees of ``depth`` on rows ``x`` with labels ``y`` (0 or 1) and weights.

    ``least`` is added to every leaf's curvature. Ties between splits go to the
    first feature and the lowest bound.
    """
    total = weight.sum()
    share = np.clip((weight * y).sum() / total if total else 0.5, 1e-4, 1 - 1e-4)
    model = BoostedTrees(float(np.log(share / (1 - share))), [])
    if not len(x):
        return model
    bounds = []
    for column in x.T:
        values = np.unique(column)
        mids = (values[1:] + values[:-1]) / 2
        bounds.append(mids if len(mids) <= bins else np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])))
    binned = np.stack([np.searchsorted(b, c, "left") for b, c in zip(bounds, x.T)], axis=1)
    margin = np.full(len(x), model.base)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, left: int) -> Leaf | Split:
        sum_g, sum_h = g[rows].sum(), h[rows].sum()
        best = (1e-9, None, None)
        if left and len(rows) > 1:
            for f, b in enumerate(bounds):
                if not len(b):
                    continue
                cg = np.cumsum(np.bincount(binned[rows, f], g[rows], len(b) + 1))[:-1]
                ch = np.cumsum(np.bincount(binned[rows, f], h[rows], len(b) + 1))[:-1]
                gain = cg**2 / (ch + least) + (sum_g - cg) ** 2 / (sum_h - ch + least) - sum_g**2 / (sum_h + least)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], f, k)
        if best[1] is None:
            return Leaf(float(rate * sum_g / (sum_h + least)))
        low = binned[rows, best[1]] <= best[2]
        return Split(best[1], float(bounds[best[1]][best[2]]), grow(rows[low], g, h, left - 1), grow(rows[~low], g, h, left - 1))

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        tree = grow(np.arange(len(x)), weight * (y - p), weight * p * (1 - p), depth)
        model.trees.append(tree)
        margin += BoostedTrees(0.0, [tree]).margin(x)
    return model
