"""Probability and regression quality measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entitystats.session import settled_small
from entitystats.skew import as_list, null_safe_join, whole_key


def brier(truth: Column, prob: Column) -> Column:
    """Mean squared difference (an aggregate)."""
    return F.avg(F.pow(prob - truth, F.lit(2.0)))


def fixed_bin(prob: Column, n_bins: int) -> Column:
    """Bin number on equal edges over [0, 1]: the count of edges at or below.

    Edges are i times the step in double arithmetic, the last one exactly 1;
    a probability of 1 lands in bin n_bins, outside the reported range.
    """
    step = 1.0 / n_bins
    edges = [i * step for i in range(n_bins)] + [1.0]
    at_or_above = F.lit(-1)
    for e in edges:
        at_or_above = at_or_above + (prob >= F.lit(e)).cast("int")
    return at_or_above


def range_bin(prob: Column, low: Column, high: Column, n_bins: int) -> Column:
    """Bin number on equal edges over [low, high], clipped to 0..n_bins-1."""
    step = (high - low) / n_bins
    at_or_above = F.lit(-1)
    for i in range(n_bins):
        at_or_above = at_or_above + (prob >= low + step * i).cast("int")
    at_or_above = at_or_above + (prob >= high).cast("int")
    return F.greatest(F.lit(0), F.least(at_or_above, F.lit(n_bins - 1)))


def _ece_of_bins(binned: DataFrame, keys: list[str], n_bins: int) -> DataFrame:
    """Weighted gap per group from (bin, n, sum_p, sum_y) rows."""
    inside = F.col("bin").between(0, n_bins - 1)
    gap = F.abs(F.col("sp") / F.col("n") - F.col("sy") / F.col("n")) * F.col("n")
    return binned.groupBy(*keys).agg(
        (F.sum(F.when(inside, gap).otherwise(0.0)) / F.sum("n")).alias("ece"), F.sum("n").alias("n")
    )


def calibration_error(df: DataFrame, truth: str, prob: str, by: str | Sequence[str] = (), n_bins: int = 10, clipped: bool = False) -> DataFrame:
    """Brier score and expected calibration error, per group or overall.

    Rows reduce to (group, bin) sums before the shuffle. ``clipped`` bins over
    the range of the predictions instead of [0, 1].
    """
    keys = as_list(by) or ["__all"]
    rows = df.withColumn("__all", whole_key(prob)).select(*keys, F.col(truth).cast("double").alias("y"), F.col(prob).cast("double").alias("p"))
    rows = rows.filter("y IS NOT NULL AND p IS NOT NULL")
    if clipped:
        span = rows.groupBy(*keys).agg(F.min("p").alias("lo"), F.max("p").alias("hi"))
        rows = null_safe_join(rows, settled_small(span), keys)
        bin_ = range_bin(F.col("p"), F.col("lo"), F.col("hi"), n_bins)
    else:
        bin_ = fixed_bin(F.col("p"), n_bins)
    binned = rows.groupBy(*keys, bin_.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("p").alias("sp"), F.sum("y").alias("sy"), F.sum(F.pow(F.col("p") - F.col("y"), F.lit(2.0))).alias("sq")
    )
    ece = _ece_of_bins(binned, keys, n_bins)
    score = binned.groupBy(*keys).agg((F.sum("sq") / F.sum("n")).alias("brier"))
    return null_safe_join(ece, score, keys).drop("__all")


def reliability_table(df: DataFrame, truth: str, prob: str, n_bins: int = 10) -> DataFrame:
    """Bin centre, mean prediction, observed frequency and count; empty bins are zeros."""
    y, p = F.col(truth).cast("double"), F.col(prob).cast("double")
    found = df.groupBy(fixed_bin(p, n_bins).alias("bin")).agg(F.avg(p).alias("ap"), F.avg(y).alias("at"), F.count(p).alias("n"))
    bins = df.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return bins.join(F.broadcast(found.filter(F.col("bin").between(0, n_bins - 1))), "bin", "left").select(
        "bin", ((F.col("bin") + 0.5) / n_bins).alias("bin_center"), zero("ap").alias("avg_pred"), zero("at").alias("avg_true"),
        F.coalesce("n", F.lit(0).cast("bigint")).alias("n"),
    )


def regression_metrics(df: DataFrame, truth: str, pred: str, by: str | Sequence[str] = ()) -> DataFrame:
    """mse, rmse, mae, r2 and n, per group or overall; r2 is null for one row."""
    y, e = F.col(truth).cast("double"), F.col(truth).cast("double") - F.col(pred)
    keys = as_list(by)
    sums = df.groupBy(*keys) if keys else df.groupBy()
    out = sums.agg(
        F.count(e).alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop(F.when(e.isNotNull(), y)).alias("__v")
    )
    r2 = F.when(F.col("n") > 1, F.when(F.col("__v") > 0, 1 - F.col("mse") / F.col("__v")).otherwise(F.when(F.col("mse") == 0, 1.0).otherwise(0.0)))
    return out.select(*keys, "mse", F.sqrt("mse").alias("rmse"), "mae", r2.alias("r2"), "n")


def retrain_candidates(scores: DataFrame, train: DataFrame, key: str, score: str, above: float = 0.20, min_rows: int = 50) -> DataFrame:
    """Keys with a score above the limit and enough training rows."""
    enough = train.groupBy(key).agg(F.count(F.lit(1)).alias("n_train")).filter(F.col("n_train") >= min_rows)
    return scores.filter(F.col(score) > above).join(enough, key)


def blend(df: DataFrame, preds: Sequence[str], weights: Column, name: str = "blend") -> DataFrame:
    """Weighted sum of prediction columns, weights from an array column."""
    total = F.lit(0.0)
    for i, p in enumerate(preds):
        total = total + F.col(p) * F.get(weights, F.lit(i))
    return df.withColumn(name, total)


def with_weights(df: DataFrame, weights: DataFrame, key: str, column: str = "weights", default: Sequence[float] = (0.5, 0.5)) -> DataFrame:
    """Per-key weights, or the default where none (or too few) are known."""
    side = weights.select(key, F.col(column).alias("__w"))
    known = F.when(F.size("__w") >= len(default), F.col("__w"))
    return df.join(side, key, "left").withColumn(column, F.coalesce(known, F.array(*[F.lit(float(w)) for w in default]))).drop("__w")


def weight_grid(n: int = 3, step: float = 0.25) -> list[list[float]]:
    """All weight vectors in multiples of ``step`` that sum to one."""
    def extend(left: int, parts: int) -> list[list[int]]:
        return [[left]] if parts == 1 else [[i, *rest] for i in range(left + 1) for rest in extend(left - i, parts - 1)]

    units = round(1 / step)
    return [[u * step for u in combo] for combo in extend(units, n)]


def best_weights(df: DataFrame, truth: str, preds: Sequence[str], by: str | Sequence[str], step: float = 0.25) -> DataFrame:
    """Per group the weight vector with the smallest rmse.

    The error of every blend is a quadratic form in the residual products, so
    one pass over the rows gives the whole grid; the first best vector wins.
    """
    keys = as_list(by)
    n = len(preds)
    res = [F.col(p) - F.col(truth).cast("double") for p in preds]
    cross = {(i, j): F.avg(res[i] * res[j]) for i in range(n) for j in range(i, n)}
    moments = df.groupBy(*keys).agg(*[c.alias(f"m{i}_{j}") for (i, j), c in cross.items()])
    candidates = []
    for pos, w in enumerate(weight_grid(n, step)):
        mse = F.lit(0.0)
        for (i, j) in cross:
            mse = mse + F.col(f"m{i}_{j}") * (w[i] * w[j] * (1 if i == j else 2))
        # weights sum to one, so the blend residual is the weighted residual
        candidates.append(F.struct(F.round(mse, 12).alias("mse"), F.lit(pos).alias("pos"), F.array(*[F.lit(x) for x in w]).alias("weights")))
    best = F.array_min(F.array(*candidates))
    return moments.select(*keys, best.alias("b")).select(*keys, "b.weights", F.sqrt(F.greatest("b.mse", F.lit(0.0))).alias("rmse"))
