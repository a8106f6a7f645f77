"""Model training and scoring as Spark jobs.

Pooled models use pyspark.ml. Per-entity linear models are solved from moments:
Spark aggregates means and covariances per entity, and only those few numbers
reach Python, so an entity may have any number of rows.
"""

from __future__ import annotations

import itertools
import random
from collections.abc import Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool
from typing import Any

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entitystats.operators.calibration import regression_metrics
from entitystats.operators.isotonic import apply_blocks, isotonic_blocks
from entitystats.operators.normalize import CONTEXT_FLAGS, ablate, numeric_columns
from entitystats.session import join_per_key, settled
from entitystats.skew import as_list

#: Blend weights, penalties and seed - fixed values.
WEIGHTS = {"rf": 0.45, "gbt": 0.45, "elastic": 0.1}
WEIGHTS_WITHOUT_BOOSTING = {"rf": 0.6, "elastic": 0.4}
ALPHA, L1_RATIO, SEED = 0.1, 0.5, 42

#: Parameters under which boosted trees meet rows only through counts and sums of labels per feature values.
SUMMED = {"maxBins", "maxDepth", "maxIter", "minInfoGain", "stepSize"}
#: Rows of counts up to which a search fits boosted trees to them; of so many, Spark reads every one for its split points.
MAX_CELLS = 10_000

#: Features whose use is examined separately - fixed values.
CONTEXTUAL = [
    "is_playoff", "is_national_tv", "is_rivalry", "travel_distance_km", "opp_altitude_m", "is_high_altitude_opp",
    "is_contract_year", "is_all_star", "recent_awards_count", "trade_sentiment", *CONTEXT_FLAGS,
]


def filled(df: DataFrame, features: Sequence[str], target: str | None = None) -> DataFrame:
    """Features as doubles with nulls as 0, and the label as a double; rows without a label are left out."""
    out = df.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features})
    return out if target is None else out.withColumn("label", F.col(target).cast("double")).filter("label IS NOT NULL")


def assembled(df: DataFrame, features: Sequence[str], target: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Feature vector with nulls as 0, and the label as a double; rows without a label are left out."""
    out = VectorAssembler(inputCols=list(features), outputCol="features").transform(filled(df, features, target))
    return out.select(*keep, *(["label"] if target else []), "features") if keep or target else out


@dataclass
class Ensemble:
    """Fitted models with blend weights; ``transform`` adds one column per model and ``prediction``."""

    features: list[str]
    models: dict[str, Any]
    weights: dict[str, float]

    def transform(self, df: DataFrame) -> DataFrame:
        out = assembled(df, self.features)
        for name, model in self.models.items():
            out = model.setPredictionCol(f"pred_{name}").transform(out)
        total = sum(self.weights[n] for n in self.models)
        blend = F.lit(0.0)
        for name in self.models:
            blend = blend + F.col(f"pred_{name}") * (self.weights[name] / total)
        return out.withColumn("prediction", blend).drop("features")


def penalised(data: DataFrame, alpha: float, l1_ratio: float, features: str = "features", label: str = "label") -> LinearRegression:
    """Linear regression for error / 2n + alpha (l1 |w| + (1 - l1) w^2 / 2).

    Spark divides the square penalty by the label's deviation; the parameters
    make up for it.
    """
    sd = data.agg(F.stddev_samp(label)).first()[0] or 1.0
    first, second = alpha * l1_ratio, alpha * (1 - l1_ratio) * sd
    total = first + second
    return LinearRegression(
        featuresCol=features, labelCol=label, regParam=total, elasticNetParam=first / total if total else 0.0, standardization=False, maxIter=500, tol=1e-9
    )


def _fit(kind: str, data: DataFrame, trees: int, depth: int, seed: int):
    """A fitted model of the given kind on (label, features)."""
    return (penalised(data, ALPHA, L1_RATIO) if kind == "elastic" else _learner(kind, trees, depth, seed)).fit(data)


def _learner(kind: str, trees: int, depth: int, seed: int):
    common = {"featuresCol": "features", "labelCol": "label"}
    if kind == "rf":
        return RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=seed, **common)
    if kind == "gbt":
        return GBTRegressor(maxIter=trees, maxDepth=min(depth, 6), stepSize=0.3, seed=seed, **common)
    raise ValueError(f"unknown learner {kind}")


def fit_ensemble(
    df: DataFrame, features: Sequence[str], target: str, weights: dict[str, float] | None = None, trees: int = 100, depth: int = 5, seed: int = SEED
) -> Ensemble:
    """Forest, boosted trees and elastic net with blend weights."""
    weights = weights or WEIGHTS
    data = assembled(df, features, target).persist()
    try:
        models = {k: _fit(k, data, trees, depth, seed) for k in weights}
    finally:
        data.unpersist()
    return Ensemble(list(features), models, dict(weights))


@dataclass
class Stacked:
    base: Ensemble
    meta: Any

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.base.transform(df).drop("prediction")
        names = [f"pred_{n}" for n in self.base.models]
        joined = VectorAssembler(inputCols=names, outputCol="features").transform(out)
        return self.meta.setPredictionCol("prediction").transform(joined).drop("features")


def fit_stacked(
    df: DataFrame, features: Sequence[str], target: str, ident: str | None, kinds: Sequence[str] = ("rf", "elastic"), folds: int = 5, trees: int = 50, seed: int = SEED,
    fold: Column | None = None,
) -> Stacked:
    """Out-of-fold predictions feed a ridge model; the base models are refitted on all rows.

    A row's fold follows from a hash of its id, so every rerun agrees, or is given.
    """
    data = assembled(df.withColumn("fold", F.pmod(F.xxhash64(ident), F.lit(folds)) if fold is None else fold), features, target, keep=["fold"]).persist()
    try:
        parts = []
        for k in range(folds):
            out = data.filter(F.col("fold") == k)
            rest = data.filter(F.col("fold") != k)
            for kind in kinds:
                out = _fit(kind, rest, trees, 5, seed).setPredictionCol(f"pred_{kind}").transform(out)
            parts.append(out.drop("features"))
        oof = parts[0]
        for p in parts[1:]:
            oof = oof.unionByName(p)
        stacked = VectorAssembler(inputCols=[f"pred_{k}" for k in kinds], outputCol="features").transform(oof)
        points = stacked.select("features", "label")
        # ridge with penalty 1 on the sum of squares, not on its mean
        meta = penalised(points, 1.0 / max(points.count(), 1), 0.0).fit(points)
        models = {k: _fit(k, data, trees, 5, seed) for k in kinds}
    finally:
        data.unpersist()
    return Stacked(Ensemble(list(features), models, dict.fromkeys(kinds, 1.0)), meta)


def fit_scaled_elastic(df: DataFrame, features: Sequence[str], target: str, alpha: float = ALPHA, l1_ratio: float = L1_RATIO) -> tuple[PipelineModel, dict[str, float]]:
    """Standardised elastic net with its coefficient per feature."""
    data = assembled(df, features, target)
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)
    model = Pipeline(stages=[scaler, penalised(data, alpha, l1_ratio, "scaled")]).fit(data)
    return model, dict(zip(features, [float(c) for c in model.stages[-1].coefficients]))


def importances(df: DataFrame, features: Sequence[str], target: str, kind: str = "rf", trees: int = 50, seed: int = SEED) -> DataFrame:
    """(feature, importance), largest first."""
    model = _learner(kind, trees, 5, seed).fit(assembled(df, features, target))
    rows = [(f, float(v)) for f, v in zip(features, model.featureImportances.toArray())]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def contextual_importance(df: DataFrame, target: str, candidates: Sequence[str] = tuple(CONTEXTUAL), min_rows: int = 10, trees: int = 50) -> DataFrame:
    """Importance of the contextual features that are present; empty with too few rows."""
    numeric = set(numeric_columns(df))
    found = [c for c in candidates if c in numeric]
    if not found or df.limit(min_rows).count() < min_rows:
        return df.sparkSession.createDataFrame([], "feature string, importance double")
    return importances(df.withColumn(target, F.coalesce(F.col(target).cast("double"), F.lit(0.0))), found, target, trees=trees)


def prune_contextual(df: DataFrame, target: str, threshold: float = 0.01, **options) -> tuple[DataFrame, list[str]]:
    """Drop contextual features below the threshold; (rows, kept names)."""
    ranked = contextual_importance(df, target, **options).collect()  # one row per feature
    keep = [r["feature"] for r in ranked if r["importance"] >= threshold]
    return df.drop(*[r["feature"] for r in ranked if r["feature"] not in keep]), keep


def eliminate(df: DataFrame, target: str, n_features: int | None = None, features: Sequence[str] | None = None, step: int = 1, trees: int = 50, seed: int = SEED) -> list[str]:
    """Recursive elimination by forest importance down to ``n_features``."""
    left = list(features or [c for c in numeric_columns(df) if c != target])
    if not left:
        return []
    goal = n_features or max(1, min(10, len(left) // 2))
    data = df.select(target, *left).persist()
    try:
        while len(left) > goal:
            ranked = importances(data, left, target, trees=trees, seed=seed).collect()  # one row per feature
            drop = {r["feature"] for r in ranked[::-1][: min(step, len(left) - goal)]}
            left = [f for f in left if f not in drop]
    finally:
        data.unpersist()
    return left


def _fold(draw: Column, folds: int) -> Column:
    """The fold of ``CrossValidator`` that holds a row out, by the row's draw; -1 where none does."""
    return F.coalesce(*[F.when((draw >= k * (1 / folds)) & (draw < (k + 1) * (1 / folds)), k) for k in range(folds)], F.lit(-1))


def counted_folds(df: DataFrame, features: Sequence[str], target: str, folds: int, seed: int = SEED) -> DataFrame | None:
    """(fold, weight, label, spread, features): the rows of a fold with equal features as one, with their number, mean label and its variance.

    Trees that split by squared error take the same splits and means from these
    as from the rows. None if there are more than ``MAX_CELLS`` of them.
    """
    x = [f"x{i}" for i in range(len(features))]
    rows = filled(df, features, target).withColumn("__r", F.rand(seed))
    rows = rows.select(_fold(F.col("__r"), folds).alias("fold"), "label", *[F.col(f).alias(c) for f, c in zip(features, x)])
    cells = rows.groupBy("fold", *x).agg(F.count(F.lit(1)).cast("double").alias("weight"), F.avg("label").alias("label"), F.var_pop("label").alias("spread"))
    table = settled(cells.limit(MAX_CELLS + 1)).coalesce(1)
    return VectorAssembler(inputCols=x, outputCol="features").transform(table).drop(*x) if table.count() <= MAX_CELLS else None


def random_search(
    df: DataFrame, features: Sequence[str], target: str, space: dict[str, Sequence[Any]], kind: str = "rf", trials: int = 10, folds: int = 3, parallelism: int = 2, seed: int = SEED
) -> tuple[dict[str, Any], DataFrame]:
    """Best of ``trials`` random parameter sets by cross-validated rmse; (best, all results).

    Rows fall into the folds of ``CrossValidator``; unlike there, no model is
    fitted to all rows in the end, and folds are not kept beside the rows.
    Boosted trees pass over their rows several times a tree, so they are fitted
    to counted rows where these are few; forests draw single rows.
    """
    learner = _learner(kind, 20, 5, seed)
    combos = [dict(zip(space, v)) for v in itertools.product(*space.values())]
    picked = random.Random(seed).sample(combos, min(trials, len(combos)))
    grid = [{learner.getParam(k): v for k, v in p.items()} for p in picked]
    evaluator = RegressionEvaluator(metricName="mse")
    counted = counted_folds(df, features, target, folds, seed) if kind == "gbt" and SUMMED.issuperset(space) else None
    if counted is None:
        data = assembled(df, features, target).withColumn("__r", F.rand(seed)).withColumn("fold", _fold(F.col("__r"), folds)).persist()
    else:
        learner, evaluator, data = learner.setWeightCol("weight"), evaluator.setWeightCol("weight"), counted.persist()
    errors = np.zeros((folds, len(grid)))
    try:
        with ThreadPool(min(parallelism, len(grid))) as pool:
            for k in range(folds):
                rest = data.filter(F.col("fold") == k)
                models = learner.fitMultiple(data.filter(F.col("fold") != k), grid)
                # the error of a mean leaves out how far its rows lie from it
                inside = 0.0 if counted is None else rest.agg(F.sum(F.col("weight") * F.col("spread")) / F.sum("weight")).first()[0]

                def score(_, models=models, rest=rest, inside=inside):
                    i, model = next(models)
                    return i, np.sqrt(evaluator.evaluate(model.transform(rest)) + inside)

                for i, error in pool.imap_unordered(inheritable_thread_target(df.sparkSession)(score), range(len(grid))):
                    errors[k, i] = error
    finally:
        data.unpersist()
    scores = [float(m) for m in errors.mean(axis=0)]
    rows = [(str(sorted(p.items())), s) for p, s in zip(picked, scores)]
    table = df.sparkSession.createDataFrame(rows, "params string, rmse double").orderBy("rmse")
    return picked[int(np.argmin(scores))], table


# -- per-entity linear models ------------------------------------------------
def elastic_net_from_moments(mean_x, mean_y, cov, cov_y, alpha: float, l1_ratio: float, rounds: int = 1000, tol: float = 1e-10):
    """Coordinate descent on covariances; returns (intercept, coefficients)."""
    p = len(mean_x)
    w = np.zeros(p)
    for _ in range(rounds):
        moved = 0.0
        for j in range(p):
            if cov[j, j] <= 0:
                continue
            rho = cov_y[j] - cov[j] @ w + cov[j, j] * w[j]
            new = np.sign(rho) * max(abs(rho) - alpha * l1_ratio, 0.0) / (cov[j, j] + alpha * (1 - l1_ratio))
            moved = max(moved, abs(new - w[j]) * np.sqrt(cov[j, j]))
            w[j] = new
        if moved < tol:
            break
    return float(mean_y - mean_x @ w), w


def fit_per_entity(
    df: DataFrame, entity: str | Sequence[str], features: Sequence[str], target: str, alpha: float = ALPHA, l1_ratio: float = L1_RATIO, min_rows: int = 10
) -> DataFrame:
    """(entity..., n_rows, status, intercept, coefficients) - one elastic net per entity.

    ``alpha=0`` is least squares, ``l1_ratio=0`` ridge. Entities with fewer than
    ``min_rows`` rows get status 'insufficient_rows'.
    """
    keys, p = as_list(entity), len(features)
    rows = df.select(*keys, F.col(target).cast("double").alias("y"), *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f"x{i}") for i, f in enumerate(features)])
    rows = rows.filter("y IS NOT NULL")
    x = [F.col(f"x{i}") for i in range(p)]
    moments = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.array(*[F.avg(c) for c in x]).alias("mx"), F.avg("y").alias("my"),
        F.array(*[F.covar_pop(x[i], x[j]) for i in range(p) for j in range(i, p)]).alias("cx"), F.array(*[F.covar_pop(c, F.col("y")) for c in x]).alias("cy"),
    )
    upper = np.triu_indices(p)

    @F.pandas_udf("struct<intercept double, coefficients array<double>>")
    def solve(n: pd.Series, mx: pd.Series, my: pd.Series, cx: pd.Series, cy: pd.Series) -> pd.DataFrame:
        out = []
        for rows_, a, b, c, d in zip(n, mx, my, cx, cy):
            if rows_ < min_rows:
                out.append((None, None))
                continue
            cov = np.zeros((p, p))
            cov[upper] = c
            cov = cov + np.triu(cov, 1).T
            icpt, w = elastic_net_from_moments(np.asarray(a), b, cov, np.asarray(d), alpha, l1_ratio)
            out.append((icpt, w.tolist()))
        return pd.DataFrame(out, columns=["intercept", "coefficients"])

    fitted = moments.withColumn("m", solve("n_rows", "mx", "my", "cx", "cy"))
    return fitted.select(*keys, "n_rows", F.when(F.col("n_rows") >= min_rows, "ok").otherwise("insufficient_rows").alias("status"), "m.intercept", "m.coefficients")


def predict_per_entity(df: DataFrame, models: DataFrame, entity: str | Sequence[str], features: Sequence[str], name: str = "prediction") -> DataFrame:
    """Adds the entity's linear prediction; null where it has no model."""
    keys = as_list(entity)
    total = F.col("intercept")
    for i, f in enumerate(features):
        total = total + F.coalesce(F.col(f).cast("double"), F.lit(0.0)) * F.get("coefficients", F.lit(i))
    out = join_per_key(df, models.select(*keys, "intercept", "coefficients"), keys, "left")
    return out.withColumn(name, total).drop("intercept", "coefficients")


def evaluation_report(df: DataFrame, entity: str, target: str, models: DataFrame, features: Sequence[str], entities: DataFrame | None = None) -> DataFrame:
    """Error measures per entity with a status: ok, missing_model or no_rows."""
    everyone = (entities if entities is not None else df).select(entity).distinct()
    scored = predict_per_entity(df, models, entity, features)
    metrics = regression_metrics(scored.filter("prediction IS NOT NULL"), target, "prediction", entity)
    have = models.filter(F.col("intercept").isNotNull()).select(entity, F.lit(True).alias("__model"))
    out = everyone.join(have, entity, "left").join(metrics, entity, "left")
    status = F.when(F.col("__model").isNull(), "missing_model").when(F.col("n").isNull(), "no_rows").otherwise("ok")
    return out.withColumn("status", status).drop("__model")


def ablation(
    train: DataFrame, test: DataFrame, entity: str, features: Sequence[str], target: str, prefixes: Sequence[str] = ("adv_", "multi_"), names: Sequence[str] = tuple(CONTEXT_FLAGS), **options
) -> DataFrame:
    """Per entity: rmse with and without a feature group, and the difference."""
    def rmse(tr: DataFrame, te: DataFrame, label: str) -> DataFrame:
        scored = predict_per_entity(te, fit_per_entity(tr, entity, features, target, **options), entity, features)
        return regression_metrics(scored.filter("prediction IS NOT NULL"), target, "prediction", entity).select(entity, F.col("rmse").alias(label))

    full = rmse(train, test, "rmse_full")
    base = rmse(ablate(train, prefixes, names), ablate(test, prefixes, names), "rmse_without")
    return full.join(base, entity).withColumn("delta_rmse", F.col("rmse_without") - F.col("rmse_full"))


def score_lines(df: DataFrame, prediction: Column, line: Column, fallback_mean: Column) -> DataFrame:
    """Over/under columns from a model prediction, or from the recent mean where there is none."""
    from entitystats.functions.scoring import heuristic_probability, model_probability, score_columns

    over = F.when(prediction.isNotNull(), model_probability(prediction, line)).otherwise(heuristic_probability(fallback_mean, line))
    return df.withColumns(score_columns(F.coalesce(prediction, fallback_mean), over))


# -- calibrators ---------------------------------------------------------------
def linear_calibrators(df: DataFrame, entity: str | Sequence[str], truth: str, pred: str, min_pairs: int = 3) -> DataFrame:
    """(entity..., n, slope, intercept) for entities with enough pairs."""
    y, x = F.col(truth).cast("double"), F.col(pred).cast("double")
    slope = F.coalesce(F.regr_slope(y, x), F.lit(0.0))
    fit = df.filter(y.isNotNull() & x.isNotNull()).groupBy(*as_list(entity)).agg(
        F.count(F.lit(1)).alias("n"), slope.alias("slope"), F.avg(y).alias("my"), F.avg(x).alias("mx")
    )
    return fit.filter(F.col("n") >= min_pairs).select(*as_list(entity), "n", "slope", (F.col("my") - F.col("slope") * F.col("mx")).alias("intercept"))


def isotonic_calibrators(df: DataFrame, entity: str, truth: str, pred: str, min_pairs: int = 3, max_rows: int | None = None) -> DataFrame:
    """(entity, n, lo, hi, y, w): the non-decreasing fit of each entity as blocks."""
    return isotonic_blocks(df, entity, truth, pred, min_pairs, max_rows)


def apply_isotonic(df: DataFrame, calibrators: DataFrame, entity: str, pred: str, name: str = "calibrated", max_rows: int | None = None) -> DataFrame:
    """Adds the calibrated value; the raw one where the entity has no calibrator."""
    return apply_blocks(df, calibrators, entity, pred, name, max_rows)


def apply_linear(df: DataFrame, calibrators: DataFrame, entity: str, pred: str, name: str = "calibrated") -> DataFrame:
    out = join_per_key(df, calibrators.select(entity, "slope", "intercept"), [entity], "left")
    return out.withColumn(name, F.coalesce(F.col("slope") * F.col(pred) + F.col("intercept"), F.col(pred).cast("double"))).drop("slope", "intercept")


def calibration_report(df: DataFrame, entity: str, truth: str, pred: str, method: str = "isotonic", min_pairs: int = 3) -> DataFrame:
    """Per entity error before and after calibration."""
    if method == "isotonic":
        cal = apply_isotonic(df, isotonic_calibrators(df, entity, truth, pred, min_pairs), entity, pred)
    else:
        cal = apply_linear(df, linear_calibrators(df, entity, truth, pred, min_pairs), entity, pred)
    e0, e1 = F.col(pred) - F.col(truth), F.col("calibrated") - F.col(truth)
    return cal.groupBy(entity).agg(
        F.count(F.lit(1)).alias("n"), F.avg(e0 * e0).alias("mse_before"), F.avg(e1 * e1).alias("mse_after"), F.avg(F.abs(e0)).alias("mae_before"), F.avg(F.abs(e1)).alias("mae_after")
    )


def binary_report(df: DataFrame, calibrators: DataFrame, entity: str, actual: str, prob: str) -> DataFrame:
    """Brier scores of the entities that have a calibrator, before and after; ``saved`` where they do not get worse."""
    counts = calibrators.groupBy(entity).agg(F.min("n").alias("n"))
    scored = apply_isotonic(df, calibrators, entity, prob)
    sq = lambda c: F.avg(F.pow(F.col(c) - F.col(actual), F.lit(2.0)))
    report = scored.groupBy(entity).agg(sq(prob).alias("brier_raw"), sq("calibrated").alias("brier_cal"))
    return counts.join(report, entity).withColumn("saved", F.col("brier_cal") <= F.col("brier_raw"))


def binary_calibrators(df: DataFrame, entity: str, actual: str, prob: str, min_rows: int = 5, max_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(calibrators that do not make the Brier score worse, the report on all that were fitted)."""
    fitted = settled(isotonic_calibrators(df, entity, actual, prob, min_rows, max_rows))
    report = settled(binary_report(df, fitted, entity, actual, prob))
    return fitted.join(report.filter("saved").select(entity), entity, "left_semi"), report


def global_isotonic(df: DataFrame, truth: str, pred: str):
    """One calibrator for all rows."""
    return IsotonicRegression(featuresCol="x", labelCol="y").fit(df.select(F.col(pred).cast("double").alias("x"), F.col(truth).cast("double").alias("y")))


def coefficients_table(models: DataFrame, entity: str, features: Sequence[str]) -> DataFrame:
    """Long form: (entity, feature, coefficient)."""
    pairs = F.explode(F.arrays_zip(F.array(*[F.lit(f) for f in features]).alias("feature"), F.col("coefficients").alias("coefficient"))).alias("z")
    return models.filter("coefficients IS NOT NULL").select(entity, pairs).select(entity, F.col("z.feature"), F.col("z.coefficient"))


