"""Tree ensembles, a kernel machine by random features, and hybrids."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenfold.functions import damage as D
from evenfold.operators.fit.bagged import Forest, fold_forests
from evenfold.roles import DEFAULT, Roles


def forest(trees: int, leaf: int = 3, features: float = 0.85, seed: int = 0, depth: int = 30) -> Forest:
    """Stands for both bagged and randomised-threshold trees; thresholds are not drawn at random but chosen among 32 bins."""
    return Forest(trees, leaf, features, seed, depth)


def boosting(rounds: int = 20, depth: int = 2, leaf: int = 4, rate: float = 0.1, seed: int = 0) -> GBTRegressor:
    return GBTRegressor(maxIter=rounds, maxDepth=depth, minInstancesPerNode=leaf, stepSize=rate, seed=seed,
                        featuresCol="_x", labelCol="_y", predictionCol="_p")


@dataclass(frozen=True)
class Ridge:
    """Ridge without intercept; ``alpha`` is the penalty of the sum of squares, not of its mean, divided by the spread of the targets, as Spark ML does."""

    alpha: float


def kernel_ridge(alpha: float, n_rows: int = 0) -> Ridge:
    """Ridge on random features, solved for all folds from one pass of sums; the number of rows has no part in it."""
    return Ridge(alpha)


@dataclass(frozen=True, eq=False)
class RandomFeatures:
    """cos(frequencies x + phases), scaled."""

    inputs: list[str]
    frequencies: np.ndarray
    phases: np.ndarray

    def of(self, x: np.ndarray) -> np.ndarray:
        return np.cos(x @ self.frequencies.T + self.phases) * math.sqrt(2.0 / len(self.phases))


def random_features(inputs: list[str], length: float, count: int, seed: int) -> RandomFeatures:
    """Features whose inner product approximates the Matern-3/2 kernel (Rahimi and Recht 2007).

    Frequencies follow a multivariate t distribution with three degrees of freedom.
    """
    rng = np.random.default_rng(seed)
    d = len(inputs)
    freq = rng.normal(size=(count, d)) / np.sqrt(rng.chisquare(3, size=(count, 1)) / 3.0) / length
    return RandomFeatures(inputs, freq, rng.uniform(0, 2 * math.pi, size=count))


def number(name: str) -> Column:
    """An input as a double; null and NaN are errors."""
    x = F.col(name).cast("double")
    return F.when(x.isNull() | F.isnan(x), F.raise_error(F.lit(f"null or NaN in input {name}")).cast("double")).otherwise(x)


def fold_products(rows: DataFrame, inputs: list[str], of, target: str, fold: str, event: str) -> dict[int, np.ndarray]:
    """Per fold the products of [features, target, 1] summed over its events; a partition adds up its own rows."""
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            own, y, *xs = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for f in np.unique(own):
                at = own == f
                z = np.column_stack([of(np.column_stack([x[at] for x in xs])), y[at], np.ones(at.sum())])
                total[int(f)] = total.get(int(f), 0.0) + z.T @ z
        for f, products in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(products.size, f, dtype=np.int32)), pa.array(np.arange(products.size, dtype=np.int32)), pa.array(products.ravel())], names=["fold", "cell", "v"])

    train = rows.where(F.col(event) & F.col(target).isNotNull() & F.col(fold).isNotNull()).select(F.col(fold).cast("int"), F.col(target).cast("double"), *[number(n) for n in inputs])
    sums = train.mapInArrow(part, "fold int, cell int, v double").groupBy("fold", "cell").agg(F.sum("v").alias("v")).toArrow().to_pandas().sort_values(["fold", "cell"])
    return {int(f): (v := own["v"].to_numpy()).reshape(math.isqrt(len(v)), -1) for f, own in sums.groupby("fold")}


def fold_ridges(rows: DataFrame, inputs: list[str], ridge: Ridge, target: str, folds: list[int], fold: str, event: str, out: str, features: RandomFeatures | None, centred: bool) -> DataFrame:
    """Ridges of all folds: one pass of sums, a small system a fold, and one pass that predicts."""
    used, of = (features.inputs, features.of) if features is not None else (inputs, lambda x: x)
    products = fold_products(rows, used, of, target, fold, event)
    models = {}
    for f in folds:
        others = [p for k, p in products.items() if k != f]
        if others:
            total = sum(others)
            n, mean = total[-1, -1], total[-2, -1] / total[-1, -1] if centred else 0.0
            gram, by_y = total[:-2, :-2], total[:-2, -2] - mean * total[:-2, -1]
            first, second = total[-2, -1] / n, total[-2, -2] / n
            spread = math.sqrt(max(second - first * first, 0.0))
            size = spread if spread > 1e-12 * abs(first) else abs(first - mean)
            models[f] = (np.linalg.lstsq(gram + ridge.alpha / size * np.eye(len(gram)), by_y)[0] if size > 0 else np.zeros(len(gram)), mean)

    @F.pandas_udf("double")
    def predicted(own: pd.Series, *xs: pd.Series) -> pd.Series:
        result = np.full(len(own), np.nan)
        for f in np.unique(own):
            if f in models:
                at = (own == f).to_numpy()
                result[at] = of(np.column_stack([x.to_numpy()[at] for x in xs])) @ models[f][0] + models[f][1]
        return pd.Series(result)

    return rows.where(F.col(fold).isin(folds)).withColumn(out, predicted(F.col(fold).cast("int"), *[number(n) for n in used]))


def fold_predictions(rows: DataFrame, inputs: list[str], estimator, target: str, folds: list[int], fold: str = "fold",
                     event: str = DEFAULT.event, out: str = "pred", features: RandomFeatures | None = None, centred: bool = False) -> DataFrame:
    """Fit on the events of all other folds and predict every row of the fold; one model per fold.

    ``estimator`` is an estimator, or a function of the fold's number of training rows. With
    ``centred`` it learns the target less its mean over the training rows, which is added again.
    Forests are grown from sums of cells and ridges solved from sums of products, all folds
    together; random features are for ridges.
    """
    if isinstance(estimator, Forest):
        return fold_forests(rows, inputs, estimator, target, folds, fold, event, DEFAULT.row, out)
    if isinstance(estimator, Ridge):
        return fold_ridges(rows, inputs, estimator, target, folds, fold, event, out, features, centred)
    data = VectorAssembler(inputCols=inputs, outputCol="_x").transform(rows)
    parts = []
    per_fold = rows.where(F.col(event)).groupBy(fold).agg(F.count(target).alias("n"), F.sum(target).alias("s")).collect()
    for f in folds:
        others = [r for r in per_fold if r[fold] != f]
        n = sum(r["n"] for r in others)
        mean = sum(r["s"] or 0.0 for r in others) / n if centred and n else 0.0
        train = data.where(F.col(event) & (F.col(fold) != f)).withColumn("_y", F.col(target) - mean)
        model = estimator if hasattr(estimator, "fit") else estimator(n)
        fitted = model.fit(train.select("_x", "_y"))
        parts.append(fitted.transform(data.where(F.col(fold) == f)).withColumn(out, F.col("_p") + mean).drop("_x", "_p"))
    result = parts[0]
    for p in parts[1:]:
        result = result.unionByName(p)
    return result


def ensemble(wide: DataFrame, members: list[str], out: str = "ensemble") -> DataFrame:
    total = F.col(members[0])
    for m in members[1:]:
        total = total + F.col(m)
    return wide.withColumn(out, total / len(members))


def hybrid(rows: DataFrame, base: str, residual_inputs: list[str], estimator, folds: list[int], eta: float, support: Column,
           fold: str = "fold", features: RandomFeatures | None = None, roles: Roles = DEFAULT) -> DataFrame:
    """Trunk plus gated residual: a learner on trunk residuals of training events, faded by support."""
    target = rows.withColumn("_residual", F.col(roles.y) - F.col(base))
    learned = fold_predictions(target, residual_inputs, estimator, "_residual", folds, fold, roles.event, "_correction", features)
    return learned.withColumn(roles.pred, D.gated_blend(F.col(base), F.col("_correction"), support, eta)).drop("_residual", "_correction")
