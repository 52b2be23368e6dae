"""Walk-forward probabilities of small models, one task for each series and fold.

A fold's rows (hundreds to thousands) go to one task as a group; its model is
fitted there with numpy on the first part of the training rows and calibrated on
the rest, and its test rows are scored.  Series and folds run in parallel.  For a
single fit over more rows than a task holds, ``logistic_ml`` fits the same
objective with Spark ML.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

CAL_FRAC = 0.25


@dataclass
class Linear:
    weights: np.ndarray
    intercept: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.intercept, -500, 500)))


def fit_logistic(x: np.ndarray, y: np.ndarray, c: float = 0.1, balanced: bool = True, iterations: int = 100) -> Linear:
    """L2-penalised logistic regression (the intercept is free), by Newton steps.

    Minimises half the squared weights plus ``c`` times the log-loss, each class
    weighted to half of all rows if ``balanced``.
    """
    n, width = x.shape
    weight = np.full(n, float(c))
    if balanced:
        for label in (0.0, 1.0):
            rows = y == label
            weight[rows] *= n / (2 * max(1, rows.sum()))
    design = np.column_stack([x, np.ones(n)])
    penalty = np.r_[np.ones(width), 0.0]
    beta = np.zeros(width + 1)

    def loss(b):
        z = design @ b
        return 0.5 * (penalty * b * b).sum() + (weight * (np.logaddexp(0, z) - y * z)).sum()

    now = loss(beta)
    for _ in range(iterations):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -500, 500)))
        gradient = penalty * beta + design.T @ (weight * (p - y))
        hessian = np.diag(penalty + 1e-12) + (design * (weight * p * (1 - p))[:, None]).T @ design
        step, size = np.linalg.solve(hessian, gradient), 1.0
        while (later := loss(beta - size * step)) > now + 1e-15 * abs(now) and size > 1e-8:
            size /= 2
        if later >= now - 1e-14 * max(1.0, abs(now)) and np.abs(gradient).max() < 1e-9:
            break
        beta, now = beta - size * step, later
        if np.abs(gradient).max() < 1e-10:
            break
    return Linear(beta[:-1], float(beta[-1]))


@dataclass
class Boosted:
    """Shallow trees: each (feature, threshold, left, right) or a leaf's value."""

    base: float
    trees: list

    def probability(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.base)
        for tree in self.trees:
            margin += _predict(tree, x)
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def _predict(node, x: np.ndarray) -> np.ndarray:
    if not isinstance(node, tuple):
        return np.full(len(x), node)
    feature, cut, left, right = node
    low = x[:, feature] <= cut
    return np.where(low, _predict(left, x), _predict(right, x))


def fit_boosted(x: np.ndarray, y: np.ndarray, depth: int = 2, rounds: int = 100, rate: float = 0.05, min_leaf: int = 20, l2: float = 1.0, bins: int = 255) -> Boosted:
    """Newton boosting of the log-loss on binned values, grown depth first to
    ``depth`` levels; leaves hold ``min_leaf`` rows at least."""
    share = np.clip(y.mean(), 1e-12, 1 - 1e-12)
    base = float(np.log(share / (1 - share)))
    cuts = []
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        if len(values) <= bins:
            cuts.append((values[:-1] + values[1:]) / 2)
        else:
            cuts.append(np.unique(np.percentile(x[:, f], np.linspace(0, 100, bins + 1)[1:-1], method="midpoint")))
    binned = np.column_stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)])
    margin, trees = np.full(len(y), base), []

    def grow(rows, g, h, level):
        total_g, total_h = g[rows].sum(), h[rows].sum()
        leaf = -rate * total_g / (total_h + l2)
        if level == depth or len(rows) < 2 * min_leaf:
            return leaf
        best = (1e-12, None, None)
        for f, c in enumerate(cuts):
            if not len(c):
                continue
            b = binned[rows, f]
            sums = [np.cumsum(np.bincount(b, v, len(c) + 1))[:-1] for v in (g[rows], h[rows], np.ones(len(rows)))]
            lg, lh, ln = sums
            sound = (ln >= min_leaf) & (len(rows) - ln >= min_leaf) & (lh >= 1e-3) & (total_h - lh >= 1e-3)
            gain = np.where(sound, lg**2 / (lh + l2) + (total_g - lg) ** 2 / (total_h - lh + l2) - total_g**2 / (total_h + l2), 0.0)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], f, k)
        if best[1] is None:
            return leaf
        low = binned[rows, best[1]] <= best[2]
        return best[1], cuts[best[1]][best[2]], grow(rows[low], g, h, level + 1), grow(rows[~low], g, h, level + 1)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        tree = grow(np.arange(len(y)), p - y, p * (1 - p), 0)
        trees.append(tree)
        margin += _predict(tree, x)
    return Boosted(base, trees)


def fit_platt(p: np.ndarray, y: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """A nearly free logistic curve on the probability; one class: identity."""
    if len(np.unique(y)) < 2:
        return lambda q: q
    curve = fit_logistic(p[:, None], y, c=1e6, balanced=False, iterations=1000)
    return lambda q: curve.probability(q[:, None])


def fit_kind(kind: str, x: np.ndarray, y: np.ndarray):
    if kind == "logistic":
        return fit_logistic(x, y)
    if kind == "gbm":
        return fit_boosted(x, y)
    raise ValueError(f"unknown model kind: {kind}")


def fold_probabilities(kind: str, x: np.ndarray, y: np.ndarray, x_test: np.ndarray) -> np.ndarray:
    """Scaler and model from the first rows, calibration from the last quarter."""
    cut = int((1 - CAL_FRAC) * len(y))
    mean, scale = x[:cut].mean(axis=0), x[:cut].std(axis=0)
    scale = np.where(scale == 0, 1.0, scale)
    model = fit_kind(kind, (x[:cut] - mean) / scale, y[:cut])
    curve = fit_platt(model.probability((x[cut:] - mean) / scale), y[cut:])
    return curve(model.probability((x_test - mean) / scale))


def walk_forward(assigned: DataFrame, features: list[str], keys: list[str], kind: str, y: str = "y", position: str = "i") -> DataFrame:
    """``keys, fold, i, prob`` for test rows of :func:`..folds.assign`'s result."""
    if kind not in ("logistic", "gbm"):
        raise ValueError(f"unknown model kind: {kind}")
    ship(assigned.sparkSession)
    columns = [*keys, "fold", "role", position, y, *features]
    schema = ", ".join(f"{c} {assigned.schema[c].dataType.simpleString()}" for c in (*keys, "fold", position)) + ", prob double"
    names = [*keys, "fold", position]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(position)
        train, test = pdf[pdf["role"] == "train"], pdf[pdf["role"] == "test"]
        prob = fold_probabilities(kind, train[features].to_numpy(float), train[y].to_numpy(float), test[features].to_numpy(float))
        return test[names].assign(prob=prob)

    return assigned.select(*columns).groupBy(*keys, "fold").applyInPandas(one, schema)


def frozen(train: DataFrame, test: DataFrame, features: list[str], kind: str, y: str = "y", position: str = "i") -> DataFrame:
    """``i, prob`` of the test rows from one fit on the training rows."""
    each = train.select(position, y, *features, F.lit("train").alias("role")).unionByName(test.select(position, F.lit(None).cast("double").alias(y), *features, F.lit("test").alias("role")))
    return walk_forward(each.withColumn("fold", F.lit(0)), features, [], kind, y, position).drop("fold")


def logistic_ml(df: DataFrame, features: list[str], y: str = "y", c: float = 0.1):
    """The objective of :func:`fit_logistic` fitted by Spark ML over any number
    of rows; gives the fitted model (features assembled as ``features``)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    counts = {r[0]: r[1] for r in df.groupBy(y).count().collect()}  # two classes
    n = sum(counts.values())
    weight = F.coalesce(*[F.when(F.col(y) == k, F.lit(n / (2 * v))) for k, v in counts.items()])
    ready = VectorAssembler(inputCols=features, outputCol="features").transform(df.withColumn("_w", weight))
    return LogisticRegression(labelCol=y, weightCol="_w", regParam=1 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=5000, tol=1e-10).fit(ready)
