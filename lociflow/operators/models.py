"""Logistic models per fold, fitted by aggregation: each Newton step of all folds is one pass over the rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _score(beta: Sequence[float], features: Sequence[str]) -> Column:
    return sum((F.lit(float(b)) * F.col(c) for b, c in zip(beta[1:], features)), F.lit(float(beta[0])))


def _probability(z: Column) -> Column:
    # greatest and least pass over nulls, which would make a missing predictor a certain one
    return F.when(z.isNotNull(), 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z)))))


def _by_fold(fold: str, betas: dict[int, np.ndarray], features: Sequence[str]) -> Column:
    return F.coalesce(*[F.when(F.col(fold) == k, _score(b, features)) for k, b in betas.items()])


def fit_complements(df: DataFrame, features: Sequence[str], label: str, fold: str, folds: int, l2: float = 1.0, firth: bool = False, steps: int = 25, tolerance: float = 1e-8) -> dict[int, np.ndarray]:
    """For each fold the coefficients, intercept first, of the model on all other folds.

    Minimises the negative log likelihood plus ``l2`` / 2 times the squared coefficients without the intercept; with
    ``firth`` the likelihood carries half the log determinant of the information instead, which keeps separated data
    finite. Each step sums gradients and information of every held-out fold in one job; the driver solves systems of the
    features' size. Folds whose complement has one class are left out. Features must be few and not null.
    """
    d = len(features) + 1
    xs = [F.lit(1.0), *[F.col(c).cast("double") for c in features]]
    rows = df.select(F.col(fold).alias("_f"), F.col(label).cast("double").alias("_y"), *features).where(F.col("_y").isNotNull())
    counts = rows.groupBy("_f").agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("p")).collect()  # one row per fold
    live = [k for k in range(folds) if 0 < sum(r.p for r in counts if r._f != k) < sum(r.n for r in counts if r._f != k)]
    betas = {k: np.zeros(d) for k in live}
    halves = [(i, j) for i in range(d) for j in range(i, d)]
    spread = rows.withColumn("_k", F.explode(F.array(*map(F.lit, live)))).where("_f <> _k") if live else rows.limit(0)
    for _ in range(steps if live else 0):
        p = _probability(_by_fold("_k", betas, features))
        w = p * (1 - p)
        terms = spread.withColumns({"_p": p, "_w": w})
        information = lambda: terms.groupBy("_k").agg(*[F.sum(F.col("_w") * xs[i] * xs[j]).alias(f"h{i}_{j}") for i, j in halves])
        full = {}

        def matrix(r):
            h = np.zeros((d, d))
            for i, j in halves:
                h[i, j] = h[j, i] = r[f"h{i}_{j}"]
            return h

        if firth:
            full = {r._k: matrix(r) for r in information().collect()}
            inverse = {k: np.linalg.pinv(h) for k, h in full.items()}
            hat = F.coalesce(*[F.when(F.col("_k") == k, F.col("_w") * sum((F.lit(float(v[i, j] * (1 if i == j else 2))) * xs[i] * xs[j] for i, j in halves), F.lit(0.0))) for k, v in inverse.items()])
            residual = F.col("_y") - F.col("_p") + hat * (0.5 - F.col("_p"))
        else:
            residual = F.col("_y") - F.col("_p")
        sums = terms.groupBy("_k").agg(*[F.sum(residual * x).alias(f"g{i}") for i, x in enumerate(xs)], *[F.sum(F.col("_w") * xs[i] * xs[j]).alias(f"h{i}_{j}") for i, j in halves])
        largest = 0.0
        for r in sums.collect():  # one row per fold
            g, h = np.array([r[f"g{i}"] for i in range(d)]), matrix(r)
            if not firth:
                penalty = np.diag([0.0] + [l2] * (d - 1))
                g, h = g - penalty @ betas[r._k], h + penalty
            step = np.linalg.lstsq(h, g, rcond=None)[0]
            step *= min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
            betas[r._k] = betas[r._k] + step
            largest = max(largest, np.abs(step).max())
        if largest < tolerance:
            break
    return betas


def out_of_fold(df: DataFrame, features: Sequence[str], label: str, fold: str, folds: int, **options) -> DataFrame:
    """Adds ``oof``: the linear predictor of the model that did not see the row's fold, null where there is none."""
    betas = fit_complements(df, features, label, fold, folds, **options)
    return df.withColumn("oof", _by_fold(fold, betas, features) if betas else F.lit(None).cast("double"))


def log_likelihood(df: DataFrame, z: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Bernoulli log likelihood of a linear predictor; null predictors count as rows but add nothing."""
    p = _probability(F.col(z))
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col(label) == 1, F.ln(p)).otherwise(F.ln(1 - p))).alias("loglik"))
