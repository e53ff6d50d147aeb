"""A student of fractional labels: logistic regression by reweighted least squares from Gram sums, on folds grouped by segment.

Each step is one aggregation: a row goes to the models of all folds but its own, and each model's weighted Gram matrix and right side
are sums of column expressions. The driver sees folds x features^2 numbers. A segment has one fold, so no segment is on both sides.

Defined results: labels are shares from 0 to 1; missing features count as 0; rows without label or segment are scored but not
learned from; a model without rows keeps its coefficients; a null segment is scored by the first model.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import clip


def blended(truth: Column, teacher: Column, share: float) -> Column:
    """The label that a student learns: share of the teacher's prediction, the rest of the truth; the truth where there is no teacher."""
    t = truth.cast("double")
    return clip(F.coalesce(F.lit(share) * teacher + F.lit(1 - share) * t, t), 0, 1)


def fold_of(segment: Column, folds: int) -> Column:
    """A fold for each segment, the same in each run; null for a null segment."""
    return F.when(segment.isNotNull(), F.pmod(F.xxhash64(segment), F.lit(folds)).cast("int"))


def _terms(features: list[str]) -> list[Column]:
    return [F.lit(1.0), *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features]]


def _linear(model: Column, betas: np.ndarray, terms: list[Column]) -> Column:
    """The score of the model that a row is for."""
    by_model = F.array(*[F.array(*[F.lit(float(v)) for v in b]) for b in betas])
    beta = F.get(by_model, model)
    return sum((beta[j] * t for j, t in enumerate(terms[1:], 1)), beta[0] * terms[0])


def step_sums(rows: DataFrame, label: str, fold: str, features: list[str], betas: np.ndarray) -> DataFrame:
    """model, n, x<i>_<j> (weighted products of terms i <= j), z<i> (those with the working response), one row for each fold's model."""
    k = len(betas)
    models = F.explode(F.array_remove(F.sequence(F.lit(0), F.lit(k - 1)), F.col("_fold")))
    known = rows.select(F.col(label).cast("double").alias("_y"), F.col(fold).cast("int").alias("_fold"), *[F.col(f) for f in features]).filter("_y is not null and _fold is not null")
    known = known.withColumn("model", models)
    terms = _terms(features)
    eta = _linear(F.col("model"), betas, terms)
    known = known.withColumn("_eta", eta).withColumn("_p", 1 / (1 + F.exp(-F.col("_eta"))))
    w = F.greatest(F.col("_p") * (1 - F.col("_p")), F.lit(1e-6))
    known = known.withColumn("_w", w).withColumn("_z", F.col("_eta") + (F.col("_y") - F.col("_p")) / F.col("_w"))
    d = range(len(terms))
    sums = [F.sum(F.col("_w") * terms[i] * terms[j]).alias(f"x{i}_{j}") for i in d for j in d if i <= j]
    return known.groupBy("model").agg(F.count(F.lit(1)).alias("n"), *sums, *[F.sum(F.col("_w") * terms[i] * F.col("_z")).alias(f"z{i}") for i in d])


def step(rows: DataFrame, label: str, fold: str, features: list[str], betas: np.ndarray, ridge: float = 0.0) -> np.ndarray:
    """Each model's coefficients (intercept first) after one reweighted step; the intercept isn't drawn to 0."""
    out, d = betas.copy(), betas.shape[1]
    for r in step_sums(rows, label, fold, features, betas).collect():
        x = np.array([[r[f"x{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)])
        x[np.arange(1, d), np.arange(1, d)] += ridge
        out[r["model"]] = np.linalg.lstsq(x, np.array([r[f"z{i}"] for i in range(d)]), rcond=None)[0]
    return out


def fit(rows: DataFrame, label: str, fold: str, features: list[str], folds: int, steps: int = 5, ridge: float = 1.0) -> np.ndarray:
    betas = np.zeros((folds, len(features) + 1))
    for _ in range(steps):
        betas = step(rows, label, fold, features, betas, ridge)
    return betas


def scored(rows: DataFrame, key: str, fold: str, features: list[str], betas: np.ndarray) -> DataFrame:
    """key, p: each row by the model that hasn't seen its fold."""
    eta = _linear(F.coalesce(F.col(fold).cast("int"), F.lit(0)), betas, _terms(features))
    return rows.select(key, (1 / (1 + F.exp(-eta))).alias("p"))
