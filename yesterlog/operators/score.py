"""Scoring of probabilities against 0/1 outcomes, as aggregate expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import col
from .ranked import running


def brier(p: Column | str, y: Column | str) -> Column:
    return F.avg((col(p) - col(y)) * (col(p) - col(y)))


def skill(p: Column | str, y: Column | str) -> Column:
    """1e5 (1 - Brier / (r (1 - r))), r the mean of the scored outcomes; NULL if r is 0 or 1."""
    r = F.avg(col(y))
    return 100000 * (1 - F.try_divide(brier(p, y), r * (1 - r)))


def decomposition(p: Column | str, y: Column | str) -> list[Column]:
    """total skill, its discrimination part (with the mean of p moved to that of y) and the penalty of the difference."""
    r, off = F.avg(col(y)), F.avg(col(p)) - F.avg(col(y))
    penalty = F.try_divide(off * off, r * (1 - r)) * 100000
    return [skill(p, y).alias("total"), (skill(p, y) + penalty).alias("discrimination"), penalty.alias("penalty")]


def gain_parts(p: str, q: str, y: str) -> Column:
    """What replacing p by q gains in squared error, for one row."""
    return (F.col(p) - F.col(y)) * (F.col(p) - F.col(y)) - (F.col(q) - F.col(y)) * (F.col(q) - F.col(y))


def auc(df: DataFrame, p: str, y: str, keys: list[str]) -> DataFrame:
    """Exact area under the ROC curve from average ranks; equal scores are pre-aggregated, then ranked by ranges of the score."""
    scores = df.groupBy(*keys, p).agg(F.count(F.lit(1)).alias("n"), F.sum(y).cast("long").alias("ones"))
    ranked = running(scores, keys, [p], {"below": "n"}).withColumn("rank2", (2 * F.col("below") + F.col("n") + 1) * F.col("ones"))
    ones, n = F.sum("ones"), F.sum("n")
    return ranked.groupBy(*keys).agg(F.try_divide(F.sum("rank2") - ones * (ones + 1), 2 * ones * (n - ones)).alias("auc"), n.alias("n"))


def blend_geometry(p: str, q: str, y: str) -> list[Column]:
    """n, k = <q-p, q-p>, a = <y-p, q-p>, weight = a / k, the weight of q at which the blend's squared error is least."""
    step = F.col(q) - F.col(p)
    a, k = F.sum((F.col(y) - F.col(p)) * step), F.sum(step * step)
    return [F.count(F.lit(1)).alias("n"), k.alias("k"), a.alias("a"), F.try_divide(a, k).alias("weight")]
