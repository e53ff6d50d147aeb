"""Weighted factorisation of a pair table at any rank, with biases of both sides, by alternating least squares.

value ~ mean + bias(a) + bias(b) + left(a) . right(b). A round solves all left entities' biases and factors together, then all right
ones'. An entity's normal equations are one aggregate of packed sums (rank + 1 of them squared, halved); tasks solve them in batches by
Cholesky factors. Pairs are joined with one side's table at a time, so both sides may be of any size. They lie in buckets of b, which
should be the side with more entities: its equations are summed where they lie, those of a in each bucket first, and a side of at most
SENT entities is sent to them, so that pairs are shuffled once, not in each round. Each half step finds the least penalised loss for its
side, so the loss never rises.

Defined results: pairs that occur several times count each; pairs with a null id, value or weight, or a weight not over 0, are left
out; starting factors come from a hash of the id; an empty table gives empty sides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.io import bucketed, buckets, forget, keep, sent_if_small


@dataclass
class Factors:
    mean: float
    left: DataFrame  # a, bias, factors
    right: DataFrame  # b, bias, factors


def _start(df: DataFrame, key: str, rank: int) -> DataFrame:
    unit = lambda k: F.pmod(F.xxhash64(F.col(key), F.lit(k)), F.lit(2001)) / 10000 - 0.1
    return df.select(key).distinct().select(key, F.lit(0.0).alias("bias"), F.array(*[unit(k) for k in range(rank)]).alias("factors"))


def _solve(pairs: DataFrame, key: str, other: str, side: DataFrame, mean: float, rank: int, penalty: float) -> DataFrame:
    """key, bias, factors: the best of each entity, given the other side's."""
    d = rank + 1
    terms = [F.lit(1.0), *[F.col("factors")[k] for k in range(rank)]]
    w, rest = F.col("_w"), F.col("_v") - F.lit(mean) - F.col("bias")
    square = [F.sum(w * terms[i] * terms[j]) for i in range(d) for j in range(i, d)]
    sums = pairs.join(sent_if_small(side), other).groupBy(key).agg(F.array(*square, *[F.sum(w * t * rest) for t in terms]).alias("sums"))
    kind = dict(pairs.dtypes)[key]
    upper = np.triu_indices(d)

    def run(frames: Iterator[pa.RecordBatch]):
        for f in frames:
            s = f.column(1).flatten().to_numpy().reshape(-1, d * (d + 1) // 2 + d)
            x = np.zeros((len(s), d, d))
            x[:, upper[0], upper[1]] = s[:, : -d]
            x[:, upper[1], upper[0]] = s[:, : -d]
            x[:, np.arange(d), np.arange(d)] += penalty
            low = np.linalg.cholesky(x)
            y = np.linalg.solve(low, s[:, -d:, None])
            beta = np.linalg.solve(low.transpose(0, 2, 1), y)[..., 0]
            factors = pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1, dtype=np.int32) * rank), pa.array(beta[:, 1:].reshape(-1)))
            yield pa.RecordBatch.from_arrays([f.column(0), pa.array(beta[:, 0]), factors], names=[key, "bias", "factors"])

    return sums.mapInArrow(run, f"{key} {kind}, bias double, factors array<double>")


def fit(pairs: DataFrame, a: str, b: str, value: str, weight: str, rank: int, rounds: int, penalty: float) -> Factors:
    known = pairs.select(a, b, F.col(value).cast("double").alias("_v"), F.col(weight).cast("double").alias("_w")).na.drop().filter("_w > 0")
    n = buckets(pairs.count())
    known = bucketed(known.repartition(n, b), b, "factor-pairs", n)
    mean = known.agg(F.sum(F.col("_w") * F.col("_v")) / F.sum("_w")).first()[0] or 0.0
    left, right = None, keep(_start(known, b, rank), "factor-right")
    for _ in range(rounds):
        old = left, right
        left = keep(_solve(known, a, b, right, mean, rank, penalty), "factor-left")
        right = keep(_solve(known, b, a, left, mean, rank, penalty), "factor-right")
        for table in old:
            if table is not None:
                forget(table)
    return Factors(mean, left, right)


def _product(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def predicted(pairs: DataFrame, a: str, b: str, f: Factors, name: str = "p") -> DataFrame:
    """Adds the prediction of each pair; a side that wasn't seen counts as 0."""
    sides = [t.select(k, F.col("bias").alias(f"_bias{i}"), F.col("factors").alias(f"_factors{i}")) for i, (t, k) in enumerate(((f.left, a), (f.right, b)))]
    both = pairs.join(sent_if_small(sides[0]), a, "left").join(sent_if_small(sides[1]), b, "left")
    p = F.lit(f.mean) + F.coalesce("_bias0", F.lit(0.0)) + F.coalesce("_bias1", F.lit(0.0)) + F.coalesce(_product(F.col("_factors0"), F.col("_factors1")), F.lit(0.0))
    return both.select(*pairs.columns, p.alias(name))


def penalised_loss(pairs: DataFrame, a: str, b: str, value: str, weight: str, f: Factors, penalty: float) -> float:
    error = predicted(pairs, a, b, f).agg(F.sum(F.col(weight) * (F.col(value) - F.col("p")) ** 2)).first()[0] or 0.0
    size = F.sum(F.col("bias") ** 2 + _product(F.col("factors"), F.col("factors")))
    return error + penalty * sum(t.agg(size).first()[0] or 0.0 for t in (f.left, f.right))
