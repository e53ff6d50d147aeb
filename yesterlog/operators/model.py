"""Models over tables of features: MLlib pipelines, trees as column expressions, saved linear and residual layers, factorisations."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.expr import clip
from ..sources.io import keep, sent_if_small


def assemble(df: DataFrame, features: list[str], missing: float = -1.0) -> DataFrame:
    """Adds the vector `features`; missing values become `missing`."""
    filled = df.withColumns({f"_f_{c}": F.coalesce(F.col(c).cast("double"), F.lit(missing)) for c in features})
    return VectorAssembler(inputCols=[f"_f_{c}" for c in features], outputCol="features").transform(filled).drop(*[f"_f_{c}" for c in features])


def probability(model, df: DataFrame, k: int = 1) -> Column:
    return vector_to_array(F.col("probability"))[k]


def averaged(estimators: list, train: DataFrame, rows: DataFrame, keys: list[str], name: str = "p") -> DataFrame:
    """Mean probability of class 1 over models that differ in their seeds; all transform one table in turn."""
    out, members = rows, []
    for i, e in enumerate(estimators):
        out = e.fit(train).transform(out).withColumn(f"_p{i}", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")
        members.append(F.col(f"_p{i}"))
    return out.select(*keys, (sum(members[1:], members[0]) / len(members)).alias(name))


def tree_column(tree: dict) -> Column:
    """A tree as nested `when`s. A node: feature, threshold, left (below or at it), right, missing ("left" or "right"); a leaf: value."""
    if "value" in tree:
        return F.lit(float(tree["value"]))
    x = F.col(tree["feature"])
    left, right = tree_column(tree["left"]), tree_column(tree["right"])
    return F.when(x.isNull(), left if tree.get("missing", "left") == "left" else right).when(x <= F.lit(float(tree["threshold"])), left).otherwise(right)


def forest_column(trees: list[dict], rate: float = 1.0, base: float = 0.0) -> Column:
    return sum((F.lit(rate) * tree_column(t) for t in trees), F.lit(base))


def scored_by(df: DataFrame, keys: str, features: list[str], predict: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """key, p: a numpy predictor over Arrow batches of feature matrices, for models that no expression covers."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({keys: f[keys], "p": predict(f[features].to_numpy(dtype=float, na_value=np.nan))})

    return df.select(keys, *features).mapInPandas(run, f"{keys} {dict(df.dtypes)[keys]}, p double")


def add_residual(base: Column, residual: Column, cap: float, scale: float) -> Column:
    """base + scale * residual bounded to +-cap, as a probability."""
    return clip(base + F.lit(scale) * clip(residual, -cap, cap), 0, 1)


def residual_family(families: dict[str, object], train: DataFrame, rows: DataFrame, label: str, base: str, keys: list[str], name: str = "p", edge: float = 1e-6) -> DataFrame:
    """Regressors of label - base, one for each family: base plus each family's effect as a probability off 0 and 1, and the mean of these.

    Every family is fitted on all of train and bounded before the mean, so that one that leaves the unit interval can't outvote the
    others. Rows without a base get no prediction; rows to learn from need label and base. All families transform one table in turn.
    """
    known = train.withColumn("_residual", F.col(label) - F.col(base)).filter("_residual is not null")
    out = rows
    for family, estimator in families.items():
        fitted = estimator.copy({estimator.labelCol: "_residual", estimator.predictionCol: f"_e_{family}"}).fit(known)
        out = fitted.transform(out)
    # spelled out, as greatest and least skip nulls
    member = lambda f: F.when(F.col(base).isNotNull(), clip(F.col(base) + F.col(f"_e_{f}"), edge, 1 - edge))
    out = out.select(*keys, *[member(f).alias(f) for f in families])
    return out.withColumn(name, reduce(lambda a, b: a + b, [F.col(f) for f in families]) / len(families))


def stack(intercept: float, weights: dict[str, float]) -> Column:
    return clip(sum((F.lit(w) * F.col(c) for c, w in weights.items()), F.lit(intercept)), 0, 1)


def low_rank(cells: DataFrame, entity: str, columns: list[str], rank: int) -> DataFrame:
    """Each entity's row of the matrix projected on the strongest `rank` directions.

    Tasks sum products of their rows; only the Gram matrix of the columns comes to the driver, and the projection goes back with
    the tasks that multiply it. Null counts as 0.
    """
    return low_rank_by(cells.withColumn("_part", F.lit(0)), "_part", entity, columns, rank)


def low_rank_by(cells: DataFrame, part: str, entity: str, columns: list[str], rank: int) -> DataFrame:
    """The same for each value of `part` by itself, of which there must be few: one aggregation gives all Gram matrices."""
    types, d = dict(cells.dtypes), len(columns)
    rows = cells.select(part, entity, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])
    matrix = lambda f: np.column_stack([f.column(2 + k).to_numpy() for k in range(d)]) if f.num_rows else np.empty((0, d))

    def products(frames: Iterator[pa.RecordBatch]):
        total: dict = {}
        for f in frames:
            x, of = matrix(f), np.array(f.column(0).to_pylist(), dtype=object)
            for p in set(of.tolist()):
                mine = x[of == p]
                total[p] = total.get(p, 0) + mine.T @ mine
        keys = [p for p in total for _ in range(d * d)]
        values = np.concatenate([m.reshape(-1) for m in total.values()] or [np.empty(0)])
        yield pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(np.tile(np.arange(d * d, dtype=np.int32), len(total))), pa.array(values)], names=[part, "place", "value"])

    kind = to_arrow_type(cells.schema[part].dataType)
    sums = rows.mapInArrow(products, f"{part} {types[part]}, place int, value double").groupBy(part, "place").agg(F.sum("value").alias("value"))
    found: dict = {}
    for p, place, value in sums.collect():
        found.setdefault(p, np.zeros(d * d))[place] = value
    onto = {}
    for p, m in found.items():
        v = np.linalg.eigh(m.reshape(d, d))[1][:, -rank:]
        onto[p] = v @ v.T

    def project(frames: Iterator[pa.RecordBatch]):
        for f in frames:
            x, of = matrix(f), np.array(f.column(0).to_pylist(), dtype=object)
            for p in set(of.tolist()):
                x[of == p] = x[of == p] @ onto[p]
            yield pa.RecordBatch.from_arrays([f.column(1), *map(pa.array, np.ascontiguousarray(x.T))], names=[entity, *columns])

    return rows.mapInArrow(project, ", ".join([f"{entity} {types[entity]}", *[f"{c} double" for c in columns]]))


def without_bias(pairs: DataFrame, a: str, b: str, value: str, weight: str, strength: float) -> DataFrame:
    """The pairs less the weighted mean of all, then each a's, then each b's; the sides' means are drawn to 0 by `strength`.

    A small a is sent to the pairs; pairs in buckets of b then stay where they are.
    """
    whole = pairs.agg((F.sum(F.col(weight) * F.col(value)) / F.sum(weight)).alias("_mean"))
    out = pairs.crossJoin(F.broadcast(whole)).withColumn(value, F.col(value) - F.col("_mean")).drop("_mean")
    for side in (a, b):
        bias = out.groupBy(side).agg((F.sum(F.col(weight) * F.col(value)) / (F.sum(weight) + F.lit(strength))).alias("_bias"))
        out = out.join(bias if side == b else sent_if_small(keep(bias, "bias")), side).withColumn(value, F.col(value) - F.col("_bias")).drop("_bias")
    return out


def weighted_als(pairs: DataFrame, a: str, b: str, value: str, weight: str, rounds: int, penalty: float, keep) -> tuple[DataFrame, DataFrame]:
    """Factors of rank 2 of a weighted pair table, by alternating normal equations: one groupBy a side and round.

    Each entity's equations are three sums and two, solved in closed form; keep(df, name) writes each side's factors. A side of at most
    SENT entities is sent to the pairs. Of pairs in buckets of b (the side with more entities) none is shuffled then: equations of b are
    summed where they lie, those of a are summed in each bucket first.
    """
    start = F.pmod(F.xxhash64(F.col(b)), F.lit(1000)) / 1000 - 0.5
    right = keep(pairs.select(b).distinct().select(b, start.alias("x"), (F.pmod(F.xxhash64(F.col(b), F.lit(1)), F.lit(1000)) / 1000 - 0.5).alias("y")), "als-start")

    def solve(key: str, other: str, factors: DataFrame) -> DataFrame:
        j = pairs.join(sent_if_small(factors), other)
        w, x, y, v = F.col(weight), F.col("x"), F.col("y"), F.col(value)
        s = j.groupBy(key).agg(F.sum(w * x * x).alias("xx"), F.sum(w * x * y).alias("xy"), F.sum(w * y * y).alias("yy"), F.sum(w * x * v).alias("bx"), F.sum(w * y * v).alias("by"))
        p, q, r = F.col("xx") + F.lit(penalty), F.col("xy"), F.col("yy") + F.lit(penalty)
        det = p * r - q * q
        return s.select(key, ((r * F.col("bx") - q * F.col("by")) / det).alias("x"), ((p * F.col("by") - q * F.col("bx")) / det).alias("y"))

    left = None
    for k in range(rounds):
        left = keep(solve(a, b, right), f"als-left{k}")
        right = keep(solve(b, a, left), f"als-right{k}")
    return left, right
