"""Additive models by cyclic boosting: one binned shape function at a time, then pairs of features, each from sums by bin.

Rows are binned once. A step sums gradients and hessians (as integers, 1/UNIT each) of one term's bins, given the shapes so far, and
moves that term's shape; a cycle takes every term once, so no term can take what belongs to another. After the cycles of single
features one job sums all pairs over coarse bins; the PAIRS best by gain get shapes of two features. Scores are sums of lookups,
made from the shapes anew in each job, so no round writes the rows again. The driver sees sums by bin only.

Defined results: a missing value has a bin of its own, 0; a bin without rows has shape 0; labels are 0 or 1, others are refused;
without rows all scores are those of a rate of 1/2.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.io import keep
from .boost import UNIT, Ensemble, _bytes, prepared, quantile_edges

COARSE = 8


@dataclass
class Shapes:
    """Edges by feature, the base logit, and the shape of each term: a feature's place, or two, with an array over its bins."""

    features: list[str]
    edges: tuple
    base: float
    terms: dict[tuple[int, ...], np.ndarray] = field(default_factory=dict)

    def coarse(self, feature: int) -> np.ndarray:
        """The coarse bin of each bin: 0 stays, the others are dealt evenly."""
        n = len(self.edges[feature]) + 1
        return np.concatenate([[0], 1 + np.arange(n) * COARSE // n])

    def cell(self, bins: np.ndarray, term: tuple[int, ...]) -> np.ndarray:
        if len(term) == 1:
            return bins[:, term[0]].astype(np.int64)
        a, b = (self.coarse(k)[bins[:, k]] for k in term)
        return a * (COARSE + 1) + b

    def score(self, bins: np.ndarray) -> np.ndarray:
        return self.base + sum((shape[self.cell(bins, t)] for t, shape in self.terms.items()), np.zeros(len(bins)))


def _size(term: tuple[int, ...]) -> int:
    return 256 if len(term) == 1 else (COARSE + 1) ** 2


def term_sums(state: DataFrame, shapes: Shapes, terms: list[tuple[int, ...]]) -> DataFrame:
    """term (its place in terms), cell, g, h, n: sums over the rows, given the shapes."""
    width = len(shapes.features)

    def run(frames: Iterator[pa.RecordBatch]):
        total = [np.zeros((3, _size(t))) for t in terms]
        for f in frames:
            bins, y = _bytes(f.column(1), width), f.column(0).to_numpy()
            p = 1 / (1 + np.exp(-shapes.score(bins)))
            weights = np.floor((p - y) * UNIT + 0.5), np.floor(p * (1 - p) * UNIT + 0.5), np.ones(len(y))
            for t, term in enumerate(terms):
                at = shapes.cell(bins, term)
                for j, w in enumerate(weights):
                    total[t][j] += np.bincount(at, weights=w, minlength=_size(term))
        rows = [(t, c, *x[:, c].astype(np.int64).tolist()) for t, x in enumerate(total) for c in np.flatnonzero(x[2]).tolist()]
        columns = zip(*rows, strict=True) if rows else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int32()] * 2 + [pa.int64()] * 3, strict=True)], names=["term", "cell", "g", "h", "n"])

    parts = state.mapInArrow(run, "term int, cell int, g long, h long, n long")
    return parts.groupBy("term", "cell").agg(*[F.sum(c).alias(c) for c in ("g", "h", "n")])


def _collected(state: DataFrame, shapes: Shapes, terms: list[tuple[int, ...]]) -> list[np.ndarray]:
    out = [np.zeros((3, _size(t))) for t in terms]
    for r in term_sums(state, shapes, terms).collect():
        out[r["term"]][:, r["cell"]] = r["g"] / UNIT, r["h"] / UNIT, r["n"]
    return out


def fit(rows: DataFrame, label: str, features: list[str], cycles: int = 3, rate: float = 0.5, penalty: float = 5.0, pairs: int = 2, bins: int = 32, edges: tuple | None = None) -> Shapes:
    seen = {r[0]: r[1] for r in rows.groupBy(F.col(label).cast("int")).count().collect()}
    base = float(np.log((seen.get(1, 0) + 1) / (seen.get(0, 0) + 1)))
    shapes = Shapes(list(features), edges or quantile_edges(rows, features, bins), base)
    state = keep(prepared(rows, label, Ensemble(tuple(features), shapes.edges, (0.0, 0.0))).select("label", "bins"), "additive-rows")

    def cycle(terms):
        for term in terms:
            g, h, n = _collected(state, shapes, [term])[0]
            shapes.terms[term] = shapes.terms.get(term, np.zeros(_size(term))) + np.where(n > 0, -rate * g / (h + penalty), 0.0)

    for _ in range(cycles):
        cycle([(k,) for k in range(len(features))])
    if pairs and len(features) > 1:
        every = list(combinations(range(len(features)), 2))
        gains = [float((x[0] ** 2 / (x[1] + penalty)).sum()) for x in _collected(state, shapes, every)]
        best = sorted(range(len(every)), key=lambda i: (-gains[i], every[i]))[:pairs]
        for _ in range(cycles):
            cycle([every[i] for i in sorted(best)])
    return shapes


def to_table(spark: SparkSession, shapes: Shapes) -> DataFrame:
    """term (names joined by *), cell, shape: the shape tables, and the base as term '' of cell 0."""
    rows = [("", 0, shapes.base)] + [("*".join(shapes.features[k] for k in t), c, float(v)) for t, shape in shapes.terms.items() for c, v in enumerate(shape) if v]
    return spark.createDataFrame(rows, "term string, cell int, shape double")


def scored(rows: DataFrame, key: str, shapes: Shapes) -> DataFrame:
    """key (a long), p: by lookups of each row's bins in the shape tables."""
    from .boost import _bins

    def run(frames: Iterator[pa.RecordBatch]):
        for f in frames:
            yield pa.RecordBatch.from_arrays([f.column(0), pa.array(1 / (1 + np.exp(-shapes.score(_bins(f.columns[1:], shapes.edges)))))], names=[key, "p"])

    return rows.select(F.col(key).cast("long").alias(key), *[F.col(f).cast("double").alias(f) for f in shapes.features]).mapInArrow(run, f"{key} long, p double")
