"""Softmax boosting of trees over histograms that Spark sums, and category codes from strictly earlier rows.

A round grows one tree of fixed depth for each class. For every level one job sums gradients and hessians by class, node, feature and
bin; the driver sees these sums only, chooses the splits and sends them with the next job. Gradients and hessians are summed as
integers (2^-20 each), so results do not depend on the order of rows or partitions. Rows are binned once and written as bytes with
their scores; each round writes them again with its trees added, and the round before is deleted.

Defined results: a missing value is bin 0 and goes left; a feature without different values is never split; labels outside the
classes, null included, are refused; without rows, or rounds, an ensemble is its prior alone. Ties go to the first feature and bin.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.io import forget, keep
from .ranked import running

UNIT = 1 << 20
_SUMS = ["class", "node", "feature", "bin", "g", "h", "n"]
_SUMS_TYPE = "class int, node int, feature int, bin int, g long, h long, n long"


@dataclass(frozen=True)
class Round:
    """Trees of all classes as heaps: feature and cut (the last bin that goes left) of each inner node, value of each leaf."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray


@dataclass(frozen=True)
class Ensemble:
    features: tuple[str, ...]
    edges: tuple[tuple[float, ...], ...]
    base: tuple[float, ...]
    rounds: tuple[Round, ...] = field(default=())


def ordered_rates(df: DataFrame, category: str, order: list[str], targets: list[str], strength: float, prior: float) -> DataFrame:
    """Adds <target>_rate: the mean target (0 or 1) of the category's strictly earlier rows, drawn to `prior` by `strength` rows.

    Sums run over ranges of (category, order), so a category may hold any share of the rows.
    """
    sums = {"_seen": F.lit(1), **{f"_{t}_seen": F.col(t).cast("long") for t in targets}}
    out = running(df, [category], order, sums)
    rate = lambda t: (F.col(f"_{t}_seen") + F.lit(strength * prior)) / (F.col("_seen") + F.lit(float(strength)))
    return out.select(*df.columns, *[rate(t).alias(f"{t}_rate") for t in targets])


def quantile_edges(rows: DataFrame, features: list[str], bins: int) -> tuple[tuple[float, ...], ...]:
    """At most bins - 1 (254) edges of each feature, from one aggregation; a value is left of an edge if it isn't over it."""
    at = [i / bins for i in range(1, min(bins, 255))]
    found = rows.agg(*[F.percentile_approx(F.nanvl(F.col(f).cast("double"), F.lit(None)), F.array(*map(F.lit, at)), F.lit(10_000)).alias(f) for f in features]).first()
    return tuple(tuple(sorted(set(found[f] or ()))) for f in features)


def _bins(columns: list[pa.Array], edges) -> np.ndarray:
    """One byte a feature: 0 for a missing value, else 1 + the number of edges under it."""
    out = np.zeros((len(columns[0]), len(edges)), dtype=np.uint8)
    for k, (c, e) in enumerate(zip(columns, edges, strict=True)):
        x = c.to_numpy(zero_copy_only=False).astype(float)
        out[:, k] = np.where(np.isnan(x), 0, 1 + np.searchsorted(np.array(e), x, side="left"))
    return out


def _leaves(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """The node that each row reaches after `levels` splits of one tree, counted from 0 within its level."""
    at = np.zeros(len(bins), dtype=np.int64)
    row = np.arange(len(bins))
    for level in range(levels):
        node = (1 << level) - 1 + at
        at = at * 2 + (bins[row, feature[node]] > cut[node])
    return at


def _added(score: np.ndarray, bins: np.ndarray, rounds) -> np.ndarray:
    for r in rounds:
        depth = r.value.shape[1].bit_length() - 1
        for k in range(score.shape[1]):
            score[:, k] += r.value[k][_leaves(bins, r.feature[k], r.cut[k], depth)]
    return score


def _softmax(score: np.ndarray) -> np.ndarray:
    e = np.exp(score - score.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1)))


def _matrix(c: pa.Array, width: int) -> np.ndarray:
    return c.flatten().to_numpy().reshape(-1, width)


def prepared(rows: DataFrame, label: str, ensemble: Ensemble) -> DataFrame:
    """label, bins, score of each row, ready for `level_sums`."""
    k = len(ensemble.base)

    def run(frames: Iterator[pa.RecordBatch]):
        for f in frames:
            bins = _bins(f.columns[1:], ensemble.edges)
            score = _added(np.tile(np.array(ensemble.base), (len(bins), 1)), bins, ensemble.rounds)
            yield pa.RecordBatch.from_arrays([f.column(0), pa.array([b.tobytes() for b in bins], pa.binary()), _lists(score)], names=["label", "bins", "score"])

    code = F.col(label).cast("int")
    valid = F.when(code.between(0, k - 1), code).otherwise(F.raise_error(F.lit(f"a label is not one of 0 to {k - 1}")).cast("int"))
    return rows.select(valid.alias("label"), *[F.col(f).cast("double").alias(f) for f in ensemble.features]).mapInArrow(run, "label int, bins binary, score array<double>")


def _bytes(c: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(c.to_pylist()), dtype=np.uint8).reshape(-1, width)


def level_sums(state: DataFrame, width: int, classes: int, feature: np.ndarray, cut: np.ndarray, level: int) -> DataFrame:
    """class, node, feature, bin, g, h, n: gradients and hessians (in 1/UNIT) and rows, summed over prepared rows by the nodes of a level."""

    def run(frames: Iterator[pa.RecordBatch]):
        cells = width * 256
        total = np.zeros((3, classes << level, cells))
        for f in frames:
            y, bins, p = f.column(0).to_numpy(), _bytes(f.column(1), width), _softmax(_matrix(f.column(2), classes))
            place = np.arange(width) * 256 + bins
            for k in range(classes):
                g = np.floor((p[:, k] - (y == k)) * UNIT + 0.5)
                h = np.floor(p[:, k] * (1 - p[:, k]) * UNIT + 0.5)
                at = (_leaves(bins, feature[k], cut[k], level)[:, None] * cells + place).reshape(-1)
                for j, x in enumerate((g, h, np.ones(len(y)))):
                    part = np.bincount(at, weights=np.repeat(x, width), minlength=cells << level)
                    total[j, k << level : (k + 1) << level] += part.reshape(-1, cells)
        node, cell = np.nonzero(total[2])
        columns = [node >> level, node & (1 << level) - 1, cell // 256, cell % 256, *(total[j][node, cell] for j in range(3))]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in zip(columns, [np.int32] * 4 + [np.int64] * 3, strict=True)], names=_SUMS)

    parts = state.mapInArrow(run, _SUMS_TYPE)
    return parts.groupBy(*_SUMS[:4]).agg(*[F.sum(c).alias(c) for c in _SUMS[4:]])


def _choose(sums: list, width: int, classes: int, level: int, penalty: float, least_gain: float, least_rows: int):
    """For each class and node of a level: feature, cut, and gradients and hessians of both sides."""
    hist = np.zeros((3, classes, 1 << level, width, 256))
    for r in sums:
        hist[:, r["class"], r["node"], r["feature"], r["bin"]] = r["g"], r["h"], r["n"]
    hist[:2] /= UNIT
    left = hist.cumsum(axis=-1)
    whole = left[..., :1, -1:]
    right = whole - left
    value = lambda s: s[0] ** 2 / (s[1] + penalty)
    gain = value(left) + value(right) - value(whole)
    gain[(left[2] < least_rows) | (right[2] < least_rows)] = -np.inf
    flat = gain.reshape(classes, 1 << level, -1)
    best = flat.argmax(axis=-1)
    split = np.take_along_axis(flat, best[..., None], axis=-1)[..., 0] > least_gain
    feature, cut = np.where(split, best // 256, 0), np.where(split, best % 256, 255)
    of = lambda s: np.take_along_axis(s.reshape(3, classes, 1 << level, -1), np.broadcast_to((feature * 256 + cut)[None, ..., None], (3, classes, 1 << level, 1)), axis=-1)[..., 0]
    return feature, cut, np.stack([of(left), of(right)], axis=-1), split.any()


def fit(rows: DataFrame, label: str, features: list[str], classes: int, rounds: int, depth: int = 3, rate: float = 0.2, penalty: float = 10.0, least_gain: float = 12.0, least_rows: int = 20, bins: int = 32, start: Ensemble | None = None) -> Ensemble:
    """rows: label (0 to classes - 1) and features. Rounds stop early when no class has a split that gains more than least_gain.

    With `start` its trees, edges and prior are frozen, and rounds are added to them.
    """
    if start is None:
        seen = {r[0]: r[1] for r in rows.groupBy(F.col(label).cast("int")).count().collect()}
        counts = np.array([seen.get(k, 0) + 1.0 for k in range(classes)])
        start = Ensemble(tuple(features), quantile_edges(rows, features, bins), tuple(np.log(counts / counts.sum()).tolist()))
    now, width = start, len(start.features)
    state = keep(prepared(rows, label, start), "boost-rows") if rounds else None
    for _ in range(rounds):
        inner = (1 << depth) - 1
        feature, cut, any_split = np.zeros((classes, inner), dtype=np.int64), np.full((classes, inner), 255), False
        for level in range(depth):
            sums = level_sums(state, width, classes, feature, cut, level).collect()
            f, c, sides, some = _choose(sums, width, classes, level, penalty, least_gain, least_rows)
            at = slice((1 << level) - 1, (2 << level) - 1)
            feature[:, at], cut[:, at], any_split = f, c, any_split or some
        if not any_split:
            break
        leaf = sides.reshape(3, classes, -1)
        value = np.where(leaf[2] > 0, -rate * leaf[0] / (leaf[1] + penalty), 0.0)
        new = Round(feature, cut, value)
        now = replace(now, rounds=(*now.rounds, new))
        before, state = state, keep(_stepped(state, width, classes, new), "boost-rows")
        forget(before)
    return now


def _stepped(state: DataFrame, width: int, classes: int, new: Round) -> DataFrame:
    def run(frames: Iterator[pa.RecordBatch]):
        for f in frames:
            score = _added(_matrix(f.column(2), classes).copy(), _bytes(f.column(1), width), [new])
            yield pa.RecordBatch.from_arrays([f.column(0), f.column(1), _lists(score)], names=["label", "bins", "score"])

    return state.mapInArrow(run, "label int, bins binary, score array<double>")


def predict(rows: DataFrame, key: str, ensemble: Ensemble) -> DataFrame:
    """key (a long), p: the probabilities of all classes."""

    def run(frames: Iterator[pa.RecordBatch]):
        for f in frames:
            bins = _bins(f.columns[1:], ensemble.edges)
            score = _added(np.tile(np.array(ensemble.base), (len(bins), 1)), bins, ensemble.rounds)
            yield pa.RecordBatch.from_arrays([f.column(0), _lists(_softmax(score))], names=[key, "p"])

    return rows.select(F.col(key).cast("long").alias(key), *[F.col(f).cast("double").alias(f) for f in ensemble.features]).mapInArrow(run, f"{key} long, p array<double>")


_TABLE = "part string, round int, class int, node int, feature string, cut int, value double"


def to_table(spark: SparkSession, e: Ensemble) -> DataFrame:
    """An ensemble as rows: base (by class), edge (by feature), split and leaf (by round, class and node)."""
    rows = [("base", None, k, None, None, None, v) for k, v in enumerate(e.base)]
    rows += [("feature", None, None, k, f, None, None) for k, f in enumerate(e.features)]
    rows += [("edge", None, None, i, f, None, float(v)) for f, edges in zip(e.features, e.edges, strict=True) for i, v in enumerate(edges)]
    for r, t in enumerate(e.rounds):
        for k in range(len(e.base)):
            rows += [("split", r, k, i, e.features[t.feature[k, i]], int(t.cut[k, i]), None) for i in range(t.feature.shape[1])]
            rows += [("leaf", r, k, i, None, None, float(t.value[k, i])) for i in range(t.value.shape[1])]
    return spark.createDataFrame(rows, _TABLE)


def from_table(table: DataFrame) -> Ensemble:
    rows = table.collect()
    of = lambda part: sorted((r for r in rows if r.part == part), key=lambda r: (r.round or 0, r["class"] or 0, r.node or 0))
    base, names = tuple(r.value for r in of("base")), tuple(r.feature for r in of("feature"))
    edges = {f: [] for f in names}
    for r in of("edge"):
        edges[r.feature].append(r.value)
    n = 1 + max((r.round for r in of("split")), default=-1)
    shaped = lambda part, get: np.array([get(r) for r in of(part)]).reshape(n, len(base), -1)
    trees = zip(shaped("split", lambda r: names.index(r.feature)), shaped("split", lambda r: r.cut), shaped("leaf", lambda r: r.value), strict=True) if n else ()
    return Ensemble(names, tuple(tuple(edges[f]) for f in names), base, tuple(Round(*t) for t in trees))
