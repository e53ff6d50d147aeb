"""Geometry of blends: Gram matrices by one aggregation, small solves of them, deterministic resampling."""

from __future__ import annotations

from itertools import combinations, combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SCALE = 10**9


def exact_sum(x: Column) -> Column:
    """A sum that doesn't depend on row order: of values rounded to 1e-9, as integers."""
    return F.sum(F.round(x * _SCALE).cast("decimal(38,0)")).cast("double") / _SCALE


def _sums(x: list[str], y: str) -> list[Column]:
    c = {v: F.coalesce(F.col(v).cast("double"), F.lit(0.0)) for v in [*x, y]}
    return [F.count(F.lit(1)), *[exact_sum(c[a] * c[b]) for a, b in combinations_with_replacement(x, 2)], *[exact_sum(c[a] * c[y]) for a in x]]


def _matrix(row, d: int) -> tuple[np.ndarray, np.ndarray, int]:
    values = [v or 0.0 for v in row[1:]]
    m = np.zeros((d, d))
    for (a, b), v in zip(combinations_with_replacement(range(d), 2), values, strict=False):
        m[a, b] = m[b, a] = v
    return m, np.array(values[d * (d + 1) // 2 :]), int(row[0])


def gram(df: DataFrame, x: list[str], y: str) -> tuple[np.ndarray, np.ndarray, int]:
    """X'X, X'y and the number of rows, one aggregation over all pairs of the columns (null counts as 0)."""
    return _matrix(df.agg(*_sums(x, y)).first(), len(x))


def grams(df: DataFrame, part: str, x: list[str], y: str) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """The same for each value of `part`, which must have few values, in their order: one aggregation."""
    rows = df.groupBy(part).agg(*_sums(x, y)).orderBy(part).collect()
    return [_matrix(row[1:], len(x)) for row in rows]


def ridge(m: np.ndarray, b: np.ndarray, penalty: float, bound: float | None = None) -> np.ndarray:
    """Solves (M + penalty * trace(M) / d * I) w = b; weights are bounded to +-bound."""
    w = np.linalg.solve(m + penalty * np.trace(m) / len(m) * np.eye(len(m)), b)
    return w if bound is None else np.clip(w, -bound, bound)


def truncated(m: np.ndarray, b: np.ndarray, share: float = 1e-6) -> np.ndarray:
    """The solution of M w = b in the span of the eigenvectors whose eigenvalue is over `share` of the largest."""
    values, vectors = np.linalg.eigh(m)
    use = values > share * values[-1]
    return vectors[:, use] @ ((vectors[:, use].T @ b) / values[use])


def on_simplex(m: np.ndarray, b: np.ndarray, steps: int = 500) -> np.ndarray:
    """Non-negative weights that sum to one and minimise w'Mw / 2 - b'w, by projected gradient steps."""
    w = np.full(len(b), 1 / len(b))
    size = 1 / max(np.linalg.eigvalsh(m)[-1], 1e-12)
    for _ in range(steps):
        v = w - size * (m @ w - b)
        ordered = np.sort(v)[::-1]
        over = np.cumsum(ordered) - 1
        k = np.flatnonzero(ordered - over / np.arange(1, len(v) + 1) > 0)[-1]
        w = np.maximum(v - over[k] / (k + 1), 0)
    return w


def in_box(m: np.ndarray, b: np.ndarray, low: float = -1.0, high: float = 1.0, steps: int = 1000) -> np.ndarray:
    """Weights within the bounds that minimise w'Mw / 2 - b'w: one weight after the other is set to its best, until none moves."""
    w = np.zeros(len(b))
    for _ in range(steps):
        before = w.copy()
        for i in range(len(b)):
            rest = b[i] - m[i] @ w + m[i, i] * w[i]
            w[i] = np.clip(rest / m[i, i], low, high) if m[i, i] > 0 else 0.0
        if np.abs(w - before).max(initial=0.0) < 1e-12:
            break
    return w


def stress(parts: list[tuple[np.ndarray, np.ndarray, int]], names: list[str], share: int = 3) -> list[tuple]:
    """how, without, weights, score of solutions for the sum of the parts' Gram matrices, rounded.

    A score is 100000 (2 b'w - w'Mw) / n on the whole. Every choice of `share` parts gives a matrix, scaled to all rows, that is solved
    with the whole's b; of these the 5, 50 and 95 per cent quantiles of the score are listed, without weights.
    """
    m, b, n = (sum(p[i] for p in parts) for i in range(3))
    score = lambda w: float(100000 * (2 * b @ w - w @ m @ w) / n)
    solved = [("whole", None, truncated(m, b)), ("box", None, in_box(m, b))]
    for i, name in enumerate(names):
        left = np.arange(len(names)) != i
        w = np.zeros(len(names))
        w[left] = truncated(m[np.ix_(left, left)], b[left])
        solved.append(("one out", name, w))
    out = [(how, name, *(round(float(x), 9) for x in w), round(score(w), 6)) for how, name, w in solved]
    scores = []
    for chosen in combinations(parts, min(share, len(parts))):
        rows = sum(p[2] for p in chosen)
        scores.append(score(truncated(sum(p[0] for p in chosen) * (n / rows), b, 1e-4)))
    return out + [(f"subsets {q}%", None, *[None] * len(names), round(float(np.percentile(scores, q)), 6)) for q in (5, 50, 95)]


def vertex(x: tuple[float, float, float], y: tuple[float, float, float]) -> tuple[float, float]:
    """Where the parabola through three probes has its extremum, and the value there."""
    a, b, c = np.polyfit(x, y, 2)
    at = -b / (2 * a)
    return float(at), float(a * at * at + b * at + c)


def hash_draw(key: Column, draw: Column) -> Column:
    """A number from 0 to PRIME - 1 from an integer hash of key and draw that any engine can repeat.

    Squares modulo a prime between the linear steps keep one draw from being another's shifted copy."""
    k, d = (key.cast("long") + 1) % PRIME, draw.cast("long") + 1
    x = (k * 7919 + d * 104729) % PRIME
    x = (x * x % PRIME + k * d) % PRIME * 48271 % PRIME
    return x * x % PRIME


def poisson_draw(key: Column, draw: Column) -> Column:
    """A number of copies with the probabilities of Poisson(1), from the hash of key and draw."""
    u = hash_draw(key, draw) % 10000
    copies = F.when(u < POISSON[0], 0)
    for n, limit in enumerate(POISSON[1:], 1):
        copies = copies.when(u < limit, n)
    return copies.otherwise(len(POISSON))


PRIME = 2147483647
#: Ten thousandths of the draws with at most 0, 1, ... copies.
POISSON = (3679, 7358, 9197, 9810, 9963, 9994, 9999)
_X = f"((({{k}} + 1) % {PRIME} * 7919 + ({{d}} + 1) * 104729) % {PRIME})"
_Y = f"(({_X} * {_X} % {PRIME} + ({{k}} + 1) % {PRIME} * ({{d}} + 1)) % {PRIME} * 48271 % {PRIME})"
#: SQL of the hash, of its ten thousandths, and of the copies by those.
DRAW_SQL = f"({_Y} * {_Y} % {PRIME})"
HASH_SQL = f"({_Y} * {_Y} % {PRIME} % 10000)"
POISSON_SQL = "(CASE " + " ".join(f"WHEN {{u}} < {limit} THEN {n}" for n, limit in enumerate(POISSON)) + f" ELSE {len(POISSON)} END)"


def hash_order(key: Column) -> Column:
    """An order that looks random and that any engine can repeat, for deterministic samples."""
    return (key.cast("long") + 1) * 48271 % 2147483647


def newton(equations, x: np.ndarray, steps: int = 60, enough: float = 1e-10) -> tuple[np.ndarray, float]:
    """Damped Newton steps on equations(x) = (values, Jacobian): a step is halved until the values shrink. Returns the point and its largest value."""
    f, j = equations(x)
    for _ in range(steps):
        if np.abs(f).max() <= enough:
            break
        step, size = np.linalg.lstsq(j, -f, rcond=None)[0], 1.0
        while size > 1e-6 and not np.abs(equations(x + size * step)[0]).max() < np.abs(f).max():
            size /= 2
        if size <= 1e-6:
            break
        x = x + size * step
        f, j = equations(x)
    return x, float(np.abs(f).max())


def exact_geometry(first: float, second: float, half: float, below: float, above: float, by: float, probes: list[tuple[float, float, float, float]]) -> dict | None:
    """All moments of two predictions from scores of their blends alone, without a look at the outcomes.

    A score is 100000 (1 - squared error / variance of the outcome). first: of a prediction whose affine form is optimal; second: of the
    other; half: of their mean; below, above: of the other moved by -by and +by; probes: (weight of the first, weight of the second,
    shift, score), at least two whose weights do not sum to 1. The shifts give the scale and the other's bias in closed form, the mean
    gives the covariance of both; what is left, the other's covariance with the outcome and the base rate, solves the probes' equations.
    Of several solutions the one whose base rate fits the scale best counts. None where no start converges.
    """
    scale = (2 * second - above - below) / (2 * by * by)
    if not scale > 0:
        return None
    bias = (below - above) / (4 * scale * by)

    def moments(a: float) -> tuple[float, float]:
        b22 = 2 * a - second - scale * bias**2
        return 2 * (first + a - half) - scale * bias**2 / 2 - (first + b22) / 2, b22

    def equations(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        (a, rate), values, slopes = x, [], []
        b12, b22 = moments(a)
        for u, v, shift, score in probes:
            off = shift + rate * (u + v - 1) + v * bias
            values.append(2 * (u * first + v * a) - u * u * first - 2 * u * v * b12 - v * v * b22 - scale * off**2 - score)
            slopes.append([2 * v * (1 - u - v), -2 * scale * off * (u + v - 1)])
        return np.array(values), np.array(slopes)

    found = [newton(equations, np.array([second, start])) for start in (0.05, 0.2, 0.35, 0.5, 0.65, 0.8, 0.95)]
    gap = lambda rate: abs(scale * rate * (1 - rate) - 100000)
    found = [(gap(x[1]), left, x) for x, left in found if left < 1e-6 and 0 < x[1] < 1]
    if not found:
        return None
    _, left, (a, rate) = min(found, key=lambda f: f[:2])
    b12, b22 = moments(a)
    det = first * b22 - b12 * b12
    feasible = bool(det >= 0 and b22 >= 0 and a * a <= 100000 * b22 and gap(rate) < 1e-2)
    best = (first * first * b22 - 2 * first * a * b12 + a * a * first) / det if det > 0 else None
    return {"a1": first, "a2": float(a), "b12": float(b12), "b22": float(b22), "rate": float(rate), "bias": float(bias), "best_score": best and float(best), "residual": left, "feasible": feasible}
