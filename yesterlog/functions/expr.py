"""Column expressions: shrinkage, safe arithmetic, bins, row statistics. NULL is the only missing value."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def eb(total: Column | str, n: Column | str, prior, strength: float) -> Column:
    """Empirical-Bayes rate (total + strength * prior) / (n + strength)."""
    prior = prior if isinstance(prior, Column) else F.lit(float(prior))
    return (col(total) + F.lit(float(strength)) * prior) / (col(n) + F.lit(float(strength)))


def rate(total: Column | str, n: Column | str) -> Column:
    """total / n, NULL where n is 0 or NULL."""
    return F.try_divide(col(total).cast("double"), col(n).cast("double"))


def clip(x: Column | str, low: float, high: float) -> Column:
    """Bounds x; NULL stays NULL, unlike with greatest and least alone."""
    x = col(x)
    return F.when(x.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x)))


def logit(p: Column | str, floor: float = 1e-6) -> Column:
    p = clip(p, floor, 1 - floor)
    return F.log(p / (1 - p))


def expit(z: Column | str) -> Column:
    return 1 / (1 + F.exp(-col(z)))


def entropy(*parts: Column | str, floor: float = 1e-7) -> Column:
    """-sum p ln p of parts floored at `floor`; NULL parts are left out, all NULL gives NULL."""
    parts = [col(p) for p in parts]
    terms = [F.when(p.isNotNull(), -F.greatest(p, F.lit(floor)) * F.log(F.greatest(p, F.lit(floor)))) for p in parts]
    total = reduce(lambda a, b: a + b, [F.coalesce(t, F.lit(0.0)) for t in terms])
    return F.when(reduce(lambda a, b: a | b, [p.isNotNull() for p in parts]), total)


def row_mean(*parts: Column | str) -> Column:
    """Mean over the columns that are not NULL."""
    parts = [col(p) for p in parts]
    n = reduce(lambda a, b: a + b, [p.isNotNull().cast("int") for p in parts])
    return F.try_divide(reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0.0)) for p in parts]), n)


def row_std(*parts: Column | str, ddof: int = 1) -> Column:
    """Standard deviation over the columns that are not NULL; NULL with no more than ddof of them."""
    cols = [col(p) for p in parts]
    n = reduce(lambda a, b: a + b, [p.isNotNull().cast("int") for p in cols])
    mean = row_mean(*cols)
    squares = reduce(lambda a, b: a + b, [F.coalesce((p - mean) * (p - mean), F.lit(0.0)) for p in cols])
    return F.when(n > ddof, F.sqrt(squares / (n - ddof)))


def cut_right(x: Column | str, edges: list[float]) -> Column:
    """Number of the right-closed bin (edges[i-1], edges[i]], from 0, over (-inf, edges[0]], ..., (edges[-1], inf)."""
    return F.when(col(x).isNotNull(), reduce(lambda a, b: a + b, [(col(x) > F.lit(float(e))).cast("int") for e in edges]))


def cut_left(x: Column | str, edges: list[float]) -> Column:
    """Number of the left-closed bin [edges[i-1], edges[i])."""
    return F.when(col(x).isNotNull(), reduce(lambda a, b: a + b, [(col(x) >= F.lit(float(e))).cast("int") for e in edges]))


def either_date(c: Column | str) -> Column:
    """A date from ISO (2024-01-31) or US (01/31/2024) text, else NULL."""
    text = col(c).cast("string")
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")), F.try_to_timestamp(text, F.lit("MM/dd/yyyy"))).cast("date")


def one_hot(c: Column | str, values: list, name: str) -> list[Column]:
    return [F.coalesce((col(c) == F.lit(v)).cast("int"), F.lit(0)).alias(f"{name}_{v}") for v in values]


def season_weight(age: Column | str, decay: float) -> Column:
    return F.pow(F.lit(float(decay)), col(age))
