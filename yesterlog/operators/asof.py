"""Ordered analytics: strict-past prefixes, sessions, trailing windows, snapshots. Orders are always unique."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UP_TO = (Window.unboundedPreceding, 0)
BEFORE = (Window.unboundedPreceding, -1)


def prefix(df: DataFrame, keys: list[str], order: list, values: list[str], exclusive: bool = True, tag: str = "before") -> DataFrame:
    """Adds <value>_<tag>: the sum of the rows before each row (and, if not exclusive, of the row itself)."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*(BEFORE if exclusive else UP_TO))
    return df.withColumns({f"{v}_{tag}": F.coalesce(F.sum(v).over(w), F.lit(0)) for v in values})


def sessionize(df: DataFrame, entity: list[str], order: list, same: list[Column], name: str = "session") -> DataFrame:
    """Numbers the runs of rows over which none of the columns changes; NULL equals NULL."""
    w = Window.partitionBy(*entity).orderBy(*order)
    change = F.lit(False)
    for c in same:
        change = change | ~c.eqNullSafe(F.lag(c).over(w))
    start = F.when(F.row_number().over(w) == 1, 1).otherwise(change.cast("int"))
    return df.withColumn("_start", start).withColumn(name, F.sum("_start").over(w.rowsBetween(*UP_TO))).drop("_start")


def gap_sessions(df: DataFrame, entity: list[str], micros: Column, order: list, gap: int, name: str = "session") -> DataFrame:
    """Numbers the runs of rows that follow each other within `gap` microseconds."""
    w = Window.partitionBy(*entity).orderBy(*order)
    start = F.when(F.coalesce(micros - F.lag(micros).over(w) > gap, F.lit(True)), 1).otherwise(0)
    return df.withColumn("_start", start).withColumn(name, F.sum("_start").over(w.rowsBetween(*UP_TO))).drop("_start")


def trailing(df: DataFrame, keys: list[str], order: list, values: list[str], k: int) -> DataFrame:
    """Adds <value>_last<k>: the sum over the k rows before, NULL unless there are k and none is NULL."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-k, -1)
    return df.withColumns({f"{v}_last{k}": F.when(F.count(v).over(w) == k, F.sum(v).over(w)) for v in values})


def last_state(df: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """Each key's values at its greatest order."""
    return df.groupBy(*keys).agg(F.max(order).alias(order), *[F.max_by(v, order).alias(v) for v in values])


def recover_labels(df: DataFrame, entity: list[str], n: str, total: str, name: str = "label") -> DataFrame:
    """The 0/1 label of each row from the next row's cumulative state, NULL where the counters aren't consecutive or the step isn't 0 or 1."""
    w = Window.partitionBy(*entity).orderBy(n)
    step = F.rint(F.lead(total).over(w).cast("double") - F.col(total)).cast("int")
    return df.withColumn(name, F.when((F.lead(n).over(w) - F.col(n) == 1) & step.isin(0, 1), step))


def snapshot_grid(states: DataFrame, keys: list[str], season: str, values: list[str], first: int, last: int) -> DataFrame:
    """A row for each key and season of the grid; values carried forward from the latest season up to it."""
    grid = states.select(*keys).distinct().withColumn(season, F.explode(F.sequence(F.lit(first), F.lit(last))))
    w = Window.partitionBy(*keys).orderBy(season).rowsBetween(*UP_TO)
    return grid.join(states, [*keys, season], "left").withColumns({v: F.last(v, ignorenulls=True).over(w) for v in values})


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """Adds to each left row the values of the latest right row strictly before it: a union and one window, no range join."""
    tagged = left.withColumn("_right", F.lit(0)).withColumns({f"_{v}": F.lit(None).cast(dict(right.dtypes)[v]) for v in values})
    events = right.select(*keys, order, F.lit(1).alias("_right"), *[F.col(v).alias(f"_{v}") for v in values])
    w = Window.partitionBy(*keys).orderBy(order, "_right").rowsBetween(*BEFORE)
    both = tagged.unionByName(events, allowMissingColumns=True).withColumns({v: F.last(f"_{v}", ignorenulls=True).over(w) for v in values})
    return both.filter("_right = 0").drop("_right", *[f"_{v}" for v in values])


def average_rank(df: DataFrame, keys: list[str], value: str, name: str = "rank") -> DataFrame:
    """Ranks with ties at their mean rank."""
    w, ties = Window.partitionBy(*keys).orderBy(value), Window.partitionBy(*keys, value)
    return df.withColumn(name, F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / 2)
