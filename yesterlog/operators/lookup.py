"""Keyed joins with enforced cardinality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranked import running


class NotUnique(ValueError):
    pass


def assert_unique(table: DataFrame, keys: list[str]) -> None:
    """Raises if a key occurs twice."""
    twice = table.groupBy(*keys).count().filter("count > 1").limit(1).collect()
    if twice:
        raise NotUnique(f"keys {keys} repeat, for example {twice[0]}")


def attach(left: DataFrame, table: DataFrame, keys: list[str], defaults: dict, check: bool = False) -> DataFrame:
    """m:1 left join of a lookup table with defaults for unseen keys, and `seen` (1 where the key was found).

    Spark broadcasts the table if it is below its threshold and sorts and merges otherwise.
    """
    if check:
        assert_unique(table, keys)
    out = left.join(table.withColumn("seen", F.lit(1)), keys, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()} | {"seen": F.coalesce("seen", F.lit(0))})


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key occurs exactly once on either side."""
    single = lambda t: t.groupBy(*keys).count().filter("count = 1").drop("count")
    return left.join(right, keys).join(single(left), keys, "left_semi").join(single(right), keys, "left_semi")


def dictionary(df: DataFrame, value: str, code: str = "code") -> DataFrame:
    """value, code: dense codes from 0 in order of the value; distinct values are numbered by ranges."""
    return running(df.select(value).filter(F.col(value).isNotNull()).distinct(), [], [value], {code: F.lit(1)}).withColumn(code, F.col(code).cast("int"))


class IdsDiffer(ValueError):
    pass


def assert_same_ids(left: DataFrame, right: DataFrame, key: str) -> None:
    """Raises if an id is null, repeats on a side, or is missing on a side."""
    side = lambda t, n: t.groupBy(key).agg(F.count(F.lit(1)).alias(n))
    both = side(left, "_l").join(side(right, "_r"), key, "full")
    wrong = both.filter(F.col(key).isNull() | (F.coalesce("_l", F.lit(0)) != 1) | (F.coalesce("_r", F.lit(0)) != 1)).limit(1).collect()
    if wrong:
        raise IdsDiffer(f"ids of two outputs differ, for example {wrong[0]}")
