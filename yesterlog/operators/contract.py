"""Data contracts as one aggregation each: outputs, time order, counters, simplexes, alignment, leakage, row independence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Broken(ValueError):
    pass


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """n, and for each rule the number of rows that break it; a rule that is NULL is broken."""
    return df.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(~F.coalesce(ok, F.lit(False)), 1)).alias(name) for name, ok in rules.items()])


def require(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """df, or an error that names the broken rules."""
    row = violations(df, rules).first().asDict()
    broken = {k: v for k, v in row.items() if k != "n" and v}
    if broken:
        raise Broken(f"of {row['n']} rows break: {broken}")
    return df


def probability_rules(p: str) -> dict[str, Column]:
    c = F.col(p)
    return {"known": c.isNotNull() & ~F.isnan(c), "in_range": c.between(0, 1)}


def output_contract(out: DataFrame, wanted: DataFrame, key: str, p: str) -> DataFrame:
    """n, repeated, missing, extra keys and values outside [0, 1], from one full join of key counts."""
    a = out.groupBy(key).agg(F.count(F.lit(1)).alias("_a"), F.count(F.when(~F.coalesce(F.col(p).between(0, 1), F.lit(False)), 1)).alias("_bad"))
    b = wanted.groupBy(key).agg(F.count(F.lit(1)).alias("_b"))
    both = a.join(b, key, "full")
    count = lambda c: F.count(F.when(c, 1))
    return both.agg(F.coalesce(F.sum("_a"), F.lit(0)).alias("n"), count(F.col("_a") > 1).alias("repeated"), count(F.col("_a").isNull()).alias("missing"), count(F.col("_b").isNull()).alias("extra"), F.coalesce(F.sum("_bad"), F.lit(0)).alias("outside"))


def leaking(columns: list[str], forbidden: list[str]) -> list[str]:
    """Feature names that contain a forbidden token (an id, a season, the target)."""
    return [c for c in columns if any(t in c.lower().split("_") for t in forbidden)]


def largest_difference(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """only_one_side, largest: rows without a partner and the largest absolute difference of partners."""
    both = a.select(key, F.col(value).alias("_a")).join(b.select(key, F.col(value).alias("_b")), key, "full")
    alone = F.count(F.when(F.col("_a").isNull() != F.col("_b").isNull(), 1))
    return both.agg(alone.alias("only_one_side"), F.coalesce(F.max(F.abs(F.col("_a") - F.col("_b"))), F.lit(0.0)).alias("largest"))


def row_independence(rows: DataFrame, score: Callable[[DataFrame], DataFrame], key: str, value: str) -> DataFrame:
    """name, only_one_side, largest: scores of the whole against those of rows dealt anew, halves, repeated rows and one row alone."""
    whole = score(rows)
    half = F.pmod(F.xxhash64(key), F.lit(2)) == 0
    one = rows.orderBy(key).limit(1)
    trials = {
        "dealt_anew": score(rows.repartition(7, key)),
        "split": score(rows.filter(half)).unionByName(score(rows.filter(~half))),
        "repeated": score(rows.unionByName(rows)).groupBy(key).agg(F.max(value).alias(value)),
        "alone": score(one),
    }
    out = None
    for name, t in trials.items():
        base = whole.join(one.select(key), key, "left_semi") if name == "alone" else whole
        d = largest_difference(base, t, key, value).select(F.lit(name).alias("name"), "only_one_side", "largest")
        out = d if out is None else out.unionByName(d)
    return out
