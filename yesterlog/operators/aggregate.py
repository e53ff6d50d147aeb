"""Group aggregations. Sums are of integers wherever the input allows, divided once at the end, so they don't depend on row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import rate


def grouped(df: DataFrame, keys: list[str], y: str = "y") -> DataFrame:
    """keys, total (sum of y), n."""
    return df.groupBy(*keys).agg(F.sum(y).cast("long").alias("total"), F.count(F.lit(1)).alias("n"))


def rates(df: DataFrame, keys: list[str], y: str = "y", least: int = 0) -> DataFrame:
    """grouped() with the rate, of groups with at least `least` rows."""
    return grouped(df, keys, y).filter(F.col("n") >= least).withColumn("rate", rate("total", "n"))


def levels(df: DataFrame, chain: list[list[str]], y: str = "y") -> list[DataFrame]:
    """One table for each key list, finest last; the coarser ones are re-aggregated from the finest."""
    finest = grouped(df, chain[-1], y)
    up = [finest.groupBy(*keys).agg(F.sum("total").alias("total"), F.sum("n").alias("n")) for keys in chain[:-1]]
    return [*up, finest]


def mode_by(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value, votes, of_all: the most frequent value, the smallest of equally frequent ones."""
    votes = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("votes"))
    w = Window.partitionBy(*keys)
    ranked = votes.withColumn("of_all", F.sum("votes").over(w)).withColumn("_place", F.row_number().over(w.orderBy(F.desc("votes"), value)))
    return ranked.filter("_place = 1").drop("_place")


def value_counts(df: DataFrame, value: str) -> DataFrame:
    """value, n, share; the total is a second small aggregate, not a window over all rows."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(value, "n", rate("n", "total").alias("share"))  # total is one row


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, missing, distinct, least, most, mean, sd, median in one pass over the data."""
    stacked = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])).alias("s")).select("s.*")
    return stacked.groupBy("column").agg(
        F.avg(F.col("x").isNull().cast("int")).alias("missing"),
        F.count_distinct("x").alias("distinct"),
        F.min("x").alias("least"),
        F.max("x").alias("most"),
        F.round(F.avg("x"), 6).alias("mean"),
        F.round(F.stddev_samp("x"), 6).alias("sd"),
        F.percentile("x", F.lit(0.5)).alias("median"),
    )


def centred(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """value minus its group's mean, from a joined small table so that a hot group isn't gathered."""
    means = df.groupBy(*keys).agg(F.avg(value).alias("_mean"))
    return df.join(means, keys).withColumn(name, F.col(value) - F.col("_mean")).drop("_mean")


def class_counts(df: DataFrame, keys: list[str], value: str, values: list) -> DataFrame:
    """A column n_<value> for every value, 0 where there are none."""
    return df.groupBy(*keys).pivot(value, values).agg(F.count(F.lit(1))).na.fill(0).select(*keys, *[F.col(f"`{v}`").alias(f"n_{v}") for v in values])


def moments(x: Column, y: Column) -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy")]
