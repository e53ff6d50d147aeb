"""Running sums over an order of all rows, without bringing them to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import keep


def running(df: DataFrame, keys: list[str], order: list[Column | str], sums: dict[str, Column | str]) -> DataFrame:
    """Adds to each row, for every name in sums, the sum of that column over the rows before it in the order, within its keys.

    Rows are dealt by ranges of (keys, order), so a window sees one range; a range begins at the sum of the ranges before it, of
    which there is a row for each range and key. The order must be total within the keys, and sums are of integers without nulls.
    """
    dealt = df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()).withColumns({f"_x_{n}": F.col(c) if isinstance(c, str) else c for n, c in sums.items()})
    dealt = keep(dealt, "ranges")
    before = lambda n, w: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = dealt.groupBy(*keys, "_range").agg(*[F.sum(f"_x_{n}").alias(f"_all_{n}") for n in sums])
    across = Window.partitionBy(*keys).orderBy("_range")
    starts = ranges.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_range").alias("_at"), *[before(f"_all_{n}", across).alias(f"_start_{n}") for n in sums])
    same = F.col("_range") == F.col("_at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    within = Window.partitionBy(*keys, "_range").orderBy(*order)
    out = dealt.join(starts, same).withColumns({n: (before(f"_x_{n}", within) + F.col(f"_start_{n}")).cast("long") for n in sums})
    return out.select(*df.columns, *sums)
