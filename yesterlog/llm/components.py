"""Connected components of an edge table, by alternating star contraction with a written table after every round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Large: each node's larger neighbours move to its least neighbour (or itself); small: its smaller neighbours and itself do."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both if large else both.filter(F.col("b") < F.col("a"))
    least = near.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("center"), F.least("a", "m").alias("m"))
    moved = near.join(least, F.col("a") == F.col("center"))
    if large:
        moved = moved.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("center").alias("a"), F.col("m").alias("b")))
    return moved.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def connected(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges: a, b long. Returns node, root (least node of its component) for every node with an edge to another node.

    Each round is one large-star and one small-star step; the rounds grow with the logarithm of the longest chain. The loop
    ends when a round leaves the edges as they were, which makes every edge (node, root).
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "components")
    before = None
    for _ in range(max_rounds):
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before, now = state, cut(_stars(_stars(now, True), False), "components")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
