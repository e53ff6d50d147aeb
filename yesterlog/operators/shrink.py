"""Frozen tables of shrunk rates: residual cells, hierarchies, split priors, reliability gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import eb, rate
from .aggregate import levels
from .lookup import attach


def residual_eb(history: DataFrame, keys: list[str], residual: str, alpha: float, name: str = "correction") -> DataFrame:
    """keys, n, name: sum of residuals / (n + alpha)."""
    cells = history.groupBy(*keys).agg(F.sum(residual).alias("_total"), F.count(F.lit(1)).alias("n"))
    return cells.select(*keys, "n", (F.col("_total") / (F.col("n") + F.lit(float(alpha)))).alias(name))


def hierarchy(history: DataFrame, chain: list[list[str]], strengths: list[float], root: float, y: str = "y") -> list[DataFrame]:
    """A table for each level of the chain: keys, n, p (rate shrunk to the parent's p) and lift = reliability * (p_raw - parent).

    chain[0] is the coarsest level; each level's keys contain those of the level above.
    """
    out: list[DataFrame] = []
    for keys, k, table in zip(chain, strengths, levels(history, chain, y), strict=True):
        if out:
            above = [c for c in out[-1].columns if c not in ("n", "p", "lift")]
            table = table.join(out[-1].select(*above, F.col("p").alias("_parent")), above)
        else:
            table = table.withColumn("_parent", F.lit(float(root)))
        p = eb("total", "n", F.col("_parent"), k)
        out.append(table.select(*keys, "n", p.alias("p"), (p - F.col("_parent")).alias("lift")))
    return out


def apply_hierarchy(rows: DataFrame, tables: list[DataFrame], name: str = "effect") -> DataFrame:
    """Sum of the lifts of all levels a row is found in; unseen levels add 0."""
    effect = F.lit(0.0)
    for i, t in enumerate(tables):
        keys = [c for c in t.columns if c not in ("n", "p", "lift")]
        rows = attach(rows, t.select(*keys, F.col("lift").alias(f"_lift{i}")), keys, {f"_lift{i}": 0.0}).drop("seen")
        effect = effect + F.col(f"_lift{i}")
    return rows.withColumn(name, effect).drop(*[f"_lift{i}" for i in range(len(tables))])


def split_priors(history: DataFrame, entity: list[str], group: list[str], shrink: float, y: str = "y") -> DataFrame:
    """entity, group, n, split: the cell's rate minus the entity's own, times n / (n + shrink)."""
    own, cell = levels(history, [entity, [*entity, *group]], y)
    own = own.select(*entity, rate("total", "n").alias("_own"))
    weight = F.col("n") / (F.col("n") + F.lit(float(shrink)))
    return cell.join(own, entity).select(*entity, *group, "n", ((rate("total", "n") - F.col("_own")) * weight).alias("split"))


def class_posterior(history: DataFrame, keys: list[str], value: str, values: list[str], strength: float) -> DataFrame:
    """p_<value> for each key: class shares shrunk to the shares of all; they sum to one."""
    counts = history.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(F.col(value) == v, 1)).alias(f"_{v}") for v in values])
    shares = counts.agg(*[(F.sum(f"_{v}") / F.sum("n")).alias(f"_all_{v}") for v in values])
    out = counts.crossJoin(F.broadcast(shares))  # shares is one row
    return out.select(*keys, "n", *[eb(f"_{v}", "n", F.col(f"_all_{v}"), strength).alias(f"p_{v}") for v in values])


def reliability_gate(gain: Column, n: Column, strength: float, low: float = 0.25, unseen: float = 0.5) -> Column:
    """1 where the shrunk mean gain is positive, `low` where not, `unseen` without history."""
    return F.when(n.isNull(), F.lit(unseen)).when(gain / (n + F.lit(float(strength))) > 0, F.lit(1.0)).otherwise(F.lit(low))
