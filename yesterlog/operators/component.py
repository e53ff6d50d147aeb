"""A registry of scoring components that run and are aligned as one plan.

A component is a function of named tables that returns a row for each id. It declares its tables, its columns with their types, and
guards that every row must hold. `run` joins the components' rows with a template of ids; the checks are part of the plan, so nothing
is computed twice. A component is refused by name when its columns differ from the declared ones, when an id is missing, repeated
or not in the template, or when a guard does not hold (null counts as not holding).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Component:
    name: str
    make: Callable[..., DataFrame]
    tables: tuple[str, ...]
    columns: dict[str, str]
    guards: dict[str, Column] = field(default_factory=dict)


class Registry:
    def __init__(self, key: str):
        self.key, self.components = key, {}

    def register(self, name: str, tables: tuple[str, ...], columns: dict[str, str], guards: dict[str, Column] | None = None):
        """Decorator; a name is taken once, and no two components share a column."""

        def add(make):
            taken = {c: n for n, x in self.components.items() for c in x.columns}
            if name in self.components or self.key in columns or set(columns) & set(taken):
                raise ValueError(f"component {name}: its name or one of its columns is taken")
            self.components[name] = Component(name, make, tables, columns, guards or {})
            return make

        return add

    def _rows(self, c: Component, tables: dict[str, DataFrame], place: int) -> DataFrame:
        missing = [t for t in c.tables if t not in tables]
        if missing:
            raise ValueError(f"component {c.name}: table {missing[0]} is not given")
        out = c.make(*(tables[t] for t in c.tables))
        types = {n: t for n, t in out.dtypes if n != self.key}
        if types != c.columns or self.key not in out.columns:
            raise ValueError(f"component {c.name}: has {types}, not {c.columns}")
        held = F.lit(None).cast("string")
        for name, guard in reversed(c.guards.items()):
            held = F.when(F.coalesce(guard, F.lit(False)), held).otherwise(F.lit(name))
        held = out.withColumn(f"_broken{place}", held)
        firsts = [F.first(n).alias(n) for n in c.columns]
        return held.groupBy(self.key).agg(F.count(F.lit(1)).alias(f"_n{place}"), F.max(f"_broken{place}").alias(f"_broken{place}"), *firsts)

    def run(self, template: DataFrame, tables: dict[str, DataFrame], names: list[str] | None = None) -> DataFrame:
        """key and the columns of the named components (all, in order of registration), for each id of the template."""
        chosen = [self.components[n] for n in (names or self.components)]
        out = template.groupBy(self.key).agg(F.count(F.lit(1)).alias("_ids"))
        for k, c in enumerate(chosen):
            out = out.join(self._rows(c, tables, k), self.key, "full")
        columns = [F.when(F.col("_ids") > 1, F.raise_error(F.concat(F.lit("the template repeats id "), F.col(self.key)))).otherwise(F.col(self.key)).alias(self.key)]
        for k, c in enumerate(chosen):
            at = F.coalesce(F.col(self.key).cast("string"), F.lit("null"))
            says = lambda text, name=c.name, at=at: F.raise_error(F.concat(F.lit(f"component {name} {text} id "), at))
            n, broken = F.col(f"_n{k}"), F.col(f"_broken{k}")
            for name, kind in c.columns.items():
                value = F.when(n.isNull() & F.col("_ids").isNotNull(), says("lacks").cast(kind)).when(n.isNotNull() & F.col("_ids").isNull(), says("has an extra").cast(kind))
                value = value.when(n > 1, says("repeats").cast(kind)).when(broken.isNotNull(), F.raise_error(F.concat(F.lit(f"component {c.name} breaks guard "), broken, F.lit(" at id "), at)).cast(kind))
                columns.append(value.otherwise(F.col(name)).alias(name))
        return out.select(*columns)
