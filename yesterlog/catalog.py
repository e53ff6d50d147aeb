"""Names of all queries with their functions and SQL."""

from __future__ import annotations

from .plans import registry
from .plans import aggregates, boosting, features, geometry, joins, labels, matching, models, scoring, shrinkage, sources, streams, wide, windows  # noqa: F401  (each registers its queries)


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
