"""All queries of the library by name, with their oracle SQL."""

from __future__ import annotations

from strataspark.plans import evaluation, geometry, integrity, learning, preparation, rasters, spatial, tables  # noqa: F401
from strataspark.plans.registry import QUERIES, Query


def queries() -> dict[str, Query]:
    return {name: q for name, (q, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
