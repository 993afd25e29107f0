"""Every registered trajectory query with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lagwell.queries import frames, kinetic, registry, states

__all__ = ["frames", "kinetic", "oracle_sql", "queries", "states"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
