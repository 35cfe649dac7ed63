"""All bound queries: the operators over the supplied tables, one DuckDB statement for each that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import candidates, decisions, energy, histories, ingestion, interactions, layouts, matching, systems, tradeoffs  # noqa: F401  they register their queries
from ._registry import ORACLE, QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
