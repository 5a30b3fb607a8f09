"""Registered queries: a Spark callable and, where SQL can say it, its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quayside.plans.portal_sql import with_tables
from quayside.plans.portal_tables import Portal

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, tables: str = "") -> Callable:
    """Register ``f(portal) -> DataFrame``; ``tables`` names the portal tables the SQL uses."""
    def register(build: Callable[[Portal], DataFrame]) -> Callable[[Portal], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: build(Portal(spark, folder))
        if sql is not None:
            ORACLES[name] = with_tables(tables, sql.strip())
        return build

    return register
