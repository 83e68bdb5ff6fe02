"""Registry of the named queries: the Spark callable and, where SQL can say it, the same answer in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from flowguard.plans.oracle import with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, views: str = "", sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = with_views(views, sql) if views else sql.strip()
        return function
    return add


def load() -> None:
    """Import the modules that register queries."""
    from flowguard.plans import alert_queries, flow_queries, model_queries, small_queries, store_queries, table_queries  # noqa: F401
