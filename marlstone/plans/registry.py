"""Where queries and their SQL are kept by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import guard

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a query under its function's name, with the SQL that states the same."""

    def keep(fn: Callable) -> Callable:
        QUERIES[fn.__name__] = lambda spark, folder: fn(guard(spark), folder)
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return keep
