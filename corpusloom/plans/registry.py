"""Where queries are registered, with their SQL for another engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.plans.oracle import with_model

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *needs: str) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL over the model's tables that it needs."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_model(sql, *needs)
        return f

    return put
