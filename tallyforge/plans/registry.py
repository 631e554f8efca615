"""Where plans put their queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
#: Stands in SQL that leaves something out, for settings with methods that SQL can't express: such a query is registered without SQL.
NOT_SQL = "/* not all of it */ "
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL that gives the same rows (none: not expressible in SQL)."""

    def put(f: Query) -> Query:
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"two queries are called {key}")
        QUERIES[key] = f
        if sql and NOT_SQL not in sql:
            ORACLE_SQL[key] = sql
        return f

    return put
