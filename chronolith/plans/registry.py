"""Where plan modules put their queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
#: survey ids that each query covers
COVERS: dict[str, str] = {}


def query(covers: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__], COVERS[f.__name__] = f, covers
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put
