"""Where queries and the SQL that says the same are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.views import SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function by its name; ``{view}`` in the SQL stands for the view of that name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            text = sql
            for k, x in SQL.items():
                text = text.replace("{" + k + "}", x)
            ORACLE_SQL[f.__name__] = text
        return f

    return add
