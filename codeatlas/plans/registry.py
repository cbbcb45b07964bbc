"""The registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .tables import GRAPH_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, with_graph: bool = True):
    """Registers a query with its SQL, which may use the graph's ``entities`` and ``edges``."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = (GRAPH_SQL + "," + sql.strip().removeprefix("WITH ") if sql.strip().startswith("WITH ") else GRAPH_SQL + sql) if with_graph else sql
        return f

    return add
