"""Collects the queries of all plan modules: name -> (callable, SQL twin)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
TWINS: dict[str, str] = {}


def query(name: str, twin: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``; ``twin`` is the same result as SQL over the same Parquet files."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if twin is not None:
            TWINS[name] = twin.strip()
        return fn

    return add


def sql_text(s: str) -> str:
    """``s`` as an SQL string literal."""
    return "'" + s.replace("'", "''") + "'"
