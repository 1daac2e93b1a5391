"""The registered queries: a name, a function of (session, folder), and SQL for the same rows where SQL has it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, *ctes: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query; sql is its last select over the given common table expressions."""

    def put(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries named {name!r}")
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = (f"with {', '.join(ctes)} " if ctes else "") + sql
        return f

    return put


def r6(value: Column, name: str) -> Column:
    """Rounded to six digits, so that engines that add in another order agree."""
    return F.round(value.cast("double"), 6).alias(name)
