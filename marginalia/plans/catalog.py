"""Catalog of checked queries: each runs operators over whole tables of a directory and, where SQL
can say the same, comes with that SQL.

A query is a function of (session, table directory). Its SQL reads views named as the tables.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def checked(sql: str | None = None) -> Callable[[Query], Query]:
    """Register the decorated function under its name."""

    def register(query: Query) -> Query:
        QUERIES[query.__name__] = query
        if sql is not None:
            ORACLE[query.__name__] = sql
        return query

    return register


_MODULES = ("paths", "chunks", "code", "diff", "search", "index", "answers", "streams")


def load() -> None:
    """Import the modules that register queries."""
    for module in _MODULES:
        import_module(f"marginalia.plans.checked_{module}")
