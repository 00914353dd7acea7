"""All queries of the library by name, with their DuckDB equivalents."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def register(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir) as query ``name``."""

    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE_SQL[name] = sql
        return function

    return add
