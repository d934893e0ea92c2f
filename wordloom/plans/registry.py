"""Registered queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(query: Query) -> Query:
        _queries[name] = query
        if sql is not None:
            _sql[name] = sql
        return query

    return keep


def queries() -> dict[str, Query]:
    from wordloom.plans import queries as _  # noqa: F401  registers them

    return _queries


def oracle_sql() -> dict[str, str]:
    queries()
    return _sql
