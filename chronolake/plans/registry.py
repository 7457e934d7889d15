"""Named queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.roles import Roles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function of ``Roles`` as the query ``name``."""

    def register(build: Callable[[Roles], DataFrame]) -> Callable[[Roles], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is taken")
        QUERIES[name] = lambda spark, path: build(Roles(spark, path))
        if sql:
            SQL[name] = sql
        return build

    return register
