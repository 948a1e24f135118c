"""Named queries over the bound tables, each with its SQL equivalent where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tieline.checks.base_sql import BASE
from tieline.sources.binding import Binding

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, base: bool = True):
    """Register `fn(tables: Binding) -> DataFrame`; `sql` continues the shared table expressions."""

    def add(fn: Callable[[Binding], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, directory: fn(Binding(spark, directory))
        if sql is not None:
            SQL[name] = (BASE if base else "") + sql
        return fn

    return add
