"""Queries by name, and the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query of (spark, folder of tables); without SQL it is checked by a test of its own."""

    def add(function):
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return add
