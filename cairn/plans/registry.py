"""Queries by name, each with its SQL where SQL can say the same over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(key)
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f

    return add
