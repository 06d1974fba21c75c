"""Queries over the given tables with the SQL they are checked against."""

from __future__ import annotations

from typing import Callable, Optional

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(key: str, sql: Optional[str] = None) -> Callable[[Query], Query]:
    """Add a query; without ``sql`` it has no SQL form."""
    def add(query: Query) -> Query:
        if key in QUERIES:
            raise ValueError(f"query {key} is registered twice")
        QUERIES[key] = query
        if sql is not None:
            ORACLES[key] = sql
        return query
    return add


def load_all() -> None:
    from grainsift.registry import (  # noqa: F401
        balance, bias, cleaning, duplicates, noise, outliers, profile, scores, sources, text)
