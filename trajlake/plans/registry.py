"""Registry of the named queries."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    ids: tuple[str, ...]
    build: Build
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, *ids: str, sql: str | None = None):
    """Register a query under ``name``; ``ids`` are the operator inventory entries it covers."""
    def register(build: Build) -> Build:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, ids, build, sql)
        return build
    return register


def r6(value, digits: int = 6) -> Column:
    """Rounded for comparison; adding 0 turns a negative zero into zero."""
    value = F.col(value) if isinstance(value, str) else value
    return F.round(value, digits) + F.lit(0.0)


def long(value) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("long")
