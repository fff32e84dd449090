"""Queries by name with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .views import oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, needs: str = "", sql: str | None = None):
    """Register a query; without ``sql`` it has no oracle and is tested against brute force instead."""
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = oracle(needs, sql)
        return fn
    return wrap


def r6(col: str | Column, name: str | None = None) -> Column:
    """Output rounding of floats: six decimals, no negative zero."""
    name = name or col
    return (F.round(F.col(col) if isinstance(col, str) else col, 6) + F.lit(0.0)).alias(name)
