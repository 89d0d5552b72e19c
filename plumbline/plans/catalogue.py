"""Where queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import analog
from .analog import Analog

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None, prefix: bool = True):
    """Register a function of an Analog under name, with its SQL (behind the analog's tables)."""
    def add(f: Callable[[Analog], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Analog(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = f"{analog.SQL}\n{sql}" if prefix else sql
        return f

    return add


def r6(c: str | Column, name: str | None = None):
    return F.round(c, 6).alias(name or c)
