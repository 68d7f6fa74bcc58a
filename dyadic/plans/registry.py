"""Queries by name, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its own name."""

    def add(fn: Callable) -> Callable:
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def rounded(c: Column | str, digits: int = 6) -> Column:
    """A double to so many digits, without a negative zero."""
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double"), digits) + 0.0


def round_all(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(rounded(n, digits).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes))
