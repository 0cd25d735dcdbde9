"""Queries over the given tables, each with the SQL that must give the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(fn):
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return register


def r6(col: str | Column) -> Column:
    return F.round(F.col(col) if isinstance(col, str) else col, 6)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[r6(F.col(c).cast("double")).alias(c) if c in names else F.col(c) for c in df.columns])
