"""Joins against sides that are expected to be small, with the size checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BROADCAST_ROWS = 200_000


def join_checked(left: DataFrame, small: DataFrame, on: str | list[str] | Column, how: str = "inner",
                 max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``small`` only after counting it; beyond the bound leave a shuffle join, whose hot
    keys adaptive execution splits. Pass a staged or driver-built ``small``: it is counted here."""
    if small.count() <= max_rows:
        return left.join(F.broadcast(small), on, how)
    return left.join(small, on, how)


def collect_classes(df: DataFrame, col: str, max_rows: int = BROADCAST_ROWS) -> list:
    """Sorted distinct non-null values of a class column, refused when it is not class-like."""
    values = df.select(col).where(F.col(col).isNotNull()).distinct().limit(max_rows + 1).collect()
    if len(values) > max_rows:
        raise ValueError(f"{col} has more than {max_rows} distinct values; it is not a class label")
    return sorted(row[0] for row in values)
