"""Exploration reports over a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def shapes(df: DataFrame, split: str = "split") -> DataFrame:
    """(split, n_rows, n_cols): columns other than the split marker."""
    return df.groupBy(split).agg(F.count("*").alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns) - 1))


def head(df: DataFrame, order: str = "snippet_id", n: int = 5) -> DataFrame:
    return df.orderBy(order).limit(n)


def class_balance(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label)


def char_lengths(df: DataFrame, code: str = "code") -> DataFrame:
    return df.withColumn("char_len", F.length(code).cast("bigint"))


def histogram(df: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """(bin, lo, hi, n) of equal-width bins over min..max, last one closed, empty ones included."""
    limits = df.agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi")).first()
    lo, hi = limits["lo"], limits["hi"]
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin bigint, lo double, hi double, n bigint")
    if lo == hi:
        bins = 1
    width = (hi - lo) / bins
    index = F.lit(0) if width == 0 else F.least(F.floor((F.col(value) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1))
    counts = df.where(F.col(value).isNotNull()).groupBy(index.cast("bigint").alias("bin")).agg(F.count("*").alias("n"))
    return (
        df.sparkSession.range(bins).withColumnRenamed("id", "bin").join(counts, "bin", "left")
        .select("bin", (F.lit(lo) + F.col("bin") * width).alias("lo"), (F.lit(lo) + (F.col("bin") + 1) * width).alias("hi"),
                F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))
    )


def extremes(df: DataFrame, code: str = "code", id_col: str = "snippet_id", cut: int = 300) -> DataFrame:
    """(which, snippet_id, char_len, code) of the shortest and the longest snippet; the lowest id wins
    a tie, and the longest text is shown up to ``cut`` characters."""
    lens = df.where(F.col(code).isNotNull()).select(
        F.col(id_col).alias("_id"), F.length(code).cast("bigint").alias("_len"), F.col(code).alias("_code")
    )
    best = lens.agg(
        F.min_by(F.struct("_id", "_len", "_code"), F.struct(F.col("_len"), F.col("_id"))).alias("a"),
        F.min_by(F.struct("_id", "_len", F.left("_code", F.lit(cut)).alias("_code")), F.struct(-F.col("_len"), F.col("_id"))).alias("b"),
    )

    def row(which, side):
        return F.struct(
            F.lit(which).alias("which"), F.col(f"{side}._id").alias("snippet_id"),
            F.col(f"{side}._len").alias("char_len"), F.col(f"{side}._code").alias("code"),
        )

    return best.select(F.inline(F.array(row("shortest", "a"), row("longest", "b"))))
