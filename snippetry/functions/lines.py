"""Line and indentation statistics as built-in array expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from snippetry.functions.text import is_blank, normalise_newlines, split_lines

LINE_STATS = ["n_lines", "avg_line_len", "stdev_line_len", "max_line_len", "blank_ratio", "trailing_ws_ratio"]
INDENT_STATS = ["avg_indent", "max_indent", "tab_leading_ratio"]


def _mean(values, size):
    total = F.aggregate(values, F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    return F.when(size > 0, total / F.greatest(size, F.lit(1))).otherwise(F.lit(0.0))


def with_line_stats(df: DataFrame, code: str = "code") -> DataFrame:
    """Append the nine line and indentation statistics of ``code``.

    Three narrow projections: lines, then per-line lengths and indents, then the statistics. Each
    array is built once per row and nothing leaves the JVM.
    """
    keep = [F.col(f"`{c}`") for c in df.columns]
    lines = df.select(*keep, split_lines(normalise_newlines(F.col(code))).alias("_ls"))
    parts = lines.select(
        *keep,
        F.transform("_ls", lambda x: F.length(x)).alias("_len"),
        F.filter("_ls", lambda x: ~is_blank(x)).alias("_nb"),
        F.size(F.filter("_ls", lambda x: x.endswith(" ") | x.endswith("\t"))).alias("_trail"),
    )
    sized = parts.select(
        *keep,
        "_len",
        "_trail",
        F.size("_len").cast("bigint").alias("n_lines"),
        F.size("_nb").alias("_n_nb"),
        F.aggregate("_len", F.lit(0).cast("bigint"), lambda acc, x: acc + x).alias("_total"),
        F.transform("_nb", lambda x: F.length(x) - F.length(F.ltrim(x, F.lit(" \t")))).alias("_ind"),
        F.size(F.filter("_nb", lambda x: x.startswith("\t"))).alias("_tabs"),
    )
    averaged = sized.withColumn("avg_line_len", F.col("_total") / F.col("n_lines"))
    spread = F.aggregate(
        "_len", F.lit(0.0), lambda acc, x: acc + (x - F.col("avg_line_len")) * (x - F.col("avg_line_len"))
    )
    return averaged.select(
        *keep,
        "n_lines",
        "avg_line_len",
        F.sqrt(spread / F.col("n_lines")).alias("stdev_line_len"),
        F.array_max("_len").cast("bigint").alias("max_line_len"),
        ((F.col("n_lines") - F.col("_n_nb")) / F.col("n_lines")).alias("blank_ratio"),
        (F.col("_trail") / F.col("n_lines")).alias("trailing_ws_ratio"),
        _mean(F.col("_ind"), F.col("_n_nb")).alias("avg_indent"),
        F.coalesce(F.array_max("_ind"), F.lit(0)).cast("bigint").alias("max_indent"),
        (F.col("_tabs") / F.greatest(F.col("_n_nb"), F.lit(1))).alias("tab_leading_ratio"),
    )
