"""Reading labelled corpora with explicit schemas, guards, and stable row keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from snippetry.schemas import CORPUS

# Cell texts that pandas.read_csv treats as missing by default.
NA_VALUES = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# A quoted cell keeps its line breaks, blanks and doubled quotes.
CSV_CELLS = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise KeyError(f"input lacks column(s) {missing}; it has {df.columns}")
    return df


def read_parquet(spark: SparkSession, path: str, schema: T.StructType = CORPUS) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType = CORPUS) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType = CORPUS, na_values: list[str] | None = None) -> DataFrame:
    """CSV whose cells may span lines. This reader takes a file as a whole; read_csv_blocks() divides
    files. Parquet is the default format. Cells in ``na_values`` become null."""
    na_values = NA_VALUES if na_values is None else na_values
    df = spark.read.schema(schema).options(multiLine=True, enforceSchema=False, **CSV_CELLS).csv(path)
    text = {f.name for f in schema if isinstance(f.dataType, T.StringType)}
    return df.select(
        *[F.when(~F.col(c).isin(na_values), F.col(c)).alias(c) if c in text else F.col(c) for c in df.columns]
    )


def spread(df: DataFrame, key: str = "snippet_id") -> DataFrame:
    """A freshly read table that comes in fewer pieces than there are cores is redistributed by its key
    before CPU-heavy work. One with more pieces, as any large one has, is left alone. Call it on a
    plain scan: asking for its partitions runs nothing."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def with_content_id(df: DataFrame, out: str = "snippet_id", chunk: int = 100_000) -> DataFrame:
    """A stable key for rows that have none: SHA-256 of the row's content plus a copy number.

    Copies are counted, not ranked: a row present a billion times is one aggregated row, expanded
    again in chunks spread over the cluster.
    """
    cols = df.columns
    parts = [F.coalesce(F.concat(F.lit("s"), F.col(f"`{c}`").cast("string")), F.lit("n")) for c in cols]
    sized = [F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts]
    counted = df.groupBy(*[F.col(f"`{c}`") for c in cols]).agg(F.count("*").alias("_n"))
    starts = counted.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1, F.lit(chunk).cast("bigint"))).alias("_from"))
    spread = starts.repartition(F.sha2(F.concat(*sized), 256), "_from")
    copies = F.sequence(F.col("_from"), F.least(F.col("_from") + chunk, F.col("_n")) - 1)
    return spread.select(F.sha2(F.concat(*sized), 256).alias("_key"), *cols, F.explode(copies).alias("_copy")).select(
        F.concat_ws("-", "_key", F.col("_copy").cast("string")).alias(out), *cols
    )
