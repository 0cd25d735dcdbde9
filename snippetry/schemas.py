"""Explicit schemas of the tables the jobs exchange."""

from __future__ import annotations

from pyspark.sql import types as T

CORPUS = T.StructType(
    [
        T.StructField("snippet_id", T.LongType()),
        T.StructField("code", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("task_name", T.StringType()),
    ]
)

VOCABULARY = T.StructType(
    [
        T.StructField("gram", T.StringType()),
        T.StructField("idx", T.IntegerType()),
        T.StructField("cf", T.LongType()),
        T.StructField("df", T.LongType()),
        T.StructField("idf", T.DoubleType()),
    ]
)

SCALER = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("pos", T.IntegerType()),
        T.StructField("mean", T.DoubleType()),
        T.StructField("std", T.DoubleType()),
    ]
)
