"""Label index, guards and class weights."""

from __future__ import annotations

from pyspark.ml.feature import IndexToString, StringIndexerModel
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from snippetry.operators.bounded import collect_classes, join_checked
from snippetry.session import stage


class LabelIndex:
    """Sorted classes -> 0..k-1. The classes are the model's own outputs, so they fit the driver."""

    def __init__(self, classes: list[str]):
        self.classes = classes

    @staticmethod
    def fit(df: DataFrame, label: str = "label") -> "LabelIndex":
        return LabelIndex(collect_classes(df, label))

    def require_two(self) -> "LabelIndex":
        if len(self.classes) != 2:
            raise ValueError(f"training needs exactly two classes, not {len(self.classes)}; rebalance or adjust the split")
        return self

    def position(self, label: str) -> int:
        if label not in self.classes:
            raise ValueError(f"{label!r} is not among the known classes {self.classes}")
        return self.classes.index(label)

    def mapping(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [(c, float(i)) for i, c in enumerate(self.classes)], "label string, label_idx double"
        )

    def indexer(self, label: str = "label", out: str = "label_idx") -> StringIndexerModel:
        """An unseen or null label is an error."""
        return StringIndexerModel.from_labels(self.classes, inputCol=label, outputCol=out, handleInvalid="error")

    def decoder(self, idx: str, out: str) -> IndexToString:
        return IndexToString(inputCol=idx, outputCol=out, labels=self.classes)

    def encode(self, df: DataFrame, label: str = "label", out: str = "label_idx") -> DataFrame:
        return self.indexer(label, out).transform(df)

    def decode_column(self, idx: Column | str) -> Column:
        idx = F.col(idx) if isinstance(idx, str) else idx
        return F.array(*[F.lit(c) for c in self.classes])[idx.cast("int")]


class LabelTable:
    """Sorted classes -> 0..k-1 as a table, for label columns of any number of values; nothing is collected."""

    def __init__(self, table: DataFrame):
        self.table = table

    @staticmethod
    def fit(df: DataFrame, label: str = "label") -> "LabelTable":
        """Distinct values are dealt into ranges and numbered inside their range; the sizes of the ranges before give the rest."""
        values = df.select(F.col(label).alias("label")).where("label IS NOT NULL").distinct()
        dealt = values.repartitionByRange("label").withColumn("range", F.spark_partition_id())
        dealt = stage(dealt, "label-ranges")
        sizes = dealt.groupBy("range").agg(F.count("*").alias("n"))
        # One row a range, so the window over all of them is small.
        before = sizes.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
        inside = F.row_number().over(Window.partitionBy("range").orderBy("label")) - 1
        placed = dealt.withColumn("at", inside).join(F.broadcast(before), "range")
        return LabelTable(stage(placed.select("label", (F.col("before") + F.col("at")).cast("double").alias("label_idx")), "label-index"))

    def encode(self, df: DataFrame, label: str = "label", out: str = "label_idx") -> DataFrame:
        """Rows with the index of their label; an unseen or null label is an error."""
        known = self.table.select(F.col("label").alias("_label"), F.col("label_idx").alias("_idx"))
        unseen = F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(F.col(f"`{label}`").cast("string"), F.lit("NULL"))))
        joined = join_checked(df, known, F.col(f"`{label}`") == F.col("_label"), "left")
        kept = [F.col(f"`{c}`") for c in df.columns if c != out]
        return joined.select(*kept, F.when(F.col("_idx").isNotNull(), F.col("_idx")).otherwise(unseen.cast("double")).alias(out))

    def decode(self, df: DataFrame, idx: str, out: str) -> DataFrame:
        """Rows with the label of an index, null for one that no label has."""
        known = self.table.select(F.col("label").alias("_label"), F.col("label_idx").alias("_idx"))
        joined = join_checked(df, known, F.col(f"`{idx}`").cast("double") == F.col("_idx"), "left")
        return joined.select(*[F.col(f"`{c}`") for c in df.columns if c != out], F.col("_label").alias(out))


def positive_weight(df: DataFrame, idx: str = "label_idx") -> DataFrame:
    """One row (pos, neg, scale_pos_weight = neg / max(pos, 1), clamped = max(neg, 1) / max(pos, 1))."""
    counts = df.agg(
        F.coalesce(F.sum((F.col(idx) == 1).cast("bigint")), F.lit(0)).alias("pos"),
        F.coalesce(F.sum((F.col(idx) == 0).cast("bigint")), F.lit(0)).alias("neg"),
    )
    pos = F.greatest("pos", F.lit(1))
    return counts.select(
        "pos", "neg",
        (F.col("neg") / pos).alias("scale_pos_weight"),
        (F.greatest("neg", F.lit(1)) / pos).alias("clamped_weight"),
    )


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, n, weight = N / (k * n)); one row per class."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_N"), F.count("*").alias("_k"))
    values = total.first()
    big_n, k = values["_N"] or 0, values["_k"] or 1
    return counts.select(label, "n", (F.lit(float(big_n)) / (F.lit(k) * F.col("n"))).alias("weight"))


def weight_column(weights: dict, label: Column | str) -> Column:
    """Per-row class weight as an expression over the (few) classes."""
    label = F.col(label) if isinstance(label, str) else label
    out = F.lit(None).cast("double")
    for value, weight in weights.items():
        out = F.when(label == F.lit(value), F.lit(float(weight))).otherwise(out)
    return out
