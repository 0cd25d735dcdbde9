"""Character n-gram TF-IDF.

Corpus counts: every position yields one window of up to the longest length; tasks count windows as
they read, Spark adds them up and only then cuts them into their prefixes, so a quarter of the n-grams
is ever moved. Only the selected vocabulary (at most max_features rows) reaches the driver.

Vectors are row-local: the vocabulary travels to the tasks inside a GramCounter, so a document's
n-grams never shuffle, and long texts are counted piece by piece. Rows are exploded with the outer
variants, which keep Spark from repeating the generator's input in an inferred filter.
"""

from __future__ import annotations

import math

from pyspark.ml import PipelineModel
from pyspark.ml.feature import ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, functions as F

from snippetry.operators.bounded import join_checked
from snippetry.operators.gram_counting import LONG_TEXT, GramCounter, row_gram_counts, window_counts
from snippetry.schemas import VOCABULARY
from snippetry.session import stage

# Corpus counts up to here are binned exactly when the vocabulary threshold is looked for.
_EXACT_COUNTS = 65_536


def window_pattern(low: int, high: int | None = None) -> str:
    """Overlapping windows, captured in a look-ahead while one character (never half a surrogate
    pair) is consumed at a time. With ``high`` the window is as long as the text allows up to it."""
    size = f"{low},{high}" if high else f"{low}"
    return rf"(?s)(?=(.{{{size}}}))."


def grams_of_length(text: Column | str, n: int) -> Column:
    return F.regexp_extract_all(text, F.lit(window_pattern(n)), F.lit(1))


def char_grams(text: Column | str, ngram_range: tuple[int, int] = (3, 6)) -> Column:
    """All character n-grams of already cleaned text, lower-cased, shortest length first."""
    text = F.col(text) if isinstance(text, str) else text
    low, high = ngram_range
    return F.concat(*[grams_of_length(F.lower(text), n) for n in range(low, high + 1)])


def gram_counts(df: DataFrame, id_col: str, text: str, ngram_range: tuple[int, int] = (3, 6)) -> DataFrame:
    """(id, gram, tf) in long form for unique ids. Rows are counted where they lie; only texts beyond LONG_TEXT characters go
    through window counts and a shuffle, as their n-grams need not fit a task."""
    low, high = ngram_range
    long = F.coalesce(F.length(text), F.lit(0)) > LONG_TEXT
    short = row_gram_counts(df.where(~long), id_col, text, low, high).select(F.col("id").alias(id_col), "gram", F.col("n").alias("tf"))
    counted = window_counts(df.where(long), text, low, high, id_col).groupBy("id", "window").agg(F.sum("n").alias("n"))
    grams = counted.select(F.col("id").alias(id_col), _prefixes(low, high), "n").where(F.col("gram").isNotNull())
    return short.unionByName(grams.groupBy(id_col, "gram").agg(F.sum("n").alias("tf")))


def _prefixes(low: int, high: int) -> Column:
    size = F.length("window")
    return F.explode_outer(F.array(*[F.when(size >= n, F.left("window", F.lit(n))) for n in range(low, high + 1)])).alias("gram")


def corpus_counts(df: DataFrame, text: str, ngram_range: tuple[int, int] = (3, 6)) -> DataFrame:
    """(gram, cf): corpus term counts."""
    low, high = ngram_range
    counted = window_counts(df, text, low, high).groupBy("window").agg(F.sum("n").alias("n"))
    grams = counted.select(_prefixes(low, high), "n").where(F.col("gram").isNotNull())
    return grams.groupBy("gram").agg(F.sum("n").alias("cf"))


def top_grams(counts: DataFrame, k: int) -> DataFrame:
    """The k grams of highest count, ties by gram.

    A histogram of the counts gives the lowest count that can still be in the result; only grams at
    or above it are ordered, so the final merge sees little more than k rows however many
    partitions there are.
    """
    bin_of = F.when(F.col("cf") <= _EXACT_COUNTS, F.col("cf")).otherwise(
        F.lit(_EXACT_COUNTS) + F.floor(F.log2(F.col("cf") / _EXACT_COUNTS) * 64) + 1
    )
    binned = counts.withColumn("_bin", bin_of.cast("bigint"))
    histogram = binned.groupBy("_bin").agg(F.count("*").alias("_n")).collect()
    floor_bin, taken = 0, 0
    for row in sorted(histogram, key=lambda r: -r["_bin"]):
        floor_bin, taken = row["_bin"], taken + row["_n"]
        if taken >= k:
            break
    return binned.where(F.col("_bin") >= floor_bin).drop("_bin").orderBy(F.desc("cf"), "gram").limit(k)


class CharTfidf:
    """Estimator settings; ``fit`` selects the vocabulary and smoothed idf on the given rows only."""

    def __init__(self, text: str = "code_clean", ngram_range: tuple[int, int] = (3, 6), max_features: int = 50_000):
        self.text, self.ngram_range, self.max_features = text, tuple(ngram_range), max_features

    def select(self, cleaned: DataFrame) -> list[tuple[str, int]]:
        """(gram, cf) of the vocabulary in gram order."""
        counts = stage(corpus_counts(cleaned, self.text, self.ngram_range), "gram-counts")
        chosen = sorted((r["gram"], r["cf"]) for r in top_grams(counts, self.max_features).collect())
        if not chosen:
            raise ValueError("empty vocabulary: no training text is long enough for an n-gram")
        return chosen

    def fit_counted(self, train: DataFrame, head: list | None = None) -> tuple["CharTfidfModel", DataFrame]:
        """The model, and the training rows with their counts ``_tf`` staged, so that fitting and
        vectorising the training rows read the text twice in all. ``head`` stages run first, in the
        same pass as the counting; selecting the vocabulary needs of them only the text column."""
        prepared = PipelineModel(head or []).transform(train)
        chosen = self.select(prepared.select(self.text))
        counting = count_stages([gram for gram, _ in chosen], self.text, self.ngram_range)
        rows = PipelineModel(counting).transform(prepared)
        rows = stage(rows, "gram-vectors", wide=True)
        n_docs = rows.count()
        held = rows.select(F.explode_outer(F.unwrap_udt("_tf")["indices"]).alias("idx")).where(F.col("idx").isNotNull())
        df = {r["idx"]: r["df"] for r in held.groupBy("idx").agg(F.count("*").alias("df")).collect()}
        table = [
            (gram, i, cf, df[i], math.log((1 + n_docs) / (1 + df[i])) + 1.0) for i, (gram, cf) in enumerate(chosen)
        ]
        return CharTfidfModel(table, n_docs, self.text, self.ngram_range), rows

    def fit(self, train: DataFrame) -> "CharTfidfModel":
        return self.fit_counted(train.select(self.text))[0]


def count_stages(grams: list[str], text: str, ngram_range: tuple[int, int]) -> list:
    """Persistable stages: counts over the vocabulary."""
    low, high = ngram_range
    return [GramCounter(inputCol=text, outputCol="_tf", vocabulary=grams, low=low, high=high)]


class CharTfidfModel:
    def __init__(self, table: list[tuple], n_docs: int, text: str, ngram_range: tuple[int, int]):
        self.table, self.n_docs, self.text, self.ngram_range = table, n_docs, text, tuple(ngram_range)

    def vocabulary(self, spark) -> DataFrame:
        return spark.createDataFrame(self.table, VOCABULARY)

    @staticmethod
    def from_vocabulary(vocabulary: DataFrame, n_docs: int, text: str = "code_clean",
                        ngram_range: tuple[int, int] = (3, 6)) -> "CharTfidfModel":
        """Rebuild from a saved vocabulary table (bounded by max_features)."""
        rows = sorted(tuple(r) for r in vocabulary.select(*VOCABULARY.fieldNames()).collect())
        return CharTfidfModel(rows, n_docs, text, ngram_range)

    def count_stages(self) -> list:
        return count_stages([row[0] for row in self.table], self.text, self.ngram_range)

    def weight_stages(self, out: str = "tfidf") -> list:
        """Persistable stages from counts: idf weights, L2 norm."""
        idf = Vectors.dense([row[4] for row in self.table])
        return [
            ElementwiseProduct(scalingVec=idf, inputCol="_tf", outputCol="_tfidf_raw"),
            Normalizer(p=2.0, inputCol="_tfidf_raw", outputCol=out),
        ]

    def stages(self, out: str = "tfidf") -> list:
        return [*self.count_stages(), *self.weight_stages(out)]

    def transform(self, df: DataFrame, out: str = "tfidf") -> DataFrame:
        """Append the normalised sparse vector; grams outside the vocabulary are ignored and a row
        without any known gram keeps an empty vector."""
        return PipelineModel(self.stages(out)).transform(df).drop("_tf", "_tfidf_raw")

    def weights(self, df: DataFrame, id_col: str, extra: list[str] | None = None) -> DataFrame:
        """(id, gram, tf, weight) in long form, from text or from rows already counted."""
        cols = [id_col, *(extra or [])]
        counted = df if "_tf" in df.columns else PipelineModel(self.count_stages()).transform(df.select(*cols, self.text))
        full = PipelineModel(self.weight_stages("tfidf")).transform(counted)
        # The struct below a sparse vector: indices and values side by side.
        parts = full.select(*cols, F.unwrap_udt("_tf").alias("c"), F.unwrap_udt("tfidf").alias("w"))
        pairs = parts.select(
            *cols, F.inline_outer(F.arrays_zip(
                F.col("c.indices").alias("idx"), F.col("c.values").alias("tf"), F.col("w.values").alias("weight")
            ))
        ).where(F.col("idx").isNotNull())
        names = self.vocabulary(df.sparkSession).select("idx", "gram")
        return join_checked(pairs, names, "idx").select(*cols, "gram", F.col("tf").cast("bigint").alias("tf"), "weight")
