"""The given tables seen as snippet corpora, and texts Spark derives from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from snippetry.sources.corpus import spread

HUMAN, MACHINE = "Human_written", "AI_generated"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def snippets(spark: SparkSession, folder: str) -> DataFrame:
    """(snippet_id, code, task_name) of every document."""
    documents = table(spark, folder, "documents").select(
        F.col("doc_id").alias("snippet_id"), F.col("text").alias("code"), F.col("source").alias("task_name")
    )
    return spread(documents)


def labels(spark: SparkSession, folder: str) -> DataFrame:
    name = F.when(F.col("quality") == 1, F.lit(HUMAN)).otherwise(F.lit(MACHINE))
    return table(spark, folder, "labels").select(F.col("doc_id").alias("snippet_id"), name.alias("label"))


def labelled_snippets(spark: SparkSession, folder: str) -> DataFrame:
    return snippets(spark, folder).join(labels(spark, folder), "snippet_id").select(
        "snippet_id", "code", "label", "task_name"
    )


def stored_snippets(spark: SparkSession, folder: str) -> DataFrame:
    """(snippet_id, code, label, embedding) of every stored vector. Its label is the parity of the vector's own; its code is the
    document with the same number, as no table says which text a vector encodes, and NULL where there is none."""
    name = F.when(F.col("label") % 2 == 1, F.lit(HUMAN)).otherwise(F.lit(MACHINE))
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("snippet_id"), name.alias("label"), "embedding")
    texts = table(spark, folder, "documents").select(F.col("doc_id").alias("snippet_id"), F.col("text").alias("code"))
    return vectors.join(texts, "snippet_id", "left").select("snippet_id", "code", "label", "embedding")


def perturbed_snippets(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with blank, tabbed and trailing-blank lines, CR / CRLF breaks and exotic blanks."""
    text = F.replace(F.col("code"), F.lit(". "), F.lit(".\n\n\t  "))
    trailing = F.when(F.col("snippet_id") % 3 == 0, F.replace(text, F.lit("\n"), F.lit(" \n"))).otherwise(text)
    breaks = (
        F.when(F.col("snippet_id") % 5 == 0, F.replace(trailing, F.lit("\n"), F.lit("\r\n")))
        .when(F.col("snippet_id") % 5 == 1, F.replace(trailing, F.lit("\n"), F.lit("\r")))
        .otherwise(trailing)
    )
    exotic = F.when(F.col("snippet_id") % 7 == 0, F.replace(breaks, F.lit(", "), F.lit(" \u2003,\u00a0\x1c\n\u3000\u2028\n"))).otherwise(breaks)
    return snippets(spark, folder).withColumn("code", exotic)


# Source text blocks; templates repeat each a number of times given by the row key.
BLOCKS = {
    "fn": "def fn(x):\n    if x:\n        return len(x)\n    return x\n",
    "box": "class MyBox:\n    MAX_N = 1\n    def grow(self):\n        while self:\n            myVar = 2\n        return myVar\n",
    "run": "async def run(q):\n    async for i in q:\n        async with i:\n            pass\n",
    "comp": "data = [fn(v) for v in data]\npick = {v: 1 for v in data}\nkey = lambda z: z\n",
    "safe": "try:\n    with path as p:\n        for n in p:\n            pass\nexcept ValueError:\n    pass\n\n",
}


def block_repeats(key: str = "p_partkey") -> dict[str, Column]:
    """Repeat count of each block, a function of the key alone."""
    k = F.col(key)
    return {
        "fn": k % 4,
        "box": F.floor(k / 4) % 3,
        "run": F.floor(k / 12) % 2,
        "comp": F.floor(k / 24) % 3,
        "safe": F.floor(k / 72) % 2,
    }


def template_snippets(spark: SparkSession, folder: str) -> DataFrame:
    """One Python source per part: two imports, a comment with the part's name, repeated blocks; every
    tenth one ends in a stray bracket and does not parse."""
    pieces = [F.repeat(F.lit(BLOCKS[b]), n.cast("int")) for b, n in block_repeats().items()]
    head = F.concat(F.lit("import os.path as osp\nfrom sys import path\n# "), F.col("p_name"), F.lit("\n"))
    stray = F.when(F.col("p_partkey") % 10 == 0, F.lit(")")).otherwise(F.lit(""))
    parts = spread(table(spark, folder, "part").select("p_partkey", "p_name"), "p_partkey")
    return parts.select(F.col("p_partkey").alias("snippet_id"), F.concat(head, *pieces, stray).alias("code"))
