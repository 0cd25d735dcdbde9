"""Identifier, tree-shape and import features from the raw facts of the parse job."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Identifier styles.
SNAKE = r"^[a-z_][a-z0-9_]*\n?\z"
CAMEL = r"^[a-z]+[A-Za-z0-9]*\n?\z"
UPPER = r"^[A-Z_][A-Z0-9_]*\n?\z"

# Feature -> syntax node types it counts.
NODE_COUNTS = {
    "n_FunctionDef": ["FunctionDef", "AsyncFunctionDef"],
    "n_ClassDef": ["ClassDef"],
    "n_If": ["If"],
    "n_For": ["For", "AsyncFor"],
    "n_While": ["While"],
    "n_Try": ["Try"],
    "n_With": ["With", "AsyncWith"],
    "n_Call": ["Call"],
    "n_ListComp": ["ListComp"],
    "n_DictComp": ["DictComp"],
    "n_Lambda": ["Lambda"],
}

IDENTIFIERS = ["avg_ident_len", "single_letter_ratio", "snake_ratio", "camel_ratio", "upper_ratio"]
SHAPE = [*NODE_COUNTS, "avg_func_len", "max_ast_depth"]
IMPORTS = ["n_imports", "n_from_imports", "n_unique_imports"]


def _mean_of(values: Column, n: Column) -> Column:
    total = F.aggregate(values, F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    return F.coalesce(total / F.nullif(n, F.lit(0)), F.lit(0.0))


def identifier_columns(facts: str) -> list[Column]:
    names = F.col(f"{facts}.names")
    n = F.size(names)

    def share(test) -> Column:
        return F.coalesce(F.size(F.filter(names, test)) / F.nullif(n, F.lit(0)), F.lit(0.0))

    return [
        _mean_of(F.transform(names, lambda x: F.length(x)), n).alias("avg_ident_len"),
        share(lambda x: F.length(x) == 1).alias("single_letter_ratio"),
        share(lambda x: x.rlike(SNAKE)).alias("snake_ratio"),
        share(lambda x: x.rlike(CAMEL) & ~x.rlike(SNAKE)).alias("camel_ratio"),
        share(lambda x: x.rlike(UPPER)).alias("upper_ratio"),
    ]


def shape_columns(facts: str) -> list[Column]:
    counts = F.col(f"{facts}.node_counts")
    lens = F.col(f"{facts}.func_lens")

    def count(types: list[str]) -> Column:
        total = F.lit(0).cast("bigint")
        for t in types:
            total = total + F.coalesce(counts[t], F.lit(0).cast("bigint"))
        return total.cast("double")

    return [
        *[count(types).alias(name) for name, types in NODE_COUNTS.items()],
        _mean_of(lens, F.size(lens)).alias("avg_func_len"),
        F.col(f"{facts}.max_depth").cast("double").alias("max_ast_depth"),
    ]


def import_columns(facts: str) -> list[Column]:
    return [
        F.col(f"{facts}.n_import").cast("double").alias("n_imports"),
        F.col(f"{facts}.n_from").cast("double").alias("n_from_imports"),
        F.size(F.array_distinct(f"{facts}.pkgs")).cast("double").alias("n_unique_imports"),
    ]
