"""The 44 engineered code features, as a DataFrame transform and as an ML pipeline stage."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, functions as F

from snippetry.functions.lines import INDENT_STATS, LINE_STATS, with_line_stats
from snippetry.functions.syntax import IDENTIFIERS, IMPORTS, SHAPE, identifier_columns, import_columns, shape_columns
from snippetry.functions.text import normalise_newlines, rstrip_lines
from snippetry.operators.syntax_facts import syntax_facts

BASE_FEATURES = [*LINE_STATS, *INDENT_STATS, *IDENTIFIERS, *SHAPE, *IMPORTS]
PER_KLOC_OF = [name for name in BASE_FEATURES if name.startswith("n_") and name != "n_lines"]
FEATURES = [*BASE_FEATURES, *[f"{name}_per_kloc" for name in PER_KLOC_OF]]


def per_kloc_columns() -> list[Column]:
    kloc = F.greatest(F.col("n_lines"), F.lit(1)) / F.lit(1000.0)
    return [(F.col(name) / kloc).alias(f"{name}_per_kloc") for name in PER_KLOC_OF]


def with_code_features(df: DataFrame, code: str = "code", clean: str = "raw") -> DataFrame:
    """Append the 44 features of ``code`` in their fixed order, all as double.

    ``clean="raw"`` reads the text as it is, ``"rstrip"`` drops trailing blanks of every line first.
    """
    if clean not in ("raw", "rstrip"):
        raise ValueError(f"clean must be 'raw' or 'rstrip', not {clean!r}")
    cleaner = normalise_newlines if clean == "raw" else rstrip_lines
    keep = [F.col(f"`{c}`") for c in df.columns]
    source = df.select(*keep, cleaner(F.col(code)).alias("_code"))
    parsed = source.withColumn("_facts", syntax_facts("_code"))
    lined = with_line_stats(parsed, "_code")
    based = lined.select(
        *keep,
        *LINE_STATS,
        *INDENT_STATS,
        *identifier_columns("_facts"),
        *shape_columns("_facts"),
        *import_columns("_facts"),
    )
    full = based.select("*", *per_kloc_columns())
    return full.select(*keep, *[F.col(name).cast("double").alias(name) for name in FEATURES])


class CodeFeatures(Transformer, HasInputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Pipeline stage around ``with_code_features`` so one saved pipeline scores raw text."""

    clean: Param[str] = Param(Params._dummy(), "clean", "raw or rstrip", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCol: str = "code", clean: str = "raw"):
        super().__init__()
        self._setDefault(inputCol="code", clean="raw")
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return with_code_features(dataset, self.getInputCol(), self.getOrDefault(self.clean))
