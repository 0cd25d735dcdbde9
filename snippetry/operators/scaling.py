"""Standard scaling with population statistics, and alignment to the training columns."""

from __future__ import annotations

from pyspark.ml.feature import SQLTransformer
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from snippetry.schemas import SCALER


class ScalerModel:
    """Ordered (name, mean, std). ``std`` is the population deviation; a constant column scales to 0."""

    def __init__(self, table: list[tuple[str, float, float]]):
        self.table = table

    @property
    def names(self) -> list[str]:
        return [name for name, _, _ in self.table]

    def table_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(n, i, m, s) for i, (n, m, s) in enumerate(self.table)], SCALER)

    @staticmethod
    def from_table(df: DataFrame) -> "ScalerModel":
        rows = sorted(df.select("pos", "name", "mean", "std").collect())
        return ScalerModel([(r["name"], r["mean"], r["std"]) for r in rows])

    def check_width(self, columns: list[str]) -> None:
        if len(columns) != len(self.table):
            raise ValueError(f"{len(columns)} dense features given, the scaler was fitted on {len(self.table)}")

    def columns(self, prefix: str = "") -> list[Column]:
        return [F.expr(f"{sql}").alias(f"{prefix}{name}") for name, sql in self._sql()]

    def _sql(self) -> list[tuple[str, str]]:
        def scaled(name, mean, std):
            if std == 0.0:
                return f"CASE WHEN `{name}` IS NULL THEN NULL ELSE `{name}` - {mean!r}D END"
            return f"(`{name}` - {mean!r}D) / {std!r}D"

        return [(name, scaled(name, mean, std)) for name, mean, std in self.table]

    def stage(self, prefix: str = "z_") -> SQLTransformer:
        """Persistable pipeline stage; nulls are filled with 0 before scaling."""
        fields = ", ".join(
            sql.replace(f"`{name}`", f"coalesce(`{name}`, 0D)") + f" AS `{prefix}{name}`" for name, sql in self._sql()
        )
        return SQLTransformer(statement=f"SELECT *, {fields} FROM __THIS__")


def fit_scaler(df: DataFrame, columns: list[str]) -> ScalerModel:
    """Mean and population deviation of every column in one aggregation pass. Cells are grouped by the place of their column: two
    aggregates a column side by side make code that the JVM only interprets."""
    cells = df.select(F.posexplode_outer(F.array(*[F.col(c).cast("double") for c in columns])).alias("pos", "value"))
    found = cells.groupBy("pos").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")).collect()
    rows = {r["pos"]: r for r in found}
    return ScalerModel([(c, *((rows[i]["mean"] or 0.0, rows[i]["std"] or 0.0) if i in rows else (0.0, 0.0))) for i, c in enumerate(columns)])


def scale(df: DataFrame, model: ScalerModel | None, keep: list[str], prefix: str = "") -> DataFrame:
    if model is None:
        raise ValueError("a fitted scaler is needed; fit one on the training split first")
    return df.select(*keep, *model.columns(prefix))


def align(df: DataFrame, ordered: list[str], keep: list[str]) -> DataFrame:
    """Exactly the training columns in training order: missing ones 0, extra ones dropped, nulls 0."""
    have = set(df.columns)
    fields = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in have else F.lit(0.0) for c in ordered]
    return df.select(*keep, *[f.alias(c) for f, c in zip(fields, ordered)])
