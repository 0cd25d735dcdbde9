"""Session construction and lineage cutting."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


#: Encoded bytes of a row group of wide rows; sparse vectors take some eight times as much when they are read.
WIDE_GROUP = 4 << 20


def build_session(app_name: str = "snippetry", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs here expect. ``conf`` adds to or replaces DEFAULTS
    (underscores stand for dots); partition counts and memory are left to the cluster."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("_", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; where that is unset, one in the warehouse, which
    all executors share as well."""
    sc = spark.sparkContext
    root = sc.getCheckpointDir()
    if root is None:
        root = spark.conf.get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(root or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints")
        root = sc.getCheckpointDir()
    return root


def stage_root(spark: SparkSession) -> str:
    """Where this application's staged tables lie."""
    return f"{checkpoint_root(spark)}/stages-{spark.sparkContext.applicationId}"


def staging_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for a written table."""
    return f"{stage_root(spark)}/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a staged table, wherever Spark can write."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop_stages(spark: SparkSession) -> None:
    """Remove this application's staged tables. Call it when the results that read them are written."""
    drop_path(spark, stage_root(spark))


class Scope:
    """The staged tables of a piece of work, in the order in which they were written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.kept = spark, [], []

    def keep(self, staged: DataFrame) -> DataFrame:
        """``staged`` outlives the scope; the scope around it, if there is one, takes it over."""
        self.kept.append(staged.staged_path)
        return staged

    def drop(self, *staged: DataFrame) -> None:
        """Remove tables that nothing reads any more before the scope ends."""
        for path in [df.staged_path for df in staged] if staged else list(self.paths):
            self.paths.remove(path)
            drop_path(self.spark, path)
        # Shuffle files go when Spark's cleaner sees that no plan refers to them any more.
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


_open: list[Scope] = []


@contextmanager
def stage_scope(spark: SparkSession) -> Iterator[Scope]:
    """Tables staged inside are removed at the end, but for those kept: results that leave the scope must be written or kept."""
    scope = Scope(spark)
    _open.append(scope)
    try:
        yield scope
    finally:
        _open.remove(scope)
        kept = [p for p in scope.paths if p in scope.kept]
        scope.paths = [p for p in scope.paths if p not in scope.kept]
        if _open:
            _open[-1].paths += kept
        scope.drop()


def stage(df: DataFrame, name: str = "stage", wide: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: work shared by several later jobs is
    done once, survives executor loss, and the planner sees real sizes and prunes columns. ``wide`` is for rows that hold long
    arrays: a reader decodes up to 4096 rows at a time, but never beyond a row group, so these are kept small."""
    path = staging_path(df.sparkSession, name)
    (df.write.option("parquet.block.size", WIDE_GROUP) if wide else df.write).parquet(path)
    if _open:
        _open[-1].paths.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out
