"""Scoring of arriving snippets with the same pipeline as the batch job."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from snippetry.plans.scoring import score
from snippetry.plans.training import Trained


def snippet_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def start_scoring(trained: Trained, stream: DataFrame, sink: str, checkpoint: str, family: str = "lr",
                  available_now: bool = True, **options) -> StreamingQuery:
    """Stateless: each micro-batch is scored on its own and appended to a Parquet sink; the checkpoint
    makes a restart continue where the last committed batch ended. ``options`` are those of score()."""
    writer = score(trained, stream, family, **options).writeStream.format("parquet").outputMode("append")
    writer = writer.option("path", sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def start_scoring_once(trained: Trained, stream: DataFrame, sink: str, checkpoint: str, version: str, family: str = "lr",
                       available_now: bool = True, **options) -> StreamingQuery:
    """Like start_scoring(), for a sink without a log of its own: each batch has its own folder, named by the model's ``version``, the
    stream and the number of the batch, and is written over whatever an interrupted attempt left there. A batch that is replayed
    thus gives its rows once. The stream's name is the one its checkpoint keeps, so that a new checkpoint on the same sink adds
    rows and replaces none. ``version`` may hold letters, digits, ``.``, ``_`` and ``-``.
    """
    if not re.fullmatch(r"[A-Za-z0-9._-]+", version):
        raise ValueError(f"{version!r} cannot name a folder")

    def write(batch: DataFrame, number: int) -> None:
        name = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        score(trained, batch, family, **options).write.mode("overwrite").parquet(
            f"{sink}/model_version={version}/stream={name}/batch={number}"
        )

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_scores(spark: SparkSession, sink: str) -> DataFrame:
    """All scores that start_scoring_once() wrote, with model_version, stream and batch as columns."""
    scores = spark.read.option("mergeSchema", "false").option("basePath", sink).parquet(f"{sink}/model_version=*/stream=*/batch=*")
    return scores.withColumns({"model_version": F.col("model_version").cast("string"), "batch": F.col("batch").cast("bigint")})
