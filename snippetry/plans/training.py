"""Training jobs of the four model families.

Engineered features and n-gram counts or embeddings of the training rows are computed once and
staged; scaler, idf and learner read what they need from there. The result is one pipeline from raw
text to probability.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from importlib import import_module

from pyspark import keyword_only
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression
from pyspark.ml.feature import SQLTransformer, VectorAssembler, VectorSizeHint
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F

from snippetry.functions.text import WS
from snippetry.operators.code_features import FEATURES, CodeFeatures
from snippetry.operators.embedding import as_vector, embedding_dim, encode
from snippetry.operators.evaluation import auc_value, roc_auc
from snippetry.operators.labels import LabelIndex, class_weights, positive_weight, weight_column
from snippetry.operators.scaling import ScalerModel, fit_scaler
from snippetry.operators.tfidf import CharTfidf, CharTfidfModel
from snippetry.plans import perceptron
from snippetry.plans.boosting import Boosting
from snippetry.session import stage

# Rows that keep a core busy for longer than a task of a perceptron's step costs.
PERCEPTRON_ROWS = 1024
HASHED_ENCODER = "snippetry.operators.embedding:hashed_word_encoder"


class TextEncoder(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Pipeline stage around ``encode``; ``encoder`` names a ``module:factory`` that returns a
    batch predict-function maker, so any installed language model can be plugged in."""

    encoder: Param[str] = Param(Params._dummy(), "encoder", "module:factory", typeConverter=TypeConverters.toString)
    batchSize: Param[int] = Param(Params._dummy(), "batchSize", "texts per call", typeConverter=TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol: str = "code_clean", outputCol: str = "embedding", encoder: str = HASHED_ENCODER,
                 batchSize: int = 32):
        super().__init__()
        self._setDefault(inputCol="code_clean", outputCol="embedding", encoder=HASHED_ENCODER, batchSize=32)
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        module, _, factory = self.getOrDefault(self.encoder).partition(":")
        make_predict_fn = getattr(import_module(module), factory)()
        udf = encode(F.col(self.getInputCol()), make_predict_fn, self.getOrDefault(self.batchSize))
        return dataset.withColumn(self.getOutputCol(), udf)


class ArrayVector(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Array of floats -> ML vector."""

    @keyword_only
    def __init__(self, *, inputCol: str = "embedding", outputCol: str = "embedding_vec"):
        super().__init__()
        self._setDefault(inputCol="embedding", outputCol="embedding_vec")
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.getOutputCol(), as_vector(self.getInputCol()))


@dataclass
class Trained:
    pipeline: PipelineModel
    labels: LabelIndex
    scaler: ScalerModel | None = None
    tfidf: CharTfidfModel | None = None
    rounds: int | None = None
    curve: list[tuple[int, float]] | None = None
    grammar: str | None = None


@dataclass
class FittedFeatures:
    """``head`` turns raw rows into dense features plus n-gram counts or embeddings, ``tail`` weighs,
    scales and stacks them into ``features``; ``prepared`` holds the training rows between the two."""

    head: list
    tail: list
    prepared: DataFrame
    scaler: ScalerModel | None = None
    tfidf: CharTfidfModel | None = None

    @property
    def stages(self) -> list:
        return [*self.head, *self.tail]

    def training_rows(self, labels: LabelIndex) -> DataFrame:
        encoded = labels.encode(self.prepared)
        return PipelineModel(self.tail).transform(encoded).select("snippet_id", "features", "label", "label_idx")

    def rows(self, df: DataFrame, labels: LabelIndex) -> DataFrame:
        encoded = labels.encode(df)
        return PipelineModel(self.stages).transform(encoded).select("snippet_id", "features", "label", "label_idx")


def cleaned_text_stage() -> SQLTransformer:
    return SQLTransformer(
        statement=f"SELECT *, trim(regexp_replace(coalesce(`code`, ''), r'[{WS}]+', ' ')) AS code_clean FROM __THIS__"
    )


def fit_features(train: DataFrame, text: str = "tfidf", dense: list[str] = FEATURES, max_features: int = 50_000,
                 ngram_range: tuple[int, int] = (3, 6), clean: str = "raw", encoder: str = HASHED_ENCODER) -> FittedFeatures:
    """``text`` is "tfidf", "embedding" (encoded from the code) or "stored" (an ``embedding`` column
    already in the rows); ``dense`` lists the engineered features to stack, none if empty."""
    head, tail, parts = [], [], []
    if text in ("tfidf", "embedding"):
        head.append(cleaned_text_stage())
    if text == "embedding":
        head.append(TextEncoder(encoder=encoder))
    if dense:
        head.append(CodeFeatures(clean=clean))
    wanted = ["snippet_id", "label", *dense]
    tfidf = scaler = None
    if text == "tfidf":
        narrow = SQLTransformer(statement=f"SELECT {', '.join([*wanted, 'code_clean'])} FROM __THIS__")
        tfidf, counted = CharTfidf("code_clean", ngram_range, max_features).fit_counted(train, [*head, narrow])
        prepared = counted.drop("code_clean")
        head += tfidf.count_stages()
        tail += tfidf.weight_stages("tfidf")
        parts.append("tfidf")
    else:
        prepared = stage(PipelineModel(head).transform(train).select(*wanted, "embedding"), "training-features")
        width = embedding_dim(prepared)
        tail += [ArrayVector(), VectorSizeHint(inputCol="embedding_vec", size=width, handleInvalid="error")]
        parts.append("embedding_vec")
    if dense:
        scaler = fit_scaler(prepared, dense)
        tail.append(scaler.stage("z_"))
        parts += [f"z_{name}" for name in dense]
    tail.append(VectorAssembler(inputCols=parts, outputCol="features"))
    return FittedFeatures(head, tail, prepared, scaler, tfidf)


def packed(rows: DataFrame, dense: bool = False, part_bytes: int = 64 << 20, part_rows: int | None = None) -> DataFrame:
    """``rows`` in as few partitions as hold ``part_bytes`` of features each: learners run many short jobs over the same rows,
    and each task of them costs more than it computes if the rows are few. ``dense`` counts four bytes for every feature, as
    trees bin all of them. With ``part_rows``, for learners that compute much a row, all cores get a partition as long as each holds so
    many rows, sorted by key where rows have to be dealt anew; else there are never more partitions than there were."""
    parts = F.unwrap_udt("features")
    size = F.coalesce(parts["size"], F.size(parts["values"])) * 4 if dense else F.size(parts["values"]) * 12
    found = rows.agg(F.sum(size.cast("bigint") + 64).alias("held"), F.count("*").alias("n")).first()
    wanted = max(1, -(-(found["held"] or 0) // part_bytes))
    if part_rows:
        wanted = max(wanted, min(rows.sparkSession.sparkContext.defaultParallelism, found["n"] // part_rows))
        if rows.rdd.getNumPartitions() < wanted:
            return rows.repartition(wanted, "snippet_id").sortWithinPartitions("snippet_id")
    return rows.coalesce(wanted)


def train_lr(train: DataFrame, c: float = 10.0, tol: float = 3e-3, max_iter: int = 1000, balanced: bool = True,
             **features) -> Trained:
    """L2 logistic regression. The penalty 1/(C * sum of weights) gives the same objective as a
    C-weighted sum of losses."""
    labels = LabelIndex.fit(train).require_two()
    fitted = fit_features(train, "tfidf", **features)
    rows = fitted.training_rows(labels)
    sizes = {r["label"]: r for r in class_weights(fitted.prepared).collect()}
    weights = {k: (r["weight"] if balanced else 1.0) for k, r in sizes.items()}
    total = sum(r["n"] * weights[k] for k, r in sizes.items())
    # Not persisted: the learner keeps its own blocks of the rows, which it reads twice.
    data = packed(rows.withColumn("weight", weight_column(weights, "label")))
    model = LogisticRegression(
        featuresCol="features", labelCol="label_idx", weightCol="weight", elasticNetParam=0.0,
        standardization=False, regParam=1.0 / (c * total), tol=tol, maxIter=max_iter,
    ).fit(data)
    return Trained(PipelineModel([*fitted.stages, model]), labels, fitted.scaler, fitted.tfidf)


def best_prefix(model, rows: DataFrame, patience: int) -> tuple[int, list[tuple[int, float]]]:
    """Number of trees with the highest validation AUC, stopping once ``patience`` further trees bring
    no gain, and the AUC per tree count."""
    known = list(zip(model.trees, model.treeWeights))
    return best_of_blocks((known[at : at + patience] for at in range(0, len(known), patience)), rows, patience)


def best_of_blocks(blocks: Iterable[list[tuple]], rows: DataFrame, patience: int) -> tuple[int, list[tuple[int, float]]]:
    """best_prefix() of trees that come block by block, as (tree, weight); no block is asked for after the stop.

    One job scores the rows with the trees of a block on top of the margin so
    far, and one grouped AUC covers all tree counts of the block.
    """
    best, best_auc, curve = 1, float("-inf"), []
    margins, start = rows.select("features", "label_idx", F.lit(0.0).alias("margin")), 0
    for block in blocks:
        scored = margins
        for i, (tree, _) in enumerate(block, start):
            scored = tree.setFeaturesCol("features").setPredictionCol(f"t{i}").transform(scored)
        terms = F.array(*[
            F.struct(F.lit(i + 1).alias("trees"), (F.col(f"t{i}") * F.lit(weight)).alias("gain")) for i, (_, weight) in enumerate(block, start)
        ])
        running = F.aggregate(
            terms,
            F.array(F.struct(F.lit(start).alias("trees"), F.col("margin"))),
            lambda acc, t: F.array_append(
                acc, F.struct(t["trees"].alias("trees"), (F.element_at(acc, -1)["margin"] + t["gain"]).alias("margin"))
            ),
        )
        scored = stage(scored.select("features", "label_idx", running.alias("steps")), "tree-margins", wide=True)
        long = scored.select("label_idx", F.inline(F.slice("steps", 2, len(block))))
        found = {r["trees"]: r["auc"] for r in roc_auc(long, "margin", "label_idx", ["trees"]).collect()}
        for m in range(start + 1, start + len(block) + 1):
            curve.append((m, found.get(m)))
            if found.get(m) is not None and found[m] > best_auc:
                best, best_auc = m, found[m]
            elif m - best >= patience:
                return best, curve
        margins, start = scored.select("features", "label_idx", F.element_at("steps", -1)["margin"].alias("margin")), start + len(block)
    return best, curve


def fit_until_best(boosting: Boosting, held: DataFrame, patience: int) -> tuple[GBTClassificationModel, int, list[tuple[int, float]]]:
    """(model of the prefix with the highest validation AUC, its number of trees, AUC per number of trees). Trees are grown
    as the curve asks for them, up to all rounds: ``patience`` at a time, or a quarter of it where a tree costs more than its AUC."""
    later = patience if boosting.alone else max(1, patience // 4)

    def blocks() -> Iterator[list[tuple]]:
        while (have := len(boosting.trees)) < boosting.given.rounds:
            boosting.more(later if have else patience)
            yield [(boosting.trees[i], boosting.weight_of(i)) for i in range(have, len(boosting.trees))]

    chosen, curve = best_of_blocks(blocks(), held, patience)
    return boosting.model(chosen), chosen, curve


def train_gbt(train: DataFrame, validation: DataFrame | None = None, text: str = "tfidf", rounds: int = 300,
              learning_rate: float = 0.1, depth: int = 4, subsample: float = 0.8, column_share: float = 0.5,
              max_bins: int = 32, patience: int = 50, weighting: str = "none", seed: int = 42, **features) -> Trained:
    """Boosted trees on TF-IDF or embedding features stacked with the dense ones. ``weighting`` is
    "none" or "positive" (negatives per positive on class 1). With validation rows the ensemble is
    cut to the tree count of highest validation AUC."""
    labels = LabelIndex.fit(train).require_two()
    fitted = fit_features(train, text, **features)
    rows = fitted.training_rows(labels)
    weight = F.lit(1.0)
    if weighting == "positive":
        ratio = positive_weight(rows).first()["clamped_weight"]
        weight = F.when(F.col("label_idx") == 1, F.lit(ratio)).otherwise(F.lit(1.0))
    data = packed(rows.withColumn("weight", weight), dense=True)
    learner = GBTClassifier(
        featuresCol="features", labelCol="label_idx", weightCol="weight", maxIter=rounds, stepSize=learning_rate,
        maxDepth=depth, subsamplingRate=subsample, featureSubsetStrategy=str(column_share), maxBins=max_bins, seed=seed,
    )
    chosen, curve = rounds, None
    boosting = Boosting(learner, data)
    try:
        if validation is None:
            boosting.more(rounds)
            model = boosting.model(rounds)
        else:
            held = stage(packed(fitted.rows(validation, labels)), "validation-features", wide=True)
            model, chosen, curve = fit_until_best(boosting, held, patience)
    finally:
        boosting.release()
    return Trained(PipelineModel([*fitted.stages, model]), labels, fitted.scaler, fitted.tfidf, chosen, curve)


def train_gbt_tfidf(train: DataFrame, validation: DataFrame | None = None, **options) -> Trained:
    return train_gbt(train, validation, "tfidf", **options)


def train_gbt_embedding(train: DataFrame, validation: DataFrame | None = None, **options) -> Trained:
    defaults = dict(text="embedding", rounds=500, depth=6, column_share=0.8, max_bins=256, patience=20, weighting="positive")
    return train_gbt(train, validation, **{**defaults, **options})


def train_mlp(train: DataFrame, validation: DataFrame, hidden: tuple[int, int] = (512, 256), epochs: int = 10,
              steps_per_epoch: int = 10, block_size: int = 64, seed: int = 42, text: str = "embedding", **features) -> Trained:
    """Multilayer perceptron on embeddings alone, in warm-started rounds; the round of highest
    validation AUC is kept."""
    labels = LabelIndex.fit(train).require_two()
    fitted = fit_features(train, text, dense=[], **features)
    data = packed(fitted.training_rows(labels), part_rows=PERCEPTRON_ROWS)
    sizes = [embedding_dim(fitted.prepared), *hidden, len(labels.classes)]
    held = stage(fitted.rows(validation, labels), "validation-features")
    best, best_auc, curve = None, float("-inf"), []
    for epoch, weights in enumerate(perceptron.fit_rounds(data, sizes, epochs, steps_per_epoch, seed)):
        auc = auc_value(perceptron.scored(held, weights, sizes), "p", "label_idx")
        curve.append((epoch, auc))
        if best is None or (auc is not None and auc > best_auc):
            best, best_auc = weights, auc if auc is not None else best_auc
    model = perceptron.fitted_model(best, sizes, block_size, seed)
    return Trained(PipelineModel([*fitted.stages, model]), labels, None, None, max(curve, key=lambda p: p[1] or 0)[0], curve)
