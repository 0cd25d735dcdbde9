"""A multilayer perceptron fitted in passes over the rows, each a matrix product in the tasks.

Hidden layers are sigmoids, the last one is a softmax; the loss is the mean cross entropy. Tasks add up loss and gradient of their rows
block by block; where many tasks have gradients, these are added up on Spark. The driver holds the weights and a short history of
steps; it never sees a row. Weights lie as Spark's learner lays them, so that the result is its model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkContext, StorageLevel
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.common import _py2java
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame, functions as F

from snippetry.plans.batched_lr import _SUMS, _SUMS_ARROW, DECREASE, _add_blocks

#: Steps remembered, as many as Spark's learner remembers.
HISTORY = 10
#: Halvings of a step before the path counts as ended.
HALVINGS = 20
#: Rows of one matrix product.
ROWS = 4096
#: Weights of one block of a summed gradient.
BLOCK = 1 << 14
#: Bytes of gradients that the driver adds up itself.
DRIVER_BYTES = 64 << 20


def layers_of(weights: np.ndarray, sizes: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Views of (matrix, bias) of every layer."""
    out, at = [], 0
    for wide, high in zip(sizes, sizes[1:]):
        out.append((weights[at : at + wide * high].reshape(wide, high), weights[at + wide * high : at + (wide + 1) * high]))
        at += (wide + 1) * high
    return out


def first_weights(sizes: list[int], seed: int) -> np.ndarray:
    """Uniform in +-2.4 / inputs of the layer, the range Spark's learner draws from."""
    rnd = np.random.default_rng(seed)
    return np.concatenate([rnd.uniform(-2.4, 2.4, (wide + 1) * high) / wide for wide, high in zip(sizes, sizes[1:])])


def forward(x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]) -> tuple[list[np.ndarray], np.ndarray]:
    """(inputs of every layer, logarithms of the classes' probabilities)."""
    out = [x]
    for matrix, bias in layers[:-1]:
        out.append(0.5 * (1.0 + np.tanh(0.5 * (out[-1] @ matrix + bias))))
    z = out[-1] @ layers[-1][0] + layers[-1][1]
    z -= z.max(axis=1, keepdims=True)
    return out, z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def add_gradient(x: np.ndarray, y: np.ndarray, weights: np.ndarray, gradient: np.ndarray, sizes: list[int]) -> float:
    """The summed loss of rows ``x`` of classes ``y``; adds their gradient to ``gradient``."""
    layers = layers_of(weights, sizes)
    out, logs = forward(x, layers)
    rows = np.arange(len(y))
    delta = np.exp(logs)
    delta[rows, y] -= 1.0
    sums = layers_of(gradient, sizes)
    for k in reversed(range(len(layers))):
        sums[k][0][...] += out[k].T @ delta
        sums[k][1][...] += delta.sum(axis=0)
        if k:
            delta = (delta @ layers[k][0].T) * out[k] * (1.0 - out[k])
    return -float(logs[rows, y].sum())


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
    """(matrix, rows) of at most ROWS rows each."""
    for batch in batches:
        for part in (batch.slice(at, ROWS) for at in range(0, batch.num_rows, ROWS)):
            yield part.column(0).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, width), part


def _partial_sums(shared, sizes: list[int]):
    """Task function: loss (block -1) and gradient of the rows of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        gradient, loss, met = np.zeros_like(weights), 0.0, 0
        for x, part in _blocks(batches, sizes[0]):
            met += part.num_rows
            loss += add_gradient(x, part.column(1).to_numpy(zero_copy_only=False), weights, gradient, sizes)
        if met:
            blocks = [(-1, np.array([loss]))] + [(b, gradient[at : at + BLOCK]) for b, at in enumerate(range(0, len(gradient), BLOCK))]
            yield pa.record_batch(
                [pa.array([0] * len(blocks), pa.int32()), pa.array([b for b, _ in blocks], pa.int32()),
                 pa.array([s.tobytes() for _, s in blocks], pa.binary())],
                schema=_SUMS_ARROW,
            )

    return run


def _objective(rows: DataFrame, n: int, sizes: list[int]) -> Callable[[np.ndarray], tuple[float, np.ndarray]]:
    """Mean loss and gradient over all rows."""
    sc, parts = rows.sparkSession.sparkContext, rows.rdd.getNumPartitions()

    def objective(weights: np.ndarray) -> tuple[float, np.ndarray]:
        shared = sc.broadcast(weights)
        sums = rows.mapInArrow(_partial_sums(shared, sizes), _SUMS)
        if parts * weights.nbytes > DRIVER_BYTES:
            sums = sums.groupBy("slice", "block").applyInArrow(_add_blocks, _SUMS)
        table = sums.toArrow()
        loss, gradient = 0.0, np.zeros_like(weights)
        for block, values in zip(table["block"].to_pylist(), table["sums"]):
            values = np.frombuffer(values.as_buffer())
            if block < 0:
                loss += values[0]
            else:
                gradient[block * BLOCK : block * BLOCK + len(values)] += values
        shared.destroy()
        return loss / n, gradient / n

    return objective


def _direction(gradient: np.ndarray, past: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Two-loop recursion of limited-memory BFGS."""
    q, taken = gradient.copy(), []
    for s, y in reversed(past):
        a = (s @ q) / (s @ y)
        q -= a * y
        taken.append(a)
    if past:
        s, y = past[-1]
        q *= (s @ y) / (y @ y)
    for (s, y), a in zip(past, reversed(taken)):
        q += s * (a - (y @ q) / (s @ y))
    return -q


def rounds(objective: Callable, weights: np.ndarray, epochs: int, steps: int) -> Iterator[np.ndarray]:
    """The weights after every ``steps`` steps. A path that no step leads on stays where it is."""
    value, gradient = objective(weights)
    past, ended = [], False
    for _ in range(epochs):
        for _ in range(0 if ended else steps):
            move = _direction(gradient, past)
            if move @ gradient >= 0:
                past, move = [], -gradient
            slope, length = move @ gradient, 1.0 if past else 1.0 / max(1.0, float(np.linalg.norm(gradient)))
            for _ in range(HALVINGS):
                tried = weights + length * move
                new_value, new_gradient = objective(tried)
                if new_value <= value + DECREASE * length * slope:
                    break
                length /= 2
            else:
                ended = True
                break
            step, change = tried - weights, new_gradient - gradient
            if step @ change > 1e-12 * (change @ change):
                past = [*past[-HISTORY + 1 :], (step, change)]
            weights, value, gradient = tried, new_value, new_gradient
        yield weights


def _arrays(rows: DataFrame) -> DataFrame:
    return rows.select(vector_to_array("features").alias("x"), F.col("label_idx").cast("int").alias("y"))


def scored(rows: DataFrame, weights: np.ndarray, sizes: list[int]) -> DataFrame:
    """(p, label_idx): the probability of class 1 of every row, by matrix products as well."""
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, part in _blocks(batches, sizes[0]):
            logs = forward(x, layers_of(shared.value, sizes))[1]
            yield pa.record_batch([pa.array(np.exp(logs[:, 1])), part.column(1).cast(pa.float64())], names=["p", "label_idx"])

    return _arrays(rows).mapInArrow(run, "p double, label_idx double")


def fit_rounds(data: DataFrame, sizes: list[int], epochs: int, steps: int, seed: int = 42) -> Iterator[np.ndarray]:
    """The weights after every round of ``steps`` steps over ``data`` (features, label_idx)."""
    rows = _arrays(data).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield from rounds(_objective(rows, rows.count(), sizes), first_weights(sizes, seed), epochs, steps)
    finally:
        rows.unpersist()


def fitted_model(weights: np.ndarray, sizes: list[int], block_size: int = 64, seed: int = 42) -> MultilayerPerceptronClassificationModel:
    """Spark's model of these weights."""
    learner = MultilayerPerceptronClassifier(featuresCol="features", labelCol="label_idx", layers=sizes, blockSize=block_size, seed=seed)
    sc = SparkContext.getOrCreate()
    own = sc._jvm.org.apache.spark.ml.classification
    made = own.MultilayerPerceptronClassificationModel(learner.uid, _py2java(sc, DenseVector(weights)))
    return learner._copyValues(MultilayerPerceptronClassificationModel(made))
