"""The perceptron's passes against Spark's model, against differences of the loss, and over several cores."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from snippetry.operators.evaluation import auc_value
from snippetry.plans import perceptron, training

SIZES = [3, 5, 4, 2]


@pytest.fixture(scope="module")
def rows(spark):
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(300, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    made = [(i, Vectors.dense(v), float(label)) for i, (v, label) in enumerate(zip(x.tolist(), y))]
    return spark.createDataFrame(made, ["snippet_id", "features", "label_idx"]).persist()


def test_gradient_is_the_slope_of_the_loss():
    rnd = np.random.default_rng(2)
    x, y, weights = rnd.normal(size=(7, 3)), rnd.integers(0, 2, 7), perceptron.first_weights(SIZES, 4)
    gradient = np.zeros_like(weights)
    perceptron.add_gradient(x, y, weights, gradient, SIZES)
    for i in range(len(weights)):
        up, down = weights.copy(), weights.copy()
        up[i] += 1e-5
        down[i] -= 1e-5
        slope = perceptron.add_gradient(x, y, up, np.zeros_like(weights), SIZES) - perceptron.add_gradient(x, y, down, np.zeros_like(weights), SIZES)
        assert gradient[i] == pytest.approx(slope / 2e-5, abs=1e-6)


def test_weights_lie_as_in_sparks_model(rows):
    weights = perceptron.first_weights(SIZES, 7)
    model = perceptron.fitted_model(weights, SIZES)
    spark_p = sorted(r[0] for r in model.transform(rows).select(vector_to_array("probability")[1]).collect())
    assert sorted(r["p"] for r in perceptron.scored(rows, weights, SIZES).collect()) == pytest.approx(spark_p, abs=1e-12)


@pytest.mark.parametrize("driver_bytes", [0, 1 << 20])
def test_rounds_learn_and_sums_do_not_depend_on_who_adds_them(rows, monkeypatch, driver_bytes):
    monkeypatch.setattr(perceptron, "DRIVER_BYTES", driver_bytes)
    monkeypatch.setattr(perceptron, "BLOCK", 7)
    monkeypatch.setattr(perceptron, "ROWS", 50)
    objective = perceptron._objective(perceptron._arrays(rows), 300, SIZES)
    weights, want = perceptron.first_weights(SIZES, 7), np.zeros(len(perceptron.first_weights(SIZES, 7)))
    held = rows.collect()
    loss = perceptron.add_gradient(np.array([r["features"].toArray() for r in held]), np.array([int(r["label_idx"]) for r in held]), weights, want, SIZES)
    value, gradient = objective(weights)
    assert value == pytest.approx(loss / 300) and gradient == pytest.approx(want / 300)
    if driver_bytes:
        found = list(perceptron.fit_rounds(rows, [3, 8, 4, 2], 3, 40))
        aucs = [auc_value(perceptron.scored(rows, w, [3, 8, 4, 2]), "p", "label_idx") for w in found]
        assert len(found) == 3 and aucs[-1] > 0.95


def test_few_rows_of_an_expensive_learner_get_all_cores(rows):
    cores = rows.sparkSession.sparkContext.defaultParallelism
    one = rows.coalesce(1)
    assert training.packed(one).rdd.getNumPartitions() == 1
    dealt = training.packed(one, part_rows=300 // cores)
    assert dealt.rdd.getNumPartitions() == cores and dealt.count() == 300
    assert dealt.agg(F.sum("snippet_id")).first()[0] == 299 * 150
    assert training.packed(rows, part_rows=200).rdd.getNumPartitions() == 1
