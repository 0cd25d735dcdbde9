"""Quality classifier learned from trusted positives and unlabelled text.

A logistic model on statistics of the text is fitted by minimising the non-negative positive-unlabelled risk: with class prior
pi, trusted positives P and unlabelled rows U, and loss l(z) = log(1 + exp(-z)),

    pi * E_P[l(z)] + max(0, E_U[l(-z)] - pi * E_P[l(-z)]) + penalty.

For this loss the sum without the maximum is convex and Newton steps minimise it; wherever the bracket falls below zero, which
no true negative risk can, a step is taken that raises it again. Each pass adds up gradients and curvature on Spark over all
learning rows and brings back a few hundred numbers. No negative row enters the fit; the class prior is estimated as the
share of positives among the labelled learning rows.

Defined cases: a null text counts as empty, and empty texts get a score too. A row labelled both ways is not trusted. Without
positives or unlabelled rows nothing can be learned: all scores are the prior (0.5 if there is none either). Rows are scored
by themselves; extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from snippetry.llm.common import raw

# Counts of these bytes are features, each relative to the number of words.
MARKS = [b"#", b"*", b"$", b"%", b"&", b"|", b"<>{}[]", b"!", b"?", b".", b",", b"0123456789", b"/\\_=~^@+"]
NAMES = [
    "log_words", "word_length", "capitals", "beyond_ascii", "distinct_words", "same_as_last", "distinct_triples", "line_copies",
    "log_line_words", "is_empty", *[f"marks_{i}" for i in range(len(MARKS))],
]
_CAPITALS, _SMALL = slice(65, 91), slice(97, 123)


def statistics(text: bytes | None) -> list[float]:
    """The features of one text, in the order of NAMES, all within a few units of 0."""
    text = text or b""
    found = text.split()
    n = len(found)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    if not n:
        return [0.0] * 9 + [1.0] + [0.0] * len(MARKS)
    capitals, small = int(counts[_CAPITALS].sum()), int(counts[_SMALL].sum())
    lines = [x for x in text.split(b"\n") if x.strip()]
    triples = max(n - 2, 1)
    return [
        np.log1p(n) / 5,
        min(sum(map(len, found)) / n / 10, 3.0),
        capitals / max(capitals + small, 1),
        int(counts[128:].sum()) / len(text),
        len(set(found)) / n,
        sum(a == b for a, b in zip(found, found[1:])) / n,
        len(set(zip(found, found[1:], found[2:]))) / triples if n > 2 else 1.0,
        1 - len(set(lines)) / len(lines),
        np.log1p(n / len(lines)) / 5,
        0.0,
        *[min(int(counts[list(m)].sum()) / n, 2.0) for m in MARKS],
    ]


def featured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, x): one array of statistics a row."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t) for t in raw(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "x"])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(compute, "doc_id bigint, x array<double>")


def with_trust(features: DataFrame, labels: DataFrame, learn: Column) -> DataFrame:
    """Adds quality (1, 0, null: unlabelled or not to be learned from) and learn."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    out = features.withColumn("learn", learn).join(known, "doc_id", "left")
    return out.withColumn("quality", F.when(F.col("learn"), F.col("quality")))


@dataclass
class PositiveUnlabelled:
    weights: list[float]
    centre: list[float]
    scale: list[float]
    prior: float

    def logit(self, x: str = "x") -> Column:
        """weights . (x - centre) / scale plus the intercept, which is the last weight."""
        if not self.centre:
            return F.lit(float(np.log(self.prior / (1 - self.prior))))
        slopes = [w / s for w, s in zip(self.weights, self.scale)]
        start = self.weights[-1] - sum(a * c for a, c in zip(slopes, self.centre))
        total = F.lit(float(start))
        for i, a in enumerate(slopes):
            total = total + F.col(x)[i] * float(a)
        return total

    def scored(self, features: DataFrame) -> DataFrame:
        return features.withColumn("score", 1 / (1 + F.exp(-F.greatest(F.least(self.logit(), F.lit(500.0)), F.lit(-500.0)))))


def _sums(rows: DataFrame, centre: np.ndarray, scale: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Over the unlabelled rows, then the positives: their number, sum of log(1 + e^z), gradient and curvature (of U alone)."""
    d = len(centre) + 1

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * (2 + 2 * d) + d * d)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.asarray(batch.column("x").flatten()).reshape(batch.num_rows, -1)
            x = np.hstack([(x - centre) / scale, np.ones((len(x), 1))])
            positive = np.asarray(batch.column("positive"))
            z = np.clip(x @ w, -500, 500)
            s = 1 / (1 + np.exp(-z))
            for k, own in enumerate((~positive, positive)):
                at = k * (2 + 2 * d)
                total[at] += own.sum()
                total[at + 1] += np.logaddexp(0, z[own]).sum()
                total[at + 2 : at + 2 + d] += s[own] @ x[own]
                total[at + 2 + d : at + 2 + 2 * d] += x[own].sum(axis=0)
            u = x[~positive]
            total[-d * d :] += ((u * (s * (1 - s))[~positive, None]).T @ u).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int64()), pa.array(total)], ["i", "v"])

    added = rows.mapInArrow(partial, "i bigint, v double").groupBy("i").agg(F.sum("v").alias("v"))
    out = np.zeros(2 * (2 + 2 * d) + d * d)
    for i, v in added.collect():
        out[i] = v
    return out


def fit(features: DataFrame, steps: int = 12, penalty: float = 1e-3, push: float = 0.1) -> PositiveUnlabelled:
    """``features`` are staged rows of with_trust(). ``steps`` Newton steps at most."""
    learn = features.where("learn")
    labelled = learn.agg(F.avg("quality"), F.count("quality"), F.count("*")).first()
    prior = min(max(labelled[0], 0.01), 0.99) if labelled[1] else 0.5
    # Labelled rows that are not positive take no part; with nothing unlabelled all learning rows stand for the web.
    alone = F.col("quality").isNull() if labelled[2] > labelled[1] else F.lit(True)
    positive = learn.where("quality = 1").select("x", F.lit(True).alias("positive"))
    rows = positive.unionAll(learn.where(alone).select("x", F.lit(False).alias("positive")))
    d = len(NAMES)
    moments = rows.where("NOT positive").agg(*[f(F.col("x")[i]) for i in range(d) for f in (F.avg, F.stddev_pop)]).first()
    if moments[0] is None or not positive.head(1):
        return PositiveUnlabelled([], [], [], prior)
    centre = np.array(moments[0::2], dtype=float)
    scale = np.array([s if s > 1e-9 else 1.0 for s in moments[1::2]])
    w = np.zeros(d + 1)
    for _ in range(steps):
        v = _sums(rows, centre, scale, w)
        block = 2 + 2 * (d + 1)
        (n_u, loss_u), (n_p, loss_p) = v[:2], v[block : block + 2]
        grad_u, grad_p = v[2 : 3 + d] / n_u, v[block + 2 : block + 3 + d] / n_p
        mean_p = v[block + 3 + d : block + 4 + 2 * d] / n_p
        curve = v[-(d + 1) * (d + 1) :].reshape(d + 1, d + 1) / n_u
        ridge = penalty * np.append(np.ones(d), 1e-3)
        if loss_u / n_u - prior * loss_p / n_p < 0:
            w = w + push * (grad_u - prior * grad_p)
            continue
        # l(z) - l(-z) = -z, so pi E_P[l(z)] - pi E_P[l(-z)] is linear in the weights.
        gradient = grad_u - prior * mean_p + ridge * w
        step = np.linalg.solve(curve + np.diag(ridge), gradient)
        step *= min(1.0, 3.0 / max(np.linalg.norm(step), 1e-12))
        w = w - step
        if np.abs(step).max() < 1e-4:
            break
    return PositiveUnlabelled(list(w), list(centre), list(scale), prior)
