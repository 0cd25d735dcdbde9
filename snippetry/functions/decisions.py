"""Score-level expressions: threshold, decoded label, correctness, complement, sigmoid."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def decide(score: Column | str, threshold: float = 0.5) -> Column:
    """1 where the score reaches the threshold; a score equal to it is positive."""
    score = F.col(score) if isinstance(score, str) else score
    return F.when(score >= F.lit(threshold), F.lit(1)).otherwise(F.lit(0))


def correctness(predicted: Column | str, truth: Column | str) -> Column:
    predicted = F.col(predicted) if isinstance(predicted, str) else predicted
    truth = F.col(truth) if isinstance(truth, str) else truth
    return F.when(predicted == truth, F.lit("CorrectPred")).otherwise(F.lit("IncorrectPred"))


def complement(probability: Column | str) -> Column:
    probability = F.col(probability) if isinstance(probability, str) else probability
    return F.lit(1.0) - probability


def sigmoid(margin: Column | str) -> Column:
    margin = F.col(margin) if isinstance(margin, str) else margin
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))
