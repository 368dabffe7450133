"""Gradient dot products over checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pairs
from .tasks import SoftmaxTask


def _cosine(train, test):
    import numpy as np

    norms = [np.prod([np.sqrt((c * c).sum(axis=1)) for c in side], axis=0) for side in (train, test)]
    return pairs.dots(train, test) / np.maximum(norms[0], 1e-12)[:, None] / np.maximum(norms[1], 1e-12)[None, :]


def tracin(task: SoftmaxTask, train: DataFrame, test: DataFrame, weights: list[float], cosine: bool = False) -> DataFrame:
    """(train_id, test_id, score): sum over checkpoints of weight times the gradients' inner product (or cosine).

    A weight for each checkpoint.  A training row's gradients at all checkpoints meet each block of test rows together.
    """
    if len(weights) != len(task.checkpoints):
        raise ValueError("a weight is needed for each checkpoint")
    score = _cosine if cosine else pairs.dots
    n = range(len(weights))
    return pairs.score_sum([task.reps(train, k) for k in n], [task.reps(test, k) for k in n], ["e", "x"], [score for _ in n], list(weights))


def grad_dot(task: SoftmaxTask, train: DataFrame, test: DataFrame) -> DataFrame:
    """Inner products of the gradients at the first checkpoint."""
    return pairs.score_pairs(task.reps(train), task.reps(test), ["e", "x"])


def grad_cosine(task: SoftmaxTask, train: DataFrame, test: DataFrame) -> DataFrame:
    return pairs.score_pairs(task.reps(train), task.reps(test), ["e", "x"], _cosine)


def self_tracin(task: SoftmaxTask, table: DataFrame, weights: list[float], cosine: bool = False) -> DataFrame:
    """(train_id, score): a row's score with itself; with cosine, the sum of the weights."""
    if len(weights) != len(task.checkpoints):
        raise ValueError("a weight is needed for each checkpoint")
    out = None
    for k, w in enumerate(weights):
        part = pairs.self_scores(task.reps(table, k), ["e", "x"])
        part = part.withColumn("score", F.lit(float(w)) if cosine else F.col("score") * w)
        out = part if out is None else out.unionByName(part)
    return out.groupBy("train_id").agg(F.sum("score").alias("score")) if len(weights) > 1 else out
