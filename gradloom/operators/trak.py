"""Kernel regression on projected gradients."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pairs
from .store import materialize


def kernel_inverse(train: DataFrame, width: int, regularization: float = 0.0) -> np.ndarray:
    """Inverse of the Gram matrix of the training rows (id, g), plus regularization."""
    return np.linalg.inv(pairs.gram(train, "g", width) + regularization * np.eye(width))


def trak(trains: list[DataFrame], tests: list[DataFrame], correct: list[DataFrame], width: int, regularization: float = 0.0) -> DataFrame:
    """(train_id, test_id, score) from one training and test table (id, g) for each checkpoint.

    ``correct``: (id, p) of the training rows under each checkpoint.  The score is
    the mean over checkpoints of <h_j, K^-1 g_i>, times the mean of 1 - p_i.
    """
    doubt = materialize(_doubt(correct), "doubt")
    held = [pairs.apply_matrix(b.select("id", "g"), "g", kernel_inverse(a, width, regularization).T) for a, b in zip(trains, tests)]
    weighted = [a.join(doubt, a["id"] == doubt["train_id"]).select(a["id"], F.transform("g", lambda v: v * F.col("q")).alias("g")) for a in trains]
    return pairs.score_sum(weighted, held, ["g"], [pairs.dots] * len(held), [1 / len(held)] * len(held))


def _doubt(correct: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, correct).groupBy(F.col("id").alias("train_id")).agg(F.avg(1 - F.col("p")).alias("q"))


def self_trak(trains: list[DataFrame], correct: list[DataFrame], width: int, regularization: float = 0.0) -> DataFrame:
    """(train_id, score) of each row with itself."""
    from ..functions import vectors as V

    parts = []
    for a in trains:
        k = kernel_inverse(a, width, regularization)
        moved = pairs.apply_matrix(a.select("id", "g", F.col("g").alias("h")), "h", k)
        parts.append(moved.select(F.col("id").alias("train_id"), V.dot("g", "h").alias("score")))
    kernel = reduce(DataFrame.unionByName, parts).groupBy("train_id").agg(F.avg("score").alias("score"))
    return kernel.join(_doubt(correct), "train_id").select("train_id", (F.col("score") * F.col("q")).alias("score"))
