"""Block-diagonal influence on compressed per-layer gradients."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pairs, solvers


def preconditioners(train: DataFrame, widths: dict[str, int], damping: float | None = None, hessian: str = "fisher") -> dict[str, np.ndarray]:
    """Per layer the damped inverse of the mean outer product of (id, layer, g) rows; identity if ``hessian`` is ``identity``."""
    if hessian == "identity":
        return {k: np.eye(w) for k, w in widths.items()}
    return {k: solvers.stable_inverse(solvers.fisher(train.where(F.col("layer") == k), "g", w), damping) for k, w in widths.items()}


def precondition(train: DataFrame, inverses: dict[str, np.ndarray]) -> DataFrame:
    """(id, layer, g) with each layer's inverse applied."""
    out = None
    for name, m in inverses.items():
        part = pairs.apply_matrix(train.where(F.col("layer") == name), "g", m)
        out = part if out is None else out.unionByName(part)
    return out


def attribute(train: DataFrame, test: DataFrame, inverses: dict[str, np.ndarray]) -> DataFrame:
    """(train_id, test_id, score): sum over layers of <M g_i, g_j>."""
    trains = [train.where(F.col("layer") == name).select("id", "g") for name in inverses]
    tests = [pairs.apply_matrix(test.where(F.col("layer") == name).select("id", "g"), "g", m.T) for name, m in inverses.items()]
    return pairs.score_sum(trains, tests, ["g"], [pairs.dots] * len(trains), [1.0] * len(trains))


def self_attribute(train: DataFrame, inverses: dict[str, np.ndarray]) -> DataFrame:
    """(train_id, score): sum over layers of <M g_i, g_i>."""
    from ..functions import vectors as V

    both = precondition(train.withColumn("own", F.col("g")), inverses)
    return both.groupBy(F.col("id").alias("train_id")).agg(F.sum(V.dot("own", "g")).alias("score"))
