"""Representer points: test logits as sums over training rows of a refitted last layer."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pairs
from .tasks import SoftmaxTask, softmax_rows


def refit(task: SoftmaxTask, train: DataFrame, l2: float = 0.003, max_iter: int = 100, tol: float = 1e-6) -> np.ndarray:
    """Full-batch descent with backtracking on the mean loss plus l2 |W|^2, from the first checkpoint."""
    rows = task.rows(train)
    w = task.checkpoints[0].copy()

    def losses(z, y):
        top = z.max(axis=1, keepdims=True)
        return (np.log(np.exp(z - top).sum(axis=1)) + top[:, 0] - z[np.arange(len(z)), y]).sum()

    def at(m):
        def part(c):
            z = c[0] @ m.T
            g = (softmax_rows(z) - np.eye(len(m))[c[1]]).T @ c[0]
            return np.concatenate((g.ravel(), [losses(z, c[1]), len(z)]))

        out = pairs.partial_matrix(rows, ["x", "y"], part, (m.size + 2,))
        n = max(out[-1], 1)
        return out[-2] / n + l2 * (m**2).sum(), out[:-2].reshape(m.shape) / n + 2 * l2 * m, n

    steps = 10.0 * 0.5 ** np.arange(37)  # down to 1e-10
    loss, g, n = at(w)
    for _ in range(max_iter):
        if np.abs(g).mean() < tol:
            break

        def tried(c, w=w, g=g):  # every step of the line search in one pass
            return [losses(c[0] @ (w - t * g).T, c[1]) for t in steps]

        values = pairs.partial_matrix(rows, ["x", "y"], tried, (len(steps),)) / n + np.array([l2 * ((w - t * g) ** 2).sum() for t in steps])
        ok = np.flatnonzero(values <= loss - steps * (g**2).sum() / 2)
        if not len(ok):
            break
        w = w - steps[ok[0]] * g
        loss, g, n = at(w)
    return w


def weights(task: SoftmaxTask, train: DataFrame, theta: np.ndarray, l2: float) -> DataFrame:
    """(id, alpha, x): alpha = -(p - y) / (2 l2 n) of each training row under ``theta``."""
    refitted = SoftmaxTask(task.classes, task.features, [theta], task.x_col, task.y_col, task.id_col)
    reps = refitted.reps(train)
    n = reps.count()
    return reps.select("id", F.transform("e", lambda v: -v / (2 * l2 * max(n, 1))).alias("alpha"), "x")


def representer_points(task: SoftmaxTask, train: DataFrame, test: DataFrame, theta: np.ndarray, l2: float = 0.003, normalize: bool = False) -> DataFrame:
    """(train_id, test_id, score): feature product times the training row's weight for the test row's label."""
    left = weights(task, train, theta, l2)
    right = task.rows(test).select("id", F.col("x"), F.col("y"))
    unit = lambda m: m / np.maximum(np.sqrt((m**2).sum(axis=1, keepdims=True)), 1e-12) if normalize else m
    kind = right.schema["id"].dataType.simpleString()
    tests, parts = pairs.size(right, ["x", "y"])
    left = pairs.spread(left, left.count(), tests)

    def score(c, held):
        return (unit(c[0]) @ unit(held[0]).T) * c[1][:, held[1]]

    return reduce(DataFrame.unionByName, [pairs.cross(left, ["x", "alpha"], ids, held, score, kind) for ids, held in pairs.blocks(right, "id", ["x", "y"], parts)])
