"""Exact nearest-neighbour Shapley values."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import pairs
from .store import RowFiles


def euclidean(train: np.ndarray, test: np.ndarray) -> np.ndarray:
    """Distance matrix, each distance from its own differences (no cancellation)."""
    return np.stack([np.sqrt(((train - t) ** 2).sum(axis=1)) for t in test], axis=1) if len(test) else np.empty((len(train), 0))


def cosine_distance(train: np.ndarray, test: np.ndarray) -> np.ndarray:
    unit = lambda m: m / np.maximum(np.sqrt((m**2).sum(axis=1, keepdims=True)), 1e-12)
    return 1 - unit(train) @ unit(test).T


def knn_shapley(train: DataFrame, test: DataFrame, k: int, distance: Callable[[np.ndarray, np.ndarray], np.ndarray] = euclidean, digits: int = 9) -> DataFrame:
    """(train_id, test_id, score): Shapley values of training rows (id, x, y) for a k-nearest-neighbour vote on each test row.

    Distances are rounded to ``digits`` places; equal ones rank by training id.  The values are running sums
    from the farthest row on, and a rank needs all distances of a test row at once, so a task takes some test rows and reads the
    training rows from files in the shared folder, batch by batch: pairs are never shuffled or written.  It takes as many test rows
    as make TASK_PAIRS pairs, one at least, of which it holds a number each.  An empty table gives an empty result.
    """
    rows = RowFiles(train, "shapley")
    n, tests = rows.count, test.count()
    kind, other = train.schema["id"].dataType.simpleString(), test.schema["id"].dataType.simpleString()
    some = max(1, pairs.TASK_PAIRS // max(1, n))

    def values(d, same):
        """Of one test row: the training rows' values, from their distances and whether their labels are the same."""
        order = np.argsort(d, kind="stable")  # rows come by id
        m, i = same[order].astype(np.float64), np.arange(1, n + 1)
        step = np.append((m[:-1] - m[1:]) / float(k) * np.minimum(k, i[:-1]) / i[:-1], m[-1] / n)
        out = np.empty(n)
        out[order] = np.cumsum(step[::-1])[::-1]
        return out

    def run(batches):
        for b in batches:
            for s in range(0, len(b) if n else 0, some):
                part = b.iloc[s : s + some]
                ids, x, y = part["id"].to_numpy(), pairs.matrix(part["x"]), part["y"].to_numpy()
                d, same, at = np.empty((len(part), n)), np.empty((len(part), n), bool), 0
                for who, tx, ty in rows.batches():
                    d[:, at : at + len(who)] = np.round(distance(tx, x), digits).T
                    same[:, at : at + len(who)] = y[:, None] == ty[None, :]
                    at += len(who)
                for j in range(len(part)):
                    d[j] = values(d[j], same[j])
                at, held, size = 0, [], 0
                for who, _, _ in rows.batches():
                    held.append((np.tile(who, len(ids)), np.repeat(ids, len(who)), d[:, at : at + len(who)].ravel()))
                    at, size = at + len(who), size + len(who) * len(ids)
                    if size >= pairs.CHUNK_PAIRS or at == n:
                        yield pd.DataFrame(dict(zip(("train_id", "test_id", "score"), map(np.concatenate, zip(*held)))))
                        held, size = [], 0

    dealt = test.select("id", "x", "y").repartition(max(1, min(tests, max(-(-tests // some), test.sparkSession.sparkContext.defaultParallelism))))
    return dealt.mapInPandas(run, f"train_id {kind}, test_id {other}, score double")
