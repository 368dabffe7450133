"""Data value embeddings along a training trajectory."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pairs


def trajectory_embeddings(steps: DataFrame, width: int) -> DataFrame:
    """(epoch, id, g) from cached steps (epoch, step, id, eta, g): for each step, last first, E = eta g - eta g M^T, then M += E^T g.

    M has the model's (projected) width and lives on the driver; a step is one partial sum over its rows.  The rows' embeddings come in one last
    pass, each against the M of its own step, which are sent by step in blocks.  A step's eta is its rate over its batch size; an id that repeats is summed.
    """
    order = [(r.epoch, r.step) for r in steps.select("epoch", "step").distinct().orderBy(F.desc("epoch"), F.desc("step")).collect()]
    m = np.zeros((width, width))
    out, held = None, {}

    def emit(held):
        some = steps.where(F.struct("epoch", "step").isin(*[F.struct(F.lit(e), F.lit(s)) for e, s in held]))
        kind = steps.schema["id"].dataType.simpleString()

        def run(batches):
            for b in batches:
                for (e, s), part in b.groupby(["epoch", "step"]):
                    g = pairs.matrix(part["g"]) * part["eta"].to_numpy()[:, None]
                    yield pd.DataFrame({"epoch": e, "id": part["id"], "g": list(g - g @ held[e, s].T)})

        return some.select("epoch", "step", "id", "eta", "g").mapInPandas(run, f"epoch int, id {kind}, g array<double>")

    for e, s in order:
        held[e, s] = m
        now = m

        def part(c, now=now):
            g = c[0] * c[1][:, None]
            return (g - g @ now.T).T @ c[0]

        m = now + pairs.partial_matrix(steps.where((F.col("epoch") == e) & (F.col("step") == s)), ["g", "eta"], part, (width, width))
        if len(held) * width * width * 8 > pairs.BLOCK_BYTES:
            found = emit(held)
            out, held = found if out is None else out.unionByName(found), {}
    if held or out is None:
        found = emit(held) if held else steps.limit(0).select("epoch", "id", "g")
        out = found if out is None else out.unionByName(found)
    return summed(out, "epoch", "id")


def summed(rows: DataFrame, *keys: str) -> DataFrame:
    """(*keys, g): the vectors ``g`` of the rows that share their keys, added up."""
    each = rows.select(*keys, F.posexplode("g").alias("k", "v")).groupBy(*keys, "k").agg(F.sum("v").alias("v"))
    return each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("kv")).select(*keys, F.col("kv.v").alias("g"))


def attribute(embeddings: DataFrame, test: DataFrame, epoch: int | None = None, ids: DataFrame | None = None) -> DataFrame:
    """(train_id, test_id, score): <E_i, h_j> of one epoch, or summed over epochs; ``ids`` (id) restricts the training rows.

    The sum over epochs is taken of the embeddings, before they meet any test row, so pairs are never shuffled.
    """
    some = embeddings if epoch is None else embeddings.where(F.col("epoch") == epoch)
    if ids is not None:
        some = some.join(ids, "id", "left_semi")
    some, test = some.select("id", "g"), test.select("id", "g")
    if epoch is None:
        some, test = summed(some, "id"), summed(test, "id")
    return pairs.score_pairs(some, test, ["g"])
