"""Named benchmark settings: data, split, model and subsets under one name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.retrain import subset_members
from ..operators.tasks import SoftmaxTask
from .tables import table


@dataclass(frozen=True)
class Setting:
    """Training and test rows, a trained task, and the subsets that models are retrained on."""

    train: DataFrame
    test: DataFrame
    task: SoftmaxTask
    members: DataFrame


_SETTINGS: dict[str, Callable[[SparkSession, str], Setting]] = {}


def register(name: str):
    def keep(build: Callable[[SparkSession, str], Setting]):
        _SETTINGS[name] = build
        return build

    return keep


def names() -> list[str]:
    return sorted(_SETTINGS)


def load(name: str, spark: SparkSession, folder: str) -> Setting:
    if name not in _SETTINGS:
        raise KeyError(f"no setting {name!r}; there are {names()}")
    return _SETTINGS[name](spark, folder)


@register("embeddings-softmax")
def embeddings_softmax(spark: SparkSession, folder: str) -> Setting:
    """Softmax regression on ``embeddings``, two training steps; tests are the ids divisible by 50; 100 half subsets."""
    rows = table(spark, folder, "embeddings").where("vec_id is not null and embedding is not null and label is not null")
    classes, width = rows.agg(F.max("label") + 1, F.max(F.size("embedding"))).first()
    task = SoftmaxTask(int(classes), int(width)).train(rows, 2)
    return Setting(rows, rows.where("vec_id % 50 = 0"), task, subset_members(rows, 100, 0.5, 0, id_col="vec_id"))
