"""Table sources: Parquet folders, JSON and binary listings, checkpoints."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def split_by_field(spark: SparkSession, path: str, field: str = "split") -> dict[str, DataFrame]:
    """The parts of a JSON-lines source by the value of a field; the values are few and named."""
    df = spark.read.json(path)
    return {r[0]: df.where(F.col(field) == r[0]) for r in df.select(field).where(F.col(field).isNotNull()).distinct().collect()}


def binary_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, content) of files under a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "length", "content")


def numbered_folders(paths: DataFrame, column: str = "path", prefix: str = "index_") -> DataFrame:
    """(path, number) in numeric order, of paths whose last part is the prefix and a number."""
    n = F.regexp_extract(column, rf"(?:^|/){prefix}(\d+)/?$", 1)
    return paths.where(n != "").select(F.col(column).alias("path"), n.cast("long").alias("number")).orderBy("number")


class Checkpoints:
    """Model weights as a table (ckpt_idx, layer, row, values), loaded one checkpoint at a time."""

    def __init__(self, path: str):
        self.path, self._held = path, {}

    def save(self, spark: SparkSession, checkpoints: list[dict[str, np.ndarray]]) -> None:
        rows = [(k, name, i, [float(v) for v in row]) for k, c in enumerate(checkpoints) for name, w in c.items() for i, row in enumerate(np.atleast_2d(w))]
        spark.createDataFrame(rows, "ckpt_idx int, layer string, row int, values array<double>").write.mode("overwrite").partitionBy("ckpt_idx").parquet(self.path)

    def indices(self, spark: SparkSession) -> list[int]:
        return sorted(r[0] for r in spark.read.parquet(self.path).select("ckpt_idx").distinct().collect())

    def load(self, spark: SparkSession, ckpt_idx: int, layers: str | list[str] | None = None) -> dict[str, np.ndarray]:
        """Layer matrices of one checkpoint, of the layers named or all; kept until another is loaded."""
        if ckpt_idx not in self._held:
            out: dict[str, dict[int, list[float]]] = {}
            for r in spark.read.parquet(self.path).where(F.col("ckpt_idx") == ckpt_idx).collect():
                out.setdefault(r.layer, {})[r.row] = r["values"]
            self._held = {ckpt_idx: {k: np.array([v[i] for i in sorted(v)]) for k, v in out.items()}}
        found = self._held[ckpt_idx]
        names = list(found) if layers is None else [layers] if isinstance(layers, str) else layers
        return {k: found[k] for k in names}


def flatten_layers(layers: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w.ravel() for w in layers.values()]) if layers else np.empty(0)


def unflatten_layers(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    cuts = np.cumsum([w.size for w in like.values()])[:-1]
    return {k: part.reshape(w.shape) for (k, w), part in zip(like.items(), np.split(flat, cuts))}


def layer_numbers(names: list[str]) -> dict[str, int]:
    """Number of the layer of each parameter name, by first appearance of what stands before the last dot."""
    seen: dict[str, int] = {}
    return {n: seen.setdefault(n.rpartition(".")[0], len(seen)) for n in names}
