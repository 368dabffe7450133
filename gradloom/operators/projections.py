"""Random projections of vectors, reproducible from a seed on any engine with md5.

identity keeps a vector; normal and rademacher multiply by a dense matrix over sqrt(k);
random_mask keeps k coordinates; sjlt adds each coordinate, signed, to one
bucket; grass masks to k times a multiplier and then hashes to k.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pairs

TYPES = ("identity", "normal", "rademacher", "random_mask", "sjlt", "grass")


def hash32(*parts) -> int:
    """The driver's form of ``functions.vectors.hash32``."""
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16)


@dataclass(frozen=True)
class ProjectionParams:
    """What a projection is: its type, its width, and the seed and ensemble it is drawn for."""

    proj_dim: int
    proj_type: str = "rademacher"
    seed: int = 0
    ensemble_id: int = 0
    multiplier: int = 4

    def __post_init__(self):
        if self.proj_type not in TYPES:
            raise ValueError(f"projection type must be one of {TYPES}")
        if self.proj_dim < 1:
            raise ValueError("proj_dim must be positive")


def parse_type(text: str) -> tuple[str, int]:
    """``grass_8`` is grass with multiplier 8; the multiplier is 4 by default."""
    m = re.fullmatch(r"grass(?:_(\d+))?", text)
    return ("grass", int(m[1] or 4)) if m else (text, 4)


class Projector:
    """One drawn projection from ``width`` coordinates; linear, so chunks of coordinates may be projected apart and added."""

    def __init__(self, width: int, params: ProjectionParams):
        self.width, self.params = width, params
        k, key = params.proj_dim, (params.seed, params.ensemble_id)
        kind = params.proj_type
        self.index = self.bucket = self.sign = self.dense = None
        if kind == "normal":
            rng = np.random.default_rng([params.seed, params.ensemble_id])
            self.dense = rng.normal(size=(k, width)) / np.sqrt(k)
        elif kind == "rademacher":
            self.dense = np.array([[1.0 - 2 * (hash32(*key, i, j) & 1) for i in range(width)] for j in range(k)]) / np.sqrt(k)
        elif kind == "random_mask":
            self.index = self._mask(k)
        elif kind in ("sjlt", "grass"):
            if kind == "grass":
                self.index = self._mask(min(width, k * params.multiplier))
            n = width if self.index is None else len(self.index)
            h = [hash32(*key, "s", i) for i in range(n)]
            self.bucket = np.array([(x >> 1) % k for x in h])
            self.sign = np.array([1.0 - 2 * (x & 1) for x in h])

    def _mask(self, k: int) -> np.ndarray:
        p = self.params
        order = sorted(range(self.width), key=lambda i: (hash32(p.seed, p.ensemble_id, "m", i), i))
        return np.sort(np.array(order[:k]))

    @property
    def out_dim(self) -> int:
        return self.width if self.params.proj_type == "identity" else len(self.index) if self.bucket is None and self.index is not None else self.params.proj_dim

    def project(self, rows: np.ndarray, start: int = 0) -> np.ndarray:
        """Rows of all coordinates, or of those from ``start`` on, projected."""
        rows = np.asarray(rows, np.float64)
        if start or rows.shape[1] != self.width:
            whole = np.zeros((len(rows), self.width))
            whole[:, start : start + rows.shape[1]] = rows
            rows = whole
        if self.dense is not None:
            return rows @ self.dense.T
        if self.index is not None:
            rows = rows[:, self.index]
        if self.bucket is not None:
            out = np.zeros((len(rows), self.params.proj_dim))
            np.add.at(out.T, self.bucket, (rows * self.sign).T)
            return out
        return rows


def project_column(table: DataFrame, column: str, projector: Projector, out: str | None = None) -> DataFrame:
    """``table`` with a projected vector column, in Arrow batches."""

    return pairs.map_vectors(table, column, projector.project, out)


@dataclass(frozen=True)
class Compressor:
    """Two stages for a linear layer's gradient b a^T: project both factors, multiply them, project the product."""

    left: Projector
    right: Projector
    second: Projector | None = None

    def compress(self, b: np.ndarray, a: np.ndarray) -> np.ndarray:
        g = np.einsum("ik,id->ikd", self.left.project(b), self.right.project(a)).reshape(len(b), -1)
        return self.second.project(g) if self.second else g


def logra(out_dim: int, in_dim: int, proj_dim: int, seed: int = 0, layer: int = 0, proj_type: str = "normal") -> Compressor:
    """Two projections of sqrt(proj_dim), which must be whole."""
    k = round(proj_dim**0.5)
    if k * k != proj_dim:
        raise ValueError("proj_dim must be a perfect square")
    key = seed + 10_000 * layer
    return Compressor(Projector(out_dim, ProjectionParams(k, proj_type, key)), Projector(in_dim, ProjectionParams(k, proj_type, key, 1)))


def factgrass(out_dim: int, in_dim: int, proj_dim: int, blowup: int = 4, seed: int = 0, layer: int = 0) -> Compressor:
    """Masks both factors to sqrt(proj_dim * blowup) coordinates and hashes their product to proj_dim."""
    k = round((proj_dim * blowup) ** 0.5)
    if k * k != proj_dim * blowup:
        raise ValueError("proj_dim times blowup must be a perfect square")
    key = seed + 10_000 * layer
    left, right = Projector(out_dim, ProjectionParams(min(k, out_dim), "random_mask", key)), Projector(in_dim, ProjectionParams(min(k, in_dim), "random_mask", key, 1))
    return Compressor(left, right, Projector(left.out_dim * right.out_dim, ProjectionParams(proj_dim, "sjlt", key + 1)))


def elementwise(b: np.ndarray, a: np.ndarray, left: Projector, right: Projector) -> np.ndarray:
    """(P_a a) * (P_b b) * sqrt(k)."""
    p = right.project(a)
    return left.project(b) * p * np.sqrt(p.shape[1])


def compress_factors(factors: DataFrame, compressors: dict[str, Compressor]) -> DataFrame:
    """(id, layer, g) from (id, layer, b, a); layers without a compressor are left out."""

    def run(batches):
        for batch in batches:
            for name, part in batch.groupby("layer", sort=True):
                g = compressors[name].compress(pairs.matrix(part["b"]), pairs.matrix(part["a"]))
                yield pd.DataFrame({"id": part["id"], "layer": name, "g": list(g)})

    return factors.where(F.col("layer").isin(*compressors)).mapInPandas(run, f"id {factors.schema['id'].dataType.simpleString()}, layer string, g array<double>")
