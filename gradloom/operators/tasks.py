"""Models whose per-row gradients are columns.

A task turns rows into factored representations: the gradient of a linear layer
is the outer product of an output gradient and an input, so the two
factors travel and their product is never built unless asked for.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pairs import matrix, partial_matrix


def softmax_rows(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class SoftmaxTask:
    """Softmax regression with a bias on a vector column; labels are integers from 0 on.

    ``checkpoints`` are weight matrices (classes x features + 1), by default the zero model.
    """

    classes: int
    features: int
    checkpoints: list[np.ndarray] = field(default_factory=list)
    x_col: str = "embedding"
    y_col: str = "label"
    id_col: str = "vec_id"

    def __post_init__(self):
        if not self.checkpoints:
            self.checkpoints = [np.zeros((self.classes, self.features + 1))]

    def rows(self, df: DataFrame) -> DataFrame:
        """(id, x with a one appended, y); rows without id, vector or label are left out."""
        x = F.concat(F.col(self.x_col).cast("array<double>"), F.array(F.lit(1.0)))
        return df.where(F.col(self.id_col).isNotNull() & F.col(self.x_col).isNotNull() & F.col(self.y_col).isNotNull()).select(F.col(self.id_col).alias("id"), x.alias("x"), F.col(self.y_col).cast("int").alias("y"))

    def gradient(self, df: DataFrame, w: np.ndarray) -> tuple[np.ndarray, int]:
        """Sum of the loss gradients over ``df`` and the number of rows: one pass, a model-sized sum from each task."""

        def part(c):
            x, y = c
            e = softmax_rows(x @ w.T) - np.eye(len(w))[y]
            return np.append((e.T @ x).ravel(), len(x))

        out = partial_matrix(self.rows(df), ["x", "y"], part, (w.size + 1,))
        return out[:-1].reshape(w.shape), int(out[-1])

    def train(self, df: DataFrame, steps: int, rate: float = 1.0, l2: float = 0.0) -> "SoftmaxTask":
        """The same task with the checkpoints after 0 to ``steps`` full-batch gradient steps."""
        out = [self.checkpoints[0]]
        for _ in range(steps):
            g, n = self.gradient(df, out[-1])
            out.append(out[-1] - rate * (g / max(n, 1) + l2 * out[-1]))
        return SoftmaxTask(self.classes, self.features, out, self.x_col, self.y_col, self.id_col)

    def reps(self, df: DataFrame, checkpoint: int = 0) -> DataFrame:
        """(id, e, x): loss gradient with respect to the logits, and the input; the gradient is e x^T."""
        w = self.checkpoints[checkpoint]

        def run(batches):
            for b in batches:
                if len(b):
                    e = softmax_rows(matrix(b["x"]) @ w.T) - np.eye(len(w))[b["y"].to_numpy()]
                    yield pd.DataFrame({"id": b["id"], "e": list(e), "x": b["x"]})

        rows = self.rows(df)
        return rows.mapInPandas(run, f"id {rows.schema['id'].dataType.simpleString()}, e array<double>, x array<double>")

    def probabilities(self, df: DataFrame, checkpoint: int = 0) -> DataFrame:
        """(id, y, p): class probabilities."""
        w = self.checkpoints[checkpoint]

        def run(batches):
            for b in batches:
                if len(b):
                    yield pd.DataFrame({"id": b["id"], "y": b["y"], "p": list(softmax_rows(matrix(b["x"]) @ w.T))})

        rows = self.rows(df)
        return rows.mapInPandas(run, f"id {rows.schema['id'].dataType.simpleString()}, y int, p array<double>")

    def losses(self, df: DataFrame, checkpoint: int = 0) -> DataFrame:
        """(id, loss): cross entropy of each row."""
        return self.probabilities(df, checkpoint).select("id", (-F.log(F.element_at("p", F.col("y") + 1))).alias("loss"))

    def correct_probability(self, df: DataFrame, checkpoint: int = 0) -> DataFrame:
        """(id, p): probability of a row's own label."""
        return self.probabilities(df, checkpoint).select("id", F.element_at("p", F.col("y") + 1).alias("p"))


def flat(reps: DataFrame) -> DataFrame:
    """(id, g): the outer products of (id, e, x), row by row."""
    from ..functions import vectors as V

    return reps.select("id", V.outer("e", "x").alias("g"))


@dataclass
class MLPTask:
    """One hidden ReLU layer and a softmax layer; both are linear layers with a bias.

    ``layers``: [(hidden x features + 1), (classes x hidden + 1)] of each checkpoint.
    """

    checkpoints: list[list[np.ndarray]]
    x_col: str = "embedding"
    y_col: str = "label"
    id_col: str = "vec_id"
    names: tuple[str, str] = ("fc1", "fc2")

    @staticmethod
    def forward(x: np.ndarray, layers: list[np.ndarray]):
        h = np.maximum(x @ layers[0].T, 0)
        h1 = np.concatenate((h, np.ones((len(h), 1))), axis=1)
        return h1, softmax_rows(h1 @ layers[1].T)

    @classmethod
    def backward(cls, x: np.ndarray, y: np.ndarray, layers: list[np.ndarray]):
        """[(output gradient, input)] of both layers."""
        h1, p = cls.forward(x, layers)
        e = p - np.eye(len(layers[1]))[y]
        d = (e @ layers[1][:, :-1]) * (h1[:, :-1] > 0)
        return [(d, x), (e, h1)]

    def _rows(self, df: DataFrame) -> DataFrame:
        return SoftmaxTask(1, 1, [], self.x_col, self.y_col, self.id_col).rows(df)

    def factors(self, df: DataFrame, checkpoint: int = 0) -> DataFrame:
        """(id, layer, b, a): a row for each row and layer; the layer's gradient is b a^T."""
        layers, names = self.checkpoints[checkpoint], self.names

        def run(batches):
            for batch in batches:
                if len(batch):
                    for name, (b, a) in zip(names, self.backward(matrix(batch["x"]), batch["y"].to_numpy(), layers)):
                        yield pd.DataFrame({"id": batch["id"], "layer": name, "b": list(b), "a": list(a)})

        rows = self._rows(df)
        return rows.mapInPandas(run, f"id {rows.schema['id'].dataType.simpleString()}, layer string, b array<double>, a array<double>")

    def train(self, df: DataFrame, steps: int, rate: float = 0.5) -> "MLPTask":
        """The checkpoints after 0 to ``steps`` full-batch gradient steps."""
        out = [self.checkpoints[0]]
        for _ in range(steps):
            layers = out[-1]
            sizes = [w.size for w in layers]

            def part(c, layers=layers):
                grads = [(b.T @ a).ravel() for b, a in self.backward(c[0], c[1], layers)]
                return np.concatenate((*grads, [len(c[0])]))

            total = partial_matrix(self._rows(df), ["x", "y"], part, (sum(sizes) + 1,))
            n = max(1.0, total[-1])
            out.append([w - rate * g.reshape(w.shape) / n for w, g in zip(layers, np.split(total[:-1], [sizes[0]]))])
        return MLPTask(out, self.x_col, self.y_col, self.id_col, self.names)
