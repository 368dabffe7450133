"""Products of inverse curvature matrices with vectors.

A curvature operator is a function of the data that maps driver-side vectors of
the model's size, one a row, to others by one distributed sum for all of them; the iterations run on the driver.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pairs import CHUNK_PAIRS, partial_matrix
from .tasks import SoftmaxTask, softmax_rows

Product = Callable[[np.ndarray], np.ndarray]


def hvp(task: SoftmaxTask, df: DataFrame, checkpoint: int = 0, regularization: float = 0.0, mean: bool = True) -> Product:
    """Hessian-vector product of the softmax loss over ``df``: sum_i (diag(p) - p p^T) V x_i x_i^T, and regularization times V."""
    w = task.checkpoints[checkpoint]
    rows = task.rows(df)

    def product(v: np.ndarray) -> np.ndarray:
        vectors = np.atleast_2d(v)

        def part(c):
            p, out = softmax_rows(c[0] @ w.T), []
            for m in vectors:
                u = c[0] @ m.reshape(w.shape).T
                out.append(((p * u - p * (p * u).sum(axis=1, keepdims=True)).T @ c[0]).ravel())
            return np.append(np.concatenate(out), len(c[0]))

        out = partial_matrix(rows, ["x"], part, (vectors.size + 1,))
        return (out[:-1].reshape(vectors.shape) / (max(out[-1], 1) if mean else 1) + regularization * vectors).reshape(np.shape(v))

    return product


def hessian(task: SoftmaxTask, df: DataFrame, checkpoint: int = 0, regularization: float = 0.0) -> np.ndarray:
    """The whole mean Hessian, for small models."""
    w = task.checkpoints[checkpoint]
    k, d = w.shape

    def part(c):
        p, x = softmax_rows(c[0] @ w.T), c[0]
        out = np.empty((k, d, k, d))
        for a in range(k):
            for b in range(k):
                out[a, :, b, :] = (x * (p[:, a] * ((a == b) - p[:, b]))[:, None]).T @ x
        return np.append(out.ravel(), len(x))

    total = partial_matrix(task.rows(df), ["x"], part, (w.size**2 + 1,))
    return total[:-1].reshape(w.size, w.size) / max(total[-1], 1) + regularization * np.eye(w.size)


def gram_product(table: DataFrame, column: str, width: int, regularization: float = 0.0) -> Product:
    """Product with the Fisher matrix (mean outer product of a column's vectors), never built."""

    def product(v: np.ndarray) -> np.ndarray:
        vectors = np.atleast_2d(v)
        out = partial_matrix(table, [column], lambda c: np.append((vectors @ c[0].T) @ c[0], len(c[0])), (vectors.size + 1,), max(1, CHUNK_PAIRS // max(1, len(vectors))))
        return (out[:-1].reshape(vectors.shape) / max(out[-1], 1) + regularization * vectors).reshape(np.shape(v))

    return product


def matrix_product(matrix: np.ndarray) -> Product:
    """Product with a matrix that is small enough to be held: no pass over the data."""
    return lambda v: v @ matrix.T


def solve(matrix: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Explicit solve of each row of ``v``."""
    return np.linalg.solve(matrix, np.atleast_2d(v).T).T


def fisher(table: DataFrame, column: str, width: int, regularization: float = 0.0) -> np.ndarray:
    """Mean outer product of a column's vectors, and regularization on the diagonal."""
    out = partial_matrix(table, [column], lambda c: np.append((c[0].T @ c[0]).ravel(), len(c[0])), (width * width + 1,))
    return out[:-1].reshape(width, width) / max(out[-1], 1) + regularization * np.eye(width)


def conjugate_gradient(product: Product, v: np.ndarray, max_iter: int = 10) -> np.ndarray:
    """A fixed number of steps from v for each row of v together; a row whose residual is exactly zero stays as it is."""
    rows = np.atleast_2d(v).astype(float)
    x = rows.copy()
    r = rows - product(x)
    d = r.copy()
    for _ in range(max_iter):
        rr = (r * r).sum(axis=1)
        if not rr.any():
            break
        q = product(d)
        dq = (d * q).sum(axis=1)
        a = np.divide(rr, dq, out=np.zeros_like(rr), where=dq != 0)[:, None]
        x, r = x + a * d, r - a * q
        d = r + np.divide((r * r).sum(axis=1), rr, out=np.zeros_like(rr), where=rr != 0)[:, None] * d
    return x.reshape(np.shape(v))


def lissa(products: Callable[[int, int], Product], v: np.ndarray, repeats: int = 1, depth: int = 100, damping: float = 0.0, scaling: float = 50.0) -> np.ndarray:
    """Neumann recursion c <- v + (1 - damping) c - H c / scaling, over scaling; the mean of ``repeats`` runs.

    ``products(repeat, step)`` gives the batch's curvature product of a step.
    """
    out = np.zeros_like(v, dtype=float)
    for k in range(repeats):
        c = v.astype(float).copy()
        for t in range(depth):
            c = v + (1 - damping) * c - products(k, t)(c) / scaling
        out += c / scaling
    return out / repeats


def sampled_products(table: DataFrame, batch_size: int, build: Callable[[DataFrame], Product], seed: int = 0, id_col: str = "id") -> Callable[[int, int], Product]:
    """Products over hash-drawn batches of about ``batch_size`` rows; all rows if there are no more."""
    n = table.count()

    def at(repeat: int, step: int) -> Product:
        if batch_size >= n:
            return build(table)
        draw = F.pmod(F.xxhash64(F.lit(seed), F.lit(repeat), F.lit(step), id_col), F.lit(1 << 30)) / (1 << 30)
        return build(table.where(draw < batch_size / n))

    return at


def arnoldi(product: Product, width: int, max_iter: int = 100, top_k: int = 100, tol: float = 1e-7, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors as rows) of the top_k largest positive Ritz values, from a seeded start."""
    q = np.random.default_rng(seed).normal(size=width)
    basis = [q / np.linalg.norm(q)]
    h = np.zeros((max_iter + 1, max_iter))
    n = 0
    for n in range(1, min(max_iter, width) + 1):
        v = product(basis[-1])
        for _ in range(2):  # once more, for orthogonality
            for i, b in enumerate(basis):
                c = b @ v
                h[i, n - 1] += c
                v = v - c * b
        size = np.linalg.norm(v)
        if size < tol or n == min(max_iter, width):
            break
        h[n, n - 1] = size
        basis.append(v / size)
    m = h[:n, :n]
    values, vectors = np.linalg.eigh((m + m.T) / 2)
    order = [i for i in np.argsort(-np.abs(values), kind="stable")[:top_k] if values[i] > 0]
    return values[order], vectors[:, order].T @ np.stack(basis[:n])


def stable_inverse(matrix: np.ndarray, damping: float | None = None) -> np.ndarray:
    """Inverse of M + damping tr(M)/d I, by Cholesky where possible; damping is 1e-5 by default."""
    d = len(matrix)
    m = matrix + (1e-5 if damping is None else damping) * np.trace(matrix) / d * np.eye(d)
    try:
        low = np.linalg.inv(np.linalg.cholesky(m))
        return low.T @ low
    except np.linalg.LinAlgError:
        return np.linalg.inv(m)
