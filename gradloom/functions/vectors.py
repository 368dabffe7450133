"""Vector, matrix and hash functions as Spark columns; arrays of doubles stand for vectors.

All are built-in higher-order expressions, so they stay in the JVM and mix with
any other column.  A null vector gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_DOUBLE = 1.7976931348623157e308


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def vector(x) -> Column:
    return _c(x).cast("array<double>")


def total(x) -> Column:
    return F.aggregate(vector(x), F.lit(0.0), lambda a, v: a + v)


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(vector(a), vector(b), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def squared_norm(x) -> Column:
    return F.aggregate(vector(x), F.lit(0.0), lambda s, v: s + v * v)


def norm(x, least: float = 0.0) -> Column:
    return F.greatest(F.sqrt(squared_norm(x)), F.lit(least))


def scale(x, by) -> Column:
    return F.transform(vector(x), lambda v: v * by)


def normalize(x, least: float = 1e-12) -> Column:
    n = norm(x, least)
    return F.transform(vector(x), lambda v: v / n)


def cosine(a, b) -> Column:
    return dot(a, b) / (norm(a, 1e-12) * norm(b, 1e-12))


def euclidean(a, b) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(vector(a), vector(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def add(a, b) -> Column:
    return F.zip_with(vector(a), vector(b), lambda x, y: x + y)


def subtract(a, b) -> Column:
    return F.zip_with(vector(a), vector(b), lambda x, y: x - y)


def multiply(a, b) -> Column:
    return F.zip_with(vector(a), vector(b), lambda x, y: x * y)


def outer(b, a) -> Column:
    """Row-major flattened outer product of ``b`` and ``a``."""
    return F.flatten(F.transform(vector(b), lambda y: F.transform(vector(a), lambda x: y * x)))


def matvec(rows: list[list[float]], x) -> Column:
    """A small driver-side matrix, given by rows, times a vector."""
    return F.array(*[dot(F.lit(list(map(float, r))), x) for r in rows])


def append_one(x) -> Column:
    return F.concat(vector(x), F.array(F.lit(1.0)))


def softmax(z) -> Column:
    top = F.array_max(vector(z))
    e = F.transform(vector(z), lambda v: F.exp(v - top))
    return F.transform(e, lambda v: v / total(e))


def sigmoid(x) -> Column:
    return 1 / (1 + F.exp(-_c(x)))


def one_hot(y, classes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda k: F.when(k == _c(y), 1.0).otherwise(0.0))


def cross_entropy(z, y) -> Column:
    """Of logits ``z`` and a label from 0 on."""
    top = F.array_max(vector(z))
    return F.log(total(F.transform(vector(z), lambda v: F.exp(v - top)))) + top - F.element_at(vector(z), _c(y).cast("int") + 1)


def smoothed_cross_entropy(z, y, smoothing: float, ignore: int = -100) -> Column:
    """Label-smoothed cross entropy; null for ignored labels."""
    k = F.size(vector(z))
    uniform = cross_entropy(z, F.lit(0)) + F.element_at(vector(z), 1) - total(z) / k
    return F.when(_c(y) != ignore, (1 - smoothing) * cross_entropy(z, y) + smoothing * uniform)


def log_odds(logp) -> Column:
    return _c(logp) - F.log(1 - F.exp(_c(logp)))


def nan_to_num(x) -> Column:
    """NaN to 0 and infinities to the largest doubles, element by element."""
    return F.transform(vector(x), lambda v: F.when(F.isnan(v), 0.0).when(v > MAX_DOUBLE, MAX_DOUBLE).when(v < -MAX_DOUBLE, -MAX_DOUBLE).otherwise(v))


def hash32(*parts) -> Column:
    """First 32 bits of the md5 of the parts joined by colons; any SQL engine with md5 can repeat it."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[_c(p).cast("string") if isinstance(p, (Column, str)) else F.lit(str(p)) for p in parts])), 1, 8), 16, 10).cast("long")


def uniform(*parts) -> Column:
    """A reproducible number from [0, 1)."""
    return hash32(*parts) / F.lit(4294967296.0)


def dropout(x, p: float, *key) -> Column:
    """Hash-seeded dropout: an element goes with probability ``p``, the others grow by 1/(1-p)."""
    return F.transform(vector(x), lambda v, i: F.when(uniform(*key, i) < p, 0.0).otherwise(v / (1 - p)))
