"""Label views of a source: relabelling, flipping, normalising."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators.store import materialize


def standardize(df: DataFrame, column: str, mean: float, deviation: float) -> DataFrame:
    """(v - mean) / deviation of every component."""
    return df.withColumn(column, F.transform(V.vector(column), lambda v: (v - mean) / deviation))


def keep_labels(df: DataFrame, mapping: dict[int, int], label: str = "label") -> DataFrame:
    """Rows whose label is in ``mapping``, relabelled by it."""
    to = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    return df.where(F.col(label).isin(*mapping)).withColumn(label, F.element_at(to, F.col(label)).cast(df.schema[label].dataType))


def select_ids(df: DataFrame, ids: DataFrame, id_col: str = "id", order: bool = False) -> DataFrame:
    """Rows of ``df`` for ``ids`` (id, and pos if ``order``), each as often as it is listed with ``order``."""
    return df.join(ids, id_col).orderBy("pos") if order else df.join(ids, id_col, "left_semi")


def smallest_hashes(df: DataFrame, want: int, h: str, id_col: str):
    """Condition that holds for the ``want`` rows of smallest 32-bit hash ``h``, equal hashes by id; ids must be unique.

    The cut is found from counts of hash prefixes, at most 4096 of them a pass; only rows of one single hash are ever collected.
    """
    low, left = 0, want
    if want <= 0:
        return F.lit(False)
    for shift, size in ((20, 4096), (8, 4096), (0, 256)):
        inside = df.where((F.col(h) >= low) & (F.col(h) < low + (size << shift)))
        for b, n in sorted(inside.groupBy(F.shiftright(F.col(h) - low, shift).alias("b")).count().collect()):
            if n > left:
                low += b << shift
                break
            left -= n
        else:
            return F.col(h) < low + (size << shift)
    last = [r[0] for r in df.where(F.col(h) == low).select(id_col).orderBy(id_col).limit(left).collect()]
    here = F.col(h) < low
    return here | ((F.col(h) == low) & (F.col(id_col) <= last[-1])) if last else here


def flip_labels(df: DataFrame, p: float, classes: int, seed: int = 0, label: str = "label", id_col: str = "id") -> DataFrame:
    """``df`` with columns flipped and new_label: exactly int(p n) rows, those of the smallest hashes, get another label each."""
    h = df.withColumn("_h", V.hash32(F.lit(seed), id_col))
    key = id_col
    if not h.groupBy(id_col).count().where("count > 1").isEmpty():
        # rows that share an id are chosen apart, by their place in a table written once
        h, key = materialize(h.withColumn("_place", F.monotonically_increasing_id()), "flip"), "_place"
        h = h.withColumn("_h", V.hash32(F.lit(seed), id_col, key))
    chosen = smallest_hashes(h, int(p * df.count()), "_h", key)
    other = F.pmod(F.col(label) + 1 + F.pmod(V.hash32(F.lit(seed), F.lit("to"), id_col), F.lit(classes - 1)), F.lit(classes)).cast(df.schema[label].dataType)
    return h.withColumn("flipped", chosen).withColumn("new_label", F.when(F.col("flipped"), other).otherwise(F.col(label))).drop("_h", "_place")


def hash_batches(df: DataFrame, batches: int, seed: int = 0, id_col: str = "id") -> DataFrame:
    """``df`` with a batch number from 0 on, by a reproducible shuffle of the ids."""
    return df.withColumn("batch", F.floor(V.uniform(F.lit(seed), id_col) * batches).cast("int"))
