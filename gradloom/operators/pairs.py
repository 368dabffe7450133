"""All-pairs scores between a training table and a stated set of test rows.

Test rows go to every task in blocks whose bytes are bounded; each block is one
narrow pass over the training rows, which multiplies Arrow batches with the
block, step by step and tile by tile, so that what a task holds at a time doesn't grow with either table.
Training rows are dealt out once to more tasks where a task would form too many pairs; pairs are never shuffled, and
what is asked of each test row (its top scores, sums or moments) is added up where the pairs are formed.
The output is the only thing that grows with both.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of test representations that one pass sends to each task.
BLOCK_BYTES = 32 << 20
#: Partial sums that one task adds.
FAN_IN = 16
#: Pairs that a task forms at a time, and test rows in one tile of them: short enough for repeated ids to compress when written.
CHUNK_PAIRS, TILE = 1 << 18, 1024
#: Pairs that one task forms in all; training rows are dealt out to more tasks beyond that.
TASK_PAIRS = 1 << 23
#: Top pairs that a task keeps at a time.
TOP_HELD = 1 << 19
Score = Callable[[list[np.ndarray], list[np.ndarray]], np.ndarray]


def matrix(column: pd.Series) -> np.ndarray:
    """Rows of a column of vectors or numbers."""
    if len(column) and isinstance(column.iloc[0], (list, np.ndarray)):
        return np.array(column.tolist(), np.float64)
    return column.to_numpy()


def dots(train: list[np.ndarray], test: list[np.ndarray]) -> np.ndarray:
    """Inner products of factored representations: the product of the factors' inner products."""
    out = train[0] @ test[0].T
    for a, b in zip(train[1:], test[1:]):
        out = out * (a @ b.T)
    return out


def size(test: DataFrame, columns: list[str]) -> tuple[int, int]:
    """(rows, blocks of about BLOCK_BYTES)."""
    sizes = [F.when(F.lit(True), F.size(c) if test.schema[c].dataType.typeName() == "array" else F.lit(1)) for c in columns]
    n, width = test.agg(F.count(F.lit(1)), F.max(sum(sizes[1:], sizes[0]))).first()
    return n, max(1, -(-(n * (width or 1) * 8) // BLOCK_BYTES))


def blocks(test: DataFrame, id_col: str, columns: list[str], parts: int | None = None) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """The test rows in blocks of about BLOCK_BYTES, by a hash of their id."""
    parts = parts or size(test, columns)[1]
    for k in range(parts):
        rows = test.where(F.pmod(F.xxhash64(id_col), F.lit(parts)) == k).select(id_col, *columns).toPandas().sort_values(id_col)
        yield rows[id_col].to_numpy(), [matrix(rows[c]) for c in columns]


def spread(train: DataFrame, rows: int, tests: int, by: str | None = None) -> DataFrame:
    """``train``, of so many rows, dealt out so that each task forms about TASK_PAIRS pairs with so many test rows at most."""
    pairs, cores = rows * tests, train.sparkSession.sparkContext.defaultParallelism
    if by is None and pairs <= TASK_PAIRS:
        return train
    parts = max(-(-pairs // TASK_PAIRS), cores)
    return train.repartition(parts) if by is None else train.repartition(parts, by)


def steps(batches: Iterator[pd.DataFrame], columns: list[str], held: list[np.ndarray], score: Score):
    """For each step of training rows: the rows, and an iterator over (first, last, matrix) of the tiles of test rows."""
    tests = len(held[0])

    def tiles(c):
        for a in range(0, tests, TILE):
            yield a, min(tests, a + TILE), score(c, [h[a : a + TILE] for h in held])

    for b in batches:
        step = max(1, CHUNK_PAIRS // max(1, min(tests, TILE)))
        for s in range(0, len(b), step) if tests else ():
            part = b.iloc[s : s + step]
            yield part, tiles([matrix(part[c]) for c in columns])


def listed(who: np.ndarray, ids: np.ndarray, m: np.ndarray) -> pd.DataFrame:
    """A matrix of scores as rows."""
    return pd.DataFrame({"train_id": np.repeat(who, len(ids)), "test_id": np.tile(ids, len(who)), "score": m.ravel()})


def cross(left: DataFrame, columns: list[str], ids: np.ndarray, held: list[np.ndarray], score: Score, kind: str, id_col: str = "id") -> DataFrame:
    """(train_id, test_id, score) of every row of ``left`` and one block of test rows, whose arrays are ``held``; ``kind`` is the type of the test ids."""

    def run(batches):
        for part, tiles in steps(batches, columns, held, score):
            who = part[id_col].to_numpy()
            for a, z, m in tiles:
                yield listed(who, ids[a:z], m)

    return left.select(id_col, *columns).mapInPandas(run, f"train_id {left.schema[id_col].dataType.simpleString()}, test_id {kind}, score double")


def score_pairs(train: DataFrame, test: DataFrame, columns: list[str], score: Score = dots, id_col: str = "id") -> DataFrame:
    """(train_id, test_id, score) of every training row and test row.

    ``columns`` are vectors or numbers of both tables; ``score`` maps some training and some test columns to a matrix.
    """
    kind = test.schema[id_col].dataType.simpleString()
    n, parts = size(test, columns)
    left = spread(train.select(id_col, *columns), train.count(), n)
    return reduce(DataFrame.unionByName, [cross(left, columns, ids, held, score, kind, id_col) for ids, held in blocks(test, id_col, columns, parts)])


def score_sum(trains: list[DataFrame], tests: list[DataFrame], columns: list[str], scores: list[Score], weights: list[float], id_col: str = "id") -> DataFrame:
    """(train_id, test_id, score): the weighted sum of the scores of several parts, checkpoints or layers.

    ``trains`` and ``tests`` have a table for each part.  A training row's parts are brought together before it meets any test row, so
    training representations are shuffled once and pairs never are.  Rows that share an id are summed.
    """
    if len(trains) == 1 and weights == [1]:
        return score_pairs(trains[0], tests[0], columns, scores[0], id_col)
    schema = f"train_id {trains[0].schema[id_col].dataType.simpleString()}, test_id {tests[0].schema[id_col].dataType.simpleString()}, score double"
    tagged = reduce(DataFrame.unionByName, [t.select(id_col, F.lit(k).alias("part"), *columns) for k, t in enumerate(trains)])
    sizes = [size(t, columns) for t in tests]
    tagged = spread(tagged, tagged.count(), max(n for n, _ in sizes), id_col).sortWithinPartitions(id_col)
    count = max(p for _, p in sizes) * len(tests)
    out = None
    for held in zip(*[blocks(t, id_col, columns, count) for t in tests]):
        ids = np.unique(np.concatenate([h[0] for h in held]))
        places = [np.searchsorted(ids, h[0]) for h in held]

        def run(batches, ids=ids, held=held, places=places):
            step = max(1, CHUNK_PAIRS // max(1, min(len(ids), TILE)))
            last, rest = None, None  # the row that may go on in the next step
            for b in batches:
                for s in range(0, len(b), step) if len(ids) else ():
                    some = b.iloc[s : s + step]
                    who, kinds = some[id_col].to_numpy(), some["part"].to_numpy()
                    own = {k: np.flatnonzero(kinds == k) for k in np.unique(kinds)}
                    reps = {k: [matrix(some.iloc[rows][c]) for c in columns] for k, rows in own.items()}
                    at = np.concatenate(([0], np.flatnonzero(who[1:] != who[:-1]) + 1))
                    if rest is not None and last != who[0]:
                        yield listed(np.array([last]), ids, rest)
                        rest = None
                    ahead = np.empty(len(ids))
                    for a in range(0, len(ids), TILE):
                        z = min(len(ids), a + TILE)
                        m = np.zeros((len(some), z - a))
                        for k, rows in own.items():
                            lo, hi = np.searchsorted(places[k], [a, z])
                            if lo == hi:
                                continue
                            to, scored = places[k][lo:hi] - a, weights[k] * scores[k](reps[k], [h[lo:hi] for h in held[k][1]])
                            if (np.diff(to) > 0).all():
                                m[np.ix_(rows, to)] += scored
                            else:  # test rows that share an id
                                np.add.at(m, (rows[:, None], to[None, :]), scored)
                        sums = np.add.reduceat(m, at, axis=0)
                        if rest is not None:
                            sums[0] += rest[a:z]
                        ahead[a:z] = sums[-1]
                        if len(at) > 1:
                            yield listed(who[at[:-1]], ids[a:z], sums[:-1])
                    last, rest = who[-1], ahead
            if rest is not None:
                yield listed(np.array([last]), ids, rest)

        part = tagged.mapInPandas(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def top_pairs(train: DataFrame, test: DataFrame, columns: list[str], most: int, score: Score = dots, id_col: str = "id") -> DataFrame:
    """(train_id, test_id, score) with the ``most`` training rows of highest score of each test row, equal ones by id, and no more than that many from each task."""
    schema = f"train_id {train.schema[id_col].dataType.simpleString()}, test_id {test.schema[id_col].dataType.simpleString()}, score double"
    n, parts = size(test, columns)
    left = spread(train.select(id_col, *columns), train.count(), n)
    out = []
    for ids, held in blocks(test, id_col, columns, max(parts, -(-n * most // TOP_HELD))):

        def run(batches, ids=ids, held=held):
            least = np.full(len(ids), -np.inf)  # the score that a row needs to be among those kept
            kept, new = None, 0
            found = []

            def narrow():
                who, at, value = (np.concatenate(x) for x in zip(*([kept] if kept else []), *found))
                order = np.lexsort((np.unique(who, return_inverse=True)[1], -value, at))
                who, at, value = who[order], at[order], value[order]
                first = np.searchsorted(at, at)
                keep = np.arange(len(at)) - first < most
                who, at, value = who[keep], at[keep], value[keep]
                counts = np.bincount(at, minlength=len(ids))
                full = np.flatnonzero(counts == most)
                least[full] = value[np.cumsum(counts)[full] - 1]
                return who, at, value

            for part, tiles in steps(batches, columns, held, score):
                who = part[id_col].to_numpy()
                for a, z, m in tiles:
                    m = np.where(np.isnan(m), np.inf, m)  # as Spark sorts
                    i, j = np.nonzero(m >= least[a:z])
                    found.append((who[i], j + a, m[i, j]))
                    new += len(i)
                    if new > 2 * TOP_HELD:
                        kept, found, new = narrow(), [], 0
            if found:
                kept = narrow()
            if kept:
                yield pd.DataFrame({"train_id": kept[0], "test_id": ids[kept[1]], "score": kept[2]})

        out.append(left.mapInPandas(run, schema))
    return reduce(DataFrame.unionByName, out)


def subset_totals(train: DataFrame, members: DataFrame, test: DataFrame, columns: list[str], score: Score = dots, id_col: str = "id") -> DataFrame:
    """(subset_id, test_id, total): summed scores of each subset's training rows (subset_id, train_id); a row for each subset and test row leaves a task."""
    names = sorted(r[0] for r in members.select("subset_id").distinct().collect())
    place = {s: i for i, s in enumerate(names)}
    schema = f"subset_id {members.schema['subset_id'].dataType.simpleString()}, test_id {test.schema[id_col].dataType.simpleString()}, total double"
    n, parts = size(test, columns)
    lists = members.groupBy("train_id").agg(F.collect_list("subset_id").alias("_in"))
    left = spread(train.select(id_col, *columns).join(lists, F.col(id_col) == lists["train_id"]).select(id_col, *columns, "_in"), train.count(), n)
    out = []
    for ids, held in blocks(test, id_col, columns, max(parts, -(-n * len(names) * 8 // BLOCK_BYTES))):

        def run(batches, ids=ids, held=held):
            total, seen = np.zeros((len(names), len(ids))), np.zeros(len(names), bool)
            for part, tiles in steps(batches, columns, held, score):
                own = np.zeros((len(names), len(part)))
                for i, subsets in enumerate(part["_in"]):
                    for s in subsets:
                        own[place[s], i] += 1
                seen |= own.any(axis=1)
                for a, z, m in tiles:
                    total[:, a:z] += own @ m
            for s in np.flatnonzero(seen):
                yield pd.DataFrame({"subset_id": names[s], "test_id": ids, "total": total[s]})

        out.append(left.mapInPandas(run, schema))
    return reduce(DataFrame.unionByName, out).groupBy("subset_id", "test_id").agg(F.sum("total").alias("total"))


def pair_moments(train: DataFrame, test: DataFrame, columns: list[str], first: Score, second: Score, id_col: str = "id") -> DataFrame:
    """(test_id, n, a, b, aa, bb, ab): over all training rows, the number, the means of two scores, and the sums of squares and products around them."""
    names = ["n", "a", "b", "aa", "bb", "ab"]
    n, parts = size(test, columns)
    left = spread(train.select(id_col, *columns), train.count(), n)
    schema = f"test_id {test.schema[id_col].dataType.simpleString()}, " + ", ".join(f"{x} double" for x in names)
    both = lambda c, t: np.stack((first(c, t), second(c, t)))
    out = []
    for ids, held in blocks(test, id_col, columns, parts):

        def run(batches, ids=ids, held=held):
            s = np.zeros((6, len(ids)))
            for part, tiles in steps(batches, columns, held, both):
                for a, z, m in tiles:
                    n, mean = s[0, a:z], m.mean(axis=1)
                    d = m - mean[:, None, :]
                    off, w = mean - s[1:3, a:z], n * len(part) / (n + len(part))
                    s[3, a:z] += (d[0] ** 2).sum(axis=0) + off[0] ** 2 * w
                    s[4, a:z] += (d[1] ** 2).sum(axis=0) + off[1] ** 2 * w
                    s[5, a:z] += (d[0] * d[1]).sum(axis=0) + off[0] * off[1] * w
                    s[1:3, a:z] += off * len(part) / (n + len(part))
                    s[0, a:z] += len(part)
            if len(ids) and s[0, 0]:
                yield pd.DataFrame({"test_id": ids} | dict(zip(names, s)))

        out.append(left.mapInPandas(run, schema))
    rows = reduce(DataFrame.unionByName, out)
    whole = rows.groupBy("test_id").agg(F.sum("n").alias("n_"), (F.sum(F.col("n") * F.col("a")) / F.sum("n")).alias("a_"), (F.sum(F.col("n") * F.col("b")) / F.sum("n")).alias("b_"))
    da, db = F.col("a") - F.col("a_"), F.col("b") - F.col("b_")
    return rows.join(whole, "test_id").groupBy("test_id").agg(
        F.first("n_").alias("n"), F.first("a_").alias("a"), F.first("b_").alias("b"),
        F.sum(F.col("aa") + F.col("n") * da * da).alias("aa"), F.sum(F.col("bb") + F.col("n") * db * db).alias("bb"), F.sum(F.col("ab") + F.col("n") * da * db).alias("ab"),
    )


def self_scores(table: DataFrame, columns: list[str], id_col: str = "id") -> DataFrame:
    """(train_id, score): each row's representation with itself."""
    from ..functions import vectors as V

    out = V.squared_norm(columns[0])
    for c in columns[1:]:
        out = out * V.squared_norm(c)
    return table.select(F.col(id_col).alias("train_id"), out.alias("score"))


def map_vectors(table: DataFrame, column: str, f: Callable[[np.ndarray], np.ndarray], out: str | None = None) -> DataFrame:
    """``table`` with ``out`` (by default ``column``) the vectors that ``f`` makes of a batch of the column's vectors.

    A mapped partition and not a column expression, so that the result may be used within higher-order functions.
    """
    from pyspark.sql import types as T

    out = out or column
    fields = [f_ for f_ in table.schema.fields if f_.name != out]
    schema = T.StructType([*fields, T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches):
        for b in batches:
            if len(b):
                b = b.copy()
                b[out] = list(f(matrix(b[column])))
                yield b[schema.names]

    return table.mapInPandas(run, schema)


def apply_matrix(table: DataFrame, column: str, m: np.ndarray) -> DataFrame:
    """``table`` with each vector v of ``column`` replaced by m v."""
    return map_vectors(table, column, lambda v: v @ m.T)


def partial_matrix(table: DataFrame, columns: list[str], part: Callable[[list[np.ndarray]], np.ndarray], shape: tuple[int, ...], rows: int | None = None) -> np.ndarray:
    """Sum of ``part`` over the table's batches, or over ``rows`` rows of them at a time: each task sends one partial sum of the model's size.

    These are added in a tree, FAN_IN neighbours to a task at each level, until the driver adds the last FAN_IN at most.
    """
    n = int(np.prod(shape))

    def run(batches):
        from pyspark import TaskContext

        acc = np.zeros(n)
        for b in batches:
            for s in range(0, len(b), rows or max(1, len(b))):
                some = b.iloc[s : s + rows] if rows else b
                acc += np.asarray(part([matrix(some[c]) for c in columns]), np.float64).ravel()
        yield pd.DataFrame({"k": [TaskContext.get().partitionId() // FAN_IN], "v": [acc]})

    def merge(pdf):
        return pd.DataFrame({"k": pdf["k"].iloc[:1] // FAN_IN, "v": [np.sum(np.stack(pdf["v"].tolist()), axis=0)]})

    tree, left = table.select(*columns).mapInPandas(run, "k long, v array<double>"), table.rdd.getNumPartitions()
    while left > FAN_IN:
        tree = tree.groupBy("k").applyInPandas(merge, "k long, v array<double>")
        left = -(-left // FAN_IN)
    rows = tree.select("v").collect()
    return np.sum([r.v for r in rows], axis=0).reshape(shape) if rows else np.zeros(shape)


def gram(table: DataFrame, column: str, width: int) -> np.ndarray:
    """Sum of the outer products of a column's vectors with themselves."""
    return partial_matrix(table, [column], lambda c: c[0].T @ c[0], (width, width))
