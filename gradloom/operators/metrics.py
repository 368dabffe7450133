"""How good scores are: correlations with retrained ground truth, detection curves, brittleness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.stats import correlation_p_column
from . import pairs
from .store import materialize


def _pearson(rows: DataFrame, by: str, a: str, b: str) -> DataFrame:
    found = rows.groupBy(by).agg(F.corr(a, b).alias("corr"), F.count(F.lit(1)).alias("n"))
    found = found.withColumn("corr", F.when(F.col("corr").isNull(), F.lit(float("nan"))).otherwise(F.col("corr")))
    return found.select(by, "corr", correlation_p_column(F.col("corr"), F.col("n")).alias("p"))


def loo_correlation(scores: DataFrame, truth: DataFrame) -> DataFrame:
    """(test_id, corr, p): Pearson correlation over training rows of (train_id, test_id, score) with (train_id, test_id, value)."""
    return _pearson(scores.join(truth, ["train_id", "test_id"]), "test_id", "score", "value")


def loo_correlation_of(train: DataFrame, test: DataFrame, columns: list[str], score: pairs.Score, value: pairs.Score) -> DataFrame:
    """``loo_correlation`` of two scores of the same rows (id, *columns), from moments added up where the pairs are formed."""
    m = pairs.pair_moments(train, test, columns, score, value)
    size = F.sqrt(F.col("aa")) * F.sqrt(F.col("bb"))
    found = m.select("test_id", F.when(size > 0, F.col("ab") / size).otherwise(F.lit(float("nan"))).alias("corr"), F.col("n").cast("long").alias("n"))
    return found.select("test_id", "corr", correlation_p_column(F.col("corr"), F.col("n")).alias("p"))


def average_rank(rows: DataFrame, by: list[str], column: str, out: str) -> DataFrame:
    """``rows`` with the rank of ``column`` within ``by``, equal values sharing the mean of their ranks."""
    sizes = rows.groupBy(*by, column).agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*by).orderBy(column))
    ranks = sizes.select(*by, column, (upto - (F.col("_n") - 1) / 2).alias(out))
    return rows.join(ranks, [*by, column])


def subset_sums(scores: DataFrame, members: DataFrame) -> DataFrame:
    """(subset_id, test_id, total): summed scores of each subset's training rows (subset_id, train_id)."""
    return members.join(scores, "train_id").groupBy("subset_id", "test_id").agg(F.sum("score").alias("total"))


def lds(scores: DataFrame, members: DataFrame, truth: DataFrame) -> DataFrame:
    """(test_id, corr, p): Spearman correlation over subsets of summed scores with (subset_id, test_id, value)."""
    return _rank_correlation(subset_sums(scores, members), truth)


def lds_rounded(scores: DataFrame, members: DataFrame, truth: DataFrame, digits: int) -> DataFrame:
    """``lds`` with both sides rounded before ranking, for results that other engines can repeat."""
    return lds_totals(subset_sums(scores, members), truth, digits)


def lds_totals(totals: DataFrame, truth: DataFrame, digits: int) -> DataFrame:
    """``lds_rounded`` of scores summed already (subset_id, test_id, total), as by ``pairs.subset_totals``."""
    return _rank_correlation(totals.withColumn("total", F.round("total", digits)), truth.withColumn("value", F.round("value", digits)))


def _rank_correlation(totals: DataFrame, truth: DataFrame) -> DataFrame:
    both = totals.join(truth, ["subset_id", "test_id"]).select("subset_id", "test_id", "total", "value")
    ranked = average_rank(average_rank(both, ["test_id"], "total", "r1"), ["test_id"], "value", "r2")
    return _pearson(ranked, "test_id", "r1", "r2")


def roc_points(rows: DataFrame, score: str = "score", flag: str = "noisy") -> DataFrame:
    """(score, tp, fp): of each distinct score, the flagged and other rows with that score or a higher one.

    Rows are counted by score first; the running sums go over ranges of scores, joined by prefix sums, so no single task sorts them all.
    """
    by = rows.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("score")).agg(F.sum(F.col(flag).cast("long")).alias("t"), F.sum((1 - F.col(flag).cast("long"))).alias("f"))
    placed = materialize(by.repartitionByRange(F.desc("score")).sortWithinPartitions(F.desc("score")).withColumn("part", F.spark_partition_id()), "roc")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    ranges = placed.groupBy("part").agg(F.sum("t").alias("t"), F.sum("f").alias("f")).select("part", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t0"), F.coalesce(F.sum("f").over(before), F.lit(0)).alias("f0"))
    local = Window.partitionBy("part").orderBy(F.desc("score"))
    return placed.join(F.broadcast(ranges), "part").select("score", (F.sum("t").over(local) + F.col("t0")).alias("tp"), (F.sum("f").over(local) + F.col("f0")).alias("fp"))


def detection_auc(rows: DataFrame, score: str = "score", flag: str = "noisy") -> DataFrame:
    """(auc): area under the curve of finding flagged rows by falling score, equal scores counting half.

    Null without rows of both kinds.  The trapezoids need only each score's own counts and those above it.
    """
    points = roc_points(rows, score, flag)
    by = rows.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("score")).agg(F.sum(1 - F.col(flag).cast("long")).alias("f"), F.sum(F.col(flag).cast("long")).alias("t"))
    area = points.join(by, "score").agg(F.sum(F.col("f") * (F.col("tp") - F.col("t") / 2)).alias("a"), F.max("tp").alias("t"), F.max("fp").alias("f"))
    return area.select(F.when((F.col("t") > 0) & (F.col("f") > 0), F.col("a") / (F.col("t") * F.col("f"))).alias("auc"))


def found_curve(rows: DataFrame, every: int = 100, score: str = "score", flag: str = "noisy", id_col: str = "id") -> DataFrame:
    """(checked, found): flagged rows among the first ``every``, 2 ``every`` ... rows by falling score."""
    key = [F.desc(score), F.asc(id_col)]
    placed = materialize(rows.select(id_col, score, flag).repartitionByRange(*key).sortWithinPartitions(*key).withColumn("part", F.spark_partition_id()), "curve")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"))
    local = Window.partitionBy("part").orderBy(*key)
    at = F.ceil((F.row_number().over(local) + F.col("n0")) / every) * every
    steps = placed.join(F.broadcast(ranges), "part").select(at.alias("checked"), F.col(flag).cast("long").alias("hit")).groupBy("checked").agg(F.sum("hit").alias("hit"))
    return steps.select("checked", F.sum("hit").over(Window.orderBy("checked")).alias("found"))  # one row for each step


def top_ranked(scores: DataFrame, most: int) -> DataFrame:
    """(test_id, train_id, rank): the ``most`` training rows of highest score, ranked from 1 on."""
    order = Window.partitionBy("test_id").orderBy(F.desc("score"), "train_id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("test_id", "train_id", "rank")


def top_removed(scores: DataFrame, search: list[int]) -> DataFrame:
    """(test_id, k, train_id): for each k of the search list the k training rows of highest score."""
    ks = F.explode(F.array(*[F.lit(k) for k in search])).alias("k")
    return top_ranked(scores, max([*search, 0])).select("test_id", "train_id", "rank", ks).where("rank <= k").select("test_id", "k", "train_id")


def centroid_brittleness(scores: DataFrame, train: DataFrame, test: DataFrame, search: list[int]) -> DataFrame:
    """(test_id, k): least k of the search list after whose removal the nearest-centroid class of a test row isn't its label; null if none.

    ``train``, ``test``: (id, x, y).  Retraining without k rows is the class sums less those rows, so no model is fitted twice.
    Only the training rows of highest score count, so ``scores`` may be ``pairs.top_pairs`` with the largest k.
    """
    import numpy as np
    import pandas as pd

    labels = sorted(r.y for r in train.select("y").distinct().collect())
    dim = train.select(F.size("x").alias("d")).first().d
    sums = pairs.partial_matrix(train, ["x", "y"], lambda c: np.stack([np.append(c[0][c[1] == y].sum(axis=0), (c[1] == y).sum()) for y in labels]), (len(labels), dim + 1))
    gone = top_ranked(scores, max([*search, 0])).join(train.select(F.col("id").alias("train_id"), "x", "y"), "train_id").select("test_id", "rank", "x", "y")
    own = test.select(F.col("id").alias("test_id"), F.col("x").alias("tx"), F.col("y").alias("ty"))

    def run(top, own):
        if not len(top) or not len(own):
            return pd.DataFrame({"test_id": own["test_id"].iloc[:0], "k": pd.array([], dtype="Int64")})
        tx, ty = np.array(own["tx"].iloc[0]), own["ty"].iloc[0]
        top = top.sort_values("rank")
        out, s, done = None, sums.copy(), 0
        for k in sorted(search):
            upto = int((top["rank"] <= k).sum())
            for x, y in zip(top["x"].iloc[done:upto], top["y"].iloc[done:upto]):
                s[labels.index(y)] -= np.append(x, 1.0)
            done = upto
            centre = s[:, :-1] / np.maximum(s[:, -1:], 1e-12)
            far = np.where(s[:, -1] > 0.5, ((centre - tx) ** 2).sum(axis=1), np.inf)
            if labels[int(np.argmin(far))] != ty:
                out = k
                break
        return pd.DataFrame({"test_id": [own["test_id"].iloc[0]], "k": pd.array([out], dtype="Int64")})

    kind = test.schema["id"].dataType.simpleString()
    return gone.groupBy("test_id").cogroup(own.groupBy("test_id")).applyInPandas(run, f"test_id {kind}, k long")


def token_accuracy(rows: DataFrame, predicted: str, target: str, pad: int) -> DataFrame:
    """(accuracy): share of target tokens other than ``pad`` that are predicted; the columns are arrays of tokens."""
    each = rows.select(F.explode(F.arrays_zip(F.col(predicted).alias("p"), F.col(target).alias("t"))).alias("z")).select("z.p", "z.t").where(F.col("t") != pad)
    return each.agg(F.avg((F.col("p") == F.col("t")).cast("double")).alias("accuracy"))
