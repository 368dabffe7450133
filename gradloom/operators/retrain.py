"""Retraining on parts of the data, as group-by over membership tables."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V


def subset_members(ids: DataFrame, subsets: int, ratio: float = 0.5, seed: int = 0, start: int = 0, id_col: str = "id") -> DataFrame:
    """(subset_id, train_id): each row is in each subset with probability ``ratio``, by its own hash; narrow."""
    k = F.explode(F.sequence(F.lit(start), F.lit(start + subsets - 1))).alias("subset_id")
    return ids.select(F.col(id_col).alias("train_id"), k).where(V.uniform(F.lit(seed), "subset_id", "train_id") < ratio).select("subset_id", "train_id")


def hash_sample(df: DataFrame, ratio: float, seed: int = 0, id_col: str = "id") -> DataFrame:
    """Rows whose hash falls below ``ratio``."""
    return df.where(V.uniform(F.lit(seed), id_col) < ratio)


def stratified_sample(df: DataFrame, label_col: str, ratio: float, seed: int = 0, id_col: str = "id") -> DataFrame:
    """``ceil(ratio n)`` rows of each label, those of the smallest hashes, found by each label's hash quantile count."""
    from pyspark.sql.window import Window

    h = df.withColumn("_h", V.hash32(F.lit(seed), id_col))
    bucket = F.floor(F.col("_h") / (1 << 20))  # 4096 buckets: counts first, rows ranked only in the bucket that is cut
    counts = h.groupBy(label_col, bucket.alias("_b")).count()
    along = Window.partitionBy(label_col).orderBy("_b")
    counts = counts.withColumn("_upto", F.sum("count").over(along)).withColumn("_want", F.ceil(F.sum("count").over(Window.partitionBy(label_col)) * ratio))
    marked = h.withColumn("_b", bucket).join(F.broadcast(counts.select(label_col, "_b", "_upto", "_want", (F.col("_upto") - F.col("count")).alias("_before"))), [label_col, "_b"])
    rank = F.row_number().over(Window.partitionBy(label_col, "_b").orderBy("_h", id_col))
    return marked.where("_before < _want").withColumn("_r", rank).where("_before + _r <= _want").select(*df.columns)


def leave_one_out_means(df: DataFrame, value: str, by: str | None = None, id_col: str = "id") -> DataFrame:
    """(id, mean): of each row, the mean of the others (of its group) in closed form: (sum - x) / (n - 1); null if alone."""
    totals = df.groupBy(*([by] if by else [])).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    if by:
        rows = df.join(totals, by)
    else:
        s, n = totals.first()
        rows = df.withColumn("_s", F.lit(s)).withColumn("_n", F.lit(n))
    return rows.select(F.col(id_col).alias("id"), F.when(F.col("_n") > 1, (F.col("_s") - F.col(value)) / (F.col("_n") - 1)).alias("mean"))


def retrain_groups(df: DataFrame, members: DataFrame, train: Callable[[pd.DataFrame], list[float]], id_col: str = "id") -> DataFrame:
    """(subset_id, model): ``train`` on each subset's rows, a task for each subset; for models that can't be summed."""
    rows = members.join(df, members["train_id"] == df[id_col]).drop("train_id")
    return rows.groupBy("subset_id").applyInPandas(lambda key, pdf: pd.DataFrame({"subset_id": [key[0]], "model": [list(map(float, train(pdf.drop(columns="subset_id").sort_values(id_col))))]}), "subset_id int, model array<double>")


def class_centroids(df: DataFrame, members: DataFrame, x: str = "x", y: str = "y", id_col: str = "id") -> DataFrame:
    """(subset_id, y, centre): the nearest-centroid model of each subset, by map-side-combined sums."""
    rows = members.join(df, members["train_id"] == df[id_col]).select("subset_id", F.col(y).alias("y"), F.posexplode(V.vector(x)).alias("k", "v"))
    each = rows.groupBy("subset_id", "y", "k").agg(F.avg("v").alias("v"))
    return each.groupBy("subset_id", "y").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias("centre"))


def centroid_targets(centres: DataFrame, test: DataFrame, x: str = "x", y: str = "y", id_col: str = "id") -> DataFrame:
    """(subset_id, test_id, value): squared distance of each test row to the centre of its own class, a model's loss."""
    d = V.euclidean("centre", x)
    return test.select(F.col(id_col).alias("test_id"), F.col(y).alias("y"), x).join(centres, "y").select("subset_id", "test_id", (d * d).alias("value"))


def mean_targets(values: DataFrame, sign: float = -1.0) -> DataFrame:
    """(subset_id, test_id, value): mean over runs, with the sign turned so that a helpful subset's loss counts up."""
    return values.groupBy("subset_id", "test_id").agg((sign * F.avg("value")).alias("value"))
