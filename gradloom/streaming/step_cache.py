"""Training steps as a stream: each micro-batch of per-row gradients is appended to a cache that trajectory embeddings read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = "epoch int, step int, id long, eta double, g array<double>"


class StepCache:
    """(epoch, step, id, eta, g) rows in a Parquet folder, one subfolder for each epoch."""

    def __init__(self, path: str):
        self.path = path

    def append(self, df: DataFrame, epoch: int, step: int, rate: float) -> None:
        """One step's rows (id, g); eta is the rate over the number of rows."""
        n = df.count()
        rows = df.select(F.lit(step).alias("step"), F.col("id").cast("long").alias("id"), F.lit(rate / max(n, 1)).alias("eta"), F.col("g").cast("array<double>").alias("g"))
        rows.withColumn("epoch", F.lit(epoch)).write.mode("append").partitionBy("epoch").parquet(self.path)

    def read(self, spark: SparkSession, epoch: int | None = None) -> DataFrame:
        df = spark.read.parquet(self.path).select("epoch", "step", "id", "eta", "g")
        return df if epoch is None else df.where(F.col("epoch") == epoch)

    def write_stream(self, steps: DataFrame, checkpoint: str, available_now: bool = True):
        """Start a query that appends a stream of (epoch, step, id, rate, g); a replayed micro-batch overwrites its own folder."""

        def store(batch: DataFrame, number: int) -> None:
            n = batch.groupBy("epoch", "step").agg(F.count(F.lit(1)).alias("n"))
            rows = batch.join(F.broadcast(n), ["epoch", "step"])  # a row for each step of a micro-batch
            rows.select("epoch", "step", F.col("id").cast("long").alias("id"), (F.col("rate") / F.col("n")).alias("eta"), F.col("g").cast("array<double>").alias("g")).write.mode("overwrite").parquet(f"{self.path}/batch={number}")

        writer = steps.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()

    def clear(self, spark: SparkSession) -> None:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def running_covariance(factors: DataFrame, sizes: tuple[int, int]) -> dict:
    """Means of a a^T and b b^T over (b, a) rows, from partial sums that merge in any order (so micro-batches add up)."""
    from ..operators.pairs import partial_matrix
    import numpy as np

    m, d = sizes
    s = partial_matrix(factors, ["b", "a"], lambda c: np.concatenate(((c[1].T @ c[1]).ravel(), (c[0].T @ c[0]).ravel(), [len(c[0])])), (d * d + m * m + 1,))
    n = max(s[-1], 1)
    return {"n": int(s[-1]), "inputs": s[: d * d].reshape(d, d) / n, "outputs": s[d * d : -1].reshape(m, m) / n}
