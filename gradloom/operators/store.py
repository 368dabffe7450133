"""Tables kept between steps: chunks of representations, and a shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

LEVELS = {"memory": StorageLevel.MEMORY_ONLY, "memory_and_disk": StorageLevel.MEMORY_AND_DISK, "disk": StorageLevel.DISK_ONLY}


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``); one is made only on a local master where none is set."""
    at = spark.sparkContext.getCheckpointDir()
    if at is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="gradloom-"))
        at = spark.sparkContext.getCheckpointDir()
    return at


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which ends its lineage."""
    path = f"{scratch_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def open_shared(path: str):
    """(file system, path on it) of a path in the shared folder; local files are mapped, not copied."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    system, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return (fs.LocalFileSystem(use_mmap=True) if isinstance(system, fs.LocalFileSystem) else system), at


class RowFiles:
    """Rows (id, x, y) in order of their ids, in Arrow files of the shared folder that every task can read a batch at a time."""

    ROWS = 1024

    def __init__(self, rows: DataFrame, tag: str):
        folder, step = f"{scratch_dir(rows.sparkSession)}/{tag}-{uuid.uuid4().hex}", self.ROWS
        kind = rows.schema["id"].dataType.simpleString()

        def write(batches):
            import numpy as np
            import pandas as pd
            import pyarrow as pa

            from .pairs import matrix

            out = sink = None
            n = 0
            for b in batches:
                for s in range(0, len(b), step):
                    some = b.iloc[s : s + step]
                    x = np.ascontiguousarray(matrix(some["x"]), np.float64)
                    batch = pa.record_batch([pa.array(some["id"]), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]), pa.array(some["y"])], ["id", "x", "y"])
                    if out is None:
                        system, at = open_shared(folder)
                        system.create_dir(at, recursive=True)
                        name, first = uuid.uuid4().hex, some["id"].iloc[:1]
                        sink = system.open_output_stream(f"{at}/{name}.arrow")
                        out = pa.ipc.new_file(sink, batch.schema)
                    out.write_batch(batch)
                    n += len(some)
            if out is not None:  # a retried task writes a file of another name; only the rows that come back tell which count
                out.close()
                sink.close()
                yield pd.DataFrame({"first": first.to_numpy(), "name": [name], "n": [n]})

        found = rows.select("id", "x", "y").repartitionByRange("id").sortWithinPartitions("id").mapInPandas(write, f"first {kind}, name string, n long").collect()
        self.folder, self.names, self.count = folder, [r["name"] for r in sorted(found, key=lambda r: r["first"])], sum(r["n"] for r in found)

    def batches(self):
        """(ids, x, y) of about ROWS rows at a time; x of local files lies in mapped pages."""
        import pyarrow as pa

        system, at = open_shared(self.folder)
        for name in self.names:
            with system.open_input_file(f"{at}/{name}.arrow") as source:
                reader = pa.ipc.open_file(source)
                for i in range(reader.num_record_batches):
                    b = reader.get_batch(i)
                    x = b.column("x")
                    yield b.column("id").to_numpy(zero_copy_only=False), x.flatten().to_numpy().reshape(len(b), -1), b.column("y").to_numpy(zero_copy_only=False)


def offload(df: DataFrame, where: str = "memory_and_disk") -> DataFrame:
    """Keep a table for reuse: none, memory, memory_and_disk, disk, or shared (a written table)."""
    if where == "none":
        return df
    if where == "shared":
        return materialize(df, "offload")
    if where not in LEVELS:
        raise ValueError(f"offload must be none, shared or one of {sorted(LEVELS)}")
    return df.persist(LEVELS[where])


class ChunkStore:
    """Representations by batch number as a Parquet folder, partitioned by chunk of batches; ranges of batches read only their chunks."""

    def __init__(self, path: str, chunk: int = 16):
        self.path, self.chunk = path, chunk

    def write(self, df: DataFrame, batch_col: str = "batch", mode: str = "append") -> None:
        df.withColumn("chunk", F.floor(F.col(batch_col) / self.chunk).cast("int")).write.mode(mode).partitionBy("chunk").parquet(self.path)

    def read(self, spark: SparkSession, start: int | None = None, end: int | None = None, batch_col: str = "batch") -> DataFrame:
        """Rows of batches from ``start`` up to but without ``end``."""
        df = spark.read.parquet(self.path)
        if start is not None:
            df = df.where((F.col("chunk") >= start // self.chunk) & (F.col(batch_col) >= start))
        if end is not None:
            df = df.where((F.col("chunk") <= (end - 1) // self.chunk) & (F.col(batch_col) < end))
        return df.drop("chunk")

    def batch(self, spark: SparkSession, number: int, batch_col: str = "batch") -> DataFrame:
        return self.read(spark, number, number + 1, batch_col)

    def chunks(self, spark: SparkSession, batch_col: str = "batch") -> DataFrame:
        """(chunk, batches, rows) of each chunk, in order."""
        return spark.read.parquet(self.path).groupBy("chunk").agg(F.countDistinct(batch_col).alias("batches"), F.count(F.lit(1)).alias("rows")).orderBy("chunk")


def batch_starts(sizes: DataFrame, batch_col: str = "batch", n_col: str = "n") -> DataFrame:
    """(batch, start, end) of rows counted batch by batch; a row for each batch."""
    from pyspark.sql.window import Window

    end = F.sum(n_col).over(Window.orderBy(batch_col))
    return sizes.select(batch_col, (end - F.col(n_col)).alias("start"), end.alias("end"))
