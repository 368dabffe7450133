"""Token sequences: vocabularies, blocks, windows, padding and flat token files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window


def char_vocabulary(df: DataFrame, text: str = "text") -> DataFrame:
    """(ch, id): the distinct characters in order of code point, numbered from 0; a bounded table."""
    chars = df.select(F.explode(F.array_distinct(F.split(F.col(text), ""))).alias("ch")).where("ch != ''").distinct()
    return chars.select("ch", (F.row_number().over(Window.orderBy(F.ascii("ch"), "ch")) - 1).alias("id"))


def encode_chars(df: DataFrame, vocabulary: DataFrame, text: str = "text", out: str = "tokens") -> DataFrame:
    """``df`` with the character ids of a text; the vocabulary is at most all code points and goes to every task."""
    ids = {r.ch: r.id for r in vocabulary.collect()}

    @F.pandas_udf("array<int>")
    def run(texts):
        return texts.map(lambda t: None if t is None else [ids[c] for c in t if c in ids])

    return df.withColumn(out, run(F.col(text)))


def decode_chars(df: DataFrame, vocabulary: DataFrame, tokens: str = "tokens", out: str = "text") -> DataFrame:
    chars = {r.id: r.ch for r in vocabulary.collect()}

    @F.pandas_udf("string")
    def run(rows):
        return rows.map(lambda t: None if t is None else "".join(chars[i] for i in t))

    return df.withColumn(out, run(F.col(tokens)))


def words(df: DataFrame, text: str = "text", out: str = "tokens") -> DataFrame:
    """Lower-case words of letters, digits and apostrophes."""
    return df.withColumn(out, F.expr(f"regexp_extract_all(lower({text}), '[a-z0-9\\']+', 0)"))


def blocks(df: DataFrame, size: int, id_col: str = "id", tokens: str = "tokens", pad: int = 0) -> DataFrame:
    """(id, block, x, y): tumbling blocks of each row's tokens, y shifted by one, short tails padded."""
    n = F.size(tokens)
    starts = F.when(n > 0, F.expr(f"sequence(0, size({tokens}) - 1, {size})"))
    cut = lambda at: F.slice(F.col(tokens), at, F.lit(size))
    filled = lambda a: F.concat(a, F.array_repeat(F.lit(pad).cast("int"), F.lit(size) - F.size(a)))
    rows = df.select(F.col(id_col).alias("id"), tokens, F.explode(starts).alias("at"))
    return rows.select("id", (F.col("at") / size).cast("int").alias("block"), filled(cut(F.col("at") + 1)).alias("x"), filled(F.when(F.col("at") + 2 <= n, cut(F.col("at") + 2)).otherwise(F.array().cast("array<int>"))).alias("y"))


def grouped_blocks(df: DataFrame, size: int, id_col: str = "id", tokens: str = "tokens") -> DataFrame:
    """(block, n, first_id, first_pos): where each whole block starts when all rows' tokens are joined by id; the remainder is dropped.

    Only row lengths are summed, range by range; tokens themselves stay where they are.
    """
    from ..operators.store import materialize

    placed = materialize(df.select(F.col(id_col).alias("id"), F.size(tokens).cast("long").alias("n")).repartitionByRange("id").withColumn("part", F.spark_partition_id()), "blocks")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = placed.groupBy("part").agg(F.sum("n").alias("s")).select("part", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("s0"))
    local = Window.partitionBy("part").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    at = placed.join(F.broadcast(ranges), "part").select("id", "n", (F.sum("n").over(local) - F.col("n") + F.col("s0")).alias("start"))
    total = placed.agg(F.sum("n")).first()[0] or 0
    first = F.ceil(F.col("start") / size)
    last = F.floor((F.col("start") + F.col("n") - 1) / size)
    starts = at.where((F.col("n") > 0) & (last >= first)).select("id", "start", F.explode(F.sequence(first, last)).alias("block")).where((F.col("block") + 1) * size <= total)
    return starts.select("block", F.lit(size).alias("n"), F.col("id").alias("first_id"), (F.col("block") * size - F.col("start")).alias("first_pos"))


def sliding_windows(df: DataFrame, size: int, step: int, id_col: str = "id", tokens: str = "tokens") -> DataFrame:
    """(id, at, x): windows of ``size`` tokens every ``step``; a row without a whole window gives none."""
    starts = F.when(F.size(tokens) >= size, F.expr(f"sequence(0, size({tokens}) - {size}, {step})"))
    return df.select(F.col(id_col).alias("id"), tokens, F.explode(starts).alias("at")).select("id", "at", F.slice(F.col(tokens), F.col("at") + 1, size).alias("x"))


def pad_or_cut(df: DataFrame, size: int, end: int, pad: int, id_col: str = "id", tokens: str = "tokens", offset: int = 0) -> DataFrame:
    """(id, x, y): ``size`` tokens from ``offset`` on and the same shifted by one; a short row ends with ``end`` in y, then ``pad``."""
    body = F.slice(F.col(tokens), offset + 1, size + 1)
    n = F.size(body)
    fill = lambda a: F.concat(a, F.array_repeat(F.lit(pad), size - F.size(a)))
    x = fill(F.slice(body, 1, size))
    y = F.when(n > size, F.slice(body, 2, size)).otherwise(F.when(n > 0, F.slice(fill(F.concat(F.slice(body, 2, size), F.array(F.lit(end)))), 1, size)).otherwise(fill(F.array(F.lit(end)))))
    return df.select(F.col(id_col).alias("id"), x.alias("x"), y.alias("y"))


def prefix_split(df: DataFrame, share: float = 0.9, id_col: str = "id", text: str = "text") -> DataFrame:
    """(id, train, held): the first ``share`` of each text's characters and the rest."""
    cut = F.floor(F.length(text) * share).cast("int")
    return df.select(F.col(id_col).alias("id"), F.substring(F.col(text), F.lit(1), cut).alias("train"), F.substring(F.col(text), cut + 1, F.length(text)).alias("held"))


class _Range(InputPartition):
    def __init__(self, path: str, start: int, n: int):
        self.path, self.start, self.n = path, start, n


class TokenFileSource(DataSource):
    """Flat little-endian 16-bit token files as blocks (path, block, tokens): ``spark.read.format("tokenfile").option("block", 256).load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "tokenfile"

    def schema(self) -> str:
        return "path string, block long, tokens array<int>"

    def reader(self, schema):
        return _TokenReader(self.options)


class _TokenReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.block = options["path"], int(options.get("block", 256))
        self.span = max(1, int(options.get("partitionTokens", 1 << 22)) // self.block) * self.block

    def partitions(self):
        import glob
        import os

        files = sorted(glob.glob(self.path)) if any(c in self.path for c in "*?[") else [self.path]
        return [_Range(f, s, min(self.span, os.path.getsize(f) // 2 - s)) for f in files for s in range(0, os.path.getsize(f) // 2, self.span)]

    def read(self, part):
        import numpy as np

        ids = np.fromfile(part.path, "<u2", part.n, offset=2 * part.start)
        for s in range(0, len(ids), self.block):
            yield part.path, (part.start + s) // self.block, ids[s : s + self.block].tolist()


def register(spark: SparkSession) -> None:
    """Make the ``tokenfile`` format known to a session."""
    spark.dataSource.register(TokenFileSource)
