"""Token counts from flat, unindexed token files.

A file is nothing but little-endian 16-bit ids, an end-of-document id after each
document.  It is scanned in blocks: each block's separators are found by one
vectorised comparison, and what a document has in earlier blocks is stitched on
by prefix scans (sums and maxima) over the blocks of a file.
"""

from __future__ import annotations

import base64
import re
import uuid
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import materialize, new_path

#: Tokens of a block; bytes of a token.
BLOCK, WIDTH = 1 << 22, 2
END_OF_DOCUMENT = 50256
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


@lru_cache(maxsize=2)
def encoder(path: str):
    """The byte-level BPE tokenizer whose ranks are in the file ``path``; every worker must be able to read it."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: Runs of white space from this length on are taken out of a text before it is split by PATTERN, whose look-ahead overflows the stack on very long ones.
LONG_SPACE = 4096


@lru_cache(maxsize=2)
def _long_space(least: int) -> re.Pattern:
    return re.compile(f"[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{{{least},}}")


def encode(text: str | None, ranks_path: str, least: int = LONG_SPACE) -> list[int]:
    """Token ids of a whole text, none for null; the same whatever ``least`` is.

    By PATTERN a run of white space is one part at a text's end, and before other characters all but its last character is.
    """
    text, model = text or "", encoder(ranks_path)
    out: list[int] = []
    at = 0
    for m in _long_space(least).finditer(text):
        last = m.end() == len(text)
        out += model.encode_ordinary(text[at : m.start()])
        out += model._encode_single_piece(text[m.start() : m.end() - (not last)])
        at = m.end() - (not last)
    return out + model.encode_ordinary(text[at:])


def _open(path: str):
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def write_flat(docs: DataFrame, folder: str, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", end: int = END_OF_DOCUMENT) -> DataFrame:
    """Write one flat file for each task to ``folder``; (file, n_bytes, ordinal, id) of each document.

    A retried task writes a file of another name; only the returned rows tell
    which files count, so write them out once before use.  Null texts have no tokens.
    """

    def run(batches):
        import pandas as pd

        out, name, size, ordinal = None, "", 0, 0
        kept = []
        for b in batches:
            if not len(b):
                continue
            if out is None:
                name = uuid.uuid4().hex
                system, at = _open(folder)
                system.create_dir(at, recursive=True)
                out = system.open_output_stream(f"{at}/{name}.bin")
            flat = []
            for text in b["text"]:
                flat.append(np.array(encode(text, ranks_path), "<u2"))
                flat.append(np.array([end], "<u2"))
            data = np.concatenate(flat).tobytes()
            out.write(data)
            size += len(data)
            kept.append(pd.DataFrame({"file": name, "ordinal": np.arange(ordinal, ordinal + len(b)), "id": b["id"]}))
            ordinal += len(b)
        if out is not None:
            out.close()
            for k in kept:
                yield k.assign(n_bytes=size)[["file", "n_bytes", "ordinal", "id"]]

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"file string, n_bytes long, ordinal long, id {kind}")


def scan_block(ids: np.ndarray, end: int) -> tuple[int, int, int, np.ndarray]:
    """(tokens before the first separator, separators, tokens after the last, lengths between)."""
    at = np.flatnonzero(ids == end)
    if not len(at):
        return len(ids), 0, len(ids), at
    return int(at[0]), len(at), len(ids) - 1 - int(at[-1]), np.diff(at) - 1


def scan(spark: SparkSession, folder: str, files: DataFrame, end: int = END_OF_DOCUMENT, block: int = BLOCK) -> DataFrame:
    """(file, ordinal, n_tokens) of each document in the flat files (file, n_bytes) of ``folder``.

    Ends themselves don't count.  Two ends in a row hold an empty document; tokens after the last end count as a document.
    """
    step = block * WIDTH
    blocks = files.where("n_bytes > 0").select("file", "n_bytes", F.posexplode(F.expr(f"sequence(0L, n_bytes - 1, {step}L)")).alias("block", "offset"))

    def run(batches):
        import pandas as pd

        for b in batches:
            out = []
            for name, size, number, offset in zip(b["file"], b["n_bytes"], b["block"], b["offset"]):
                system, at = _open(folder)
                with system.open_input_file(f"{at}/{name}.bin") as f:
                    ids = np.frombuffer(f.read_at(int(min(step, size - offset)), int(offset)), "<u2")
                head, n, tail, inner = scan_block(ids, end)
                out.append((name, number, size, offset, len(ids), head, n, tail, inner.astype(np.int64)))
            if out:
                yield pd.DataFrame(out, columns=["file", "block", "n_bytes", "offset", "n", "head", "ends", "tail", "inner"])

    spread = blocks.repartition(F.col("file"), F.col("block"))
    found = spread.mapInPandas(run, "file string, block int, n_bytes long, offset long, n long, head long, ends long, tail long, inner array<long>")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("offset") / WIDTH
    last_end = F.when(F.col("ends") > 0, (start + F.col("n") - F.col("tail")).cast("long"))
    stitched = found.withColumn("ordinal", F.coalesce(F.sum("ends").over(before), F.lit(0))).withColumn("carry", start.cast("long") - F.coalesce(F.max(last_end).over(before), F.lit(0)))
    final = (F.col("offset") + F.col("n") * WIDTH >= F.col("n_bytes")) & (F.when(F.col("ends") > 0, F.col("tail")).otherwise(F.col("carry") + F.col("n")) > 0)
    lengths = F.concat(
        F.when(F.col("ends") > 0, F.concat(F.array(F.col("carry") + F.col("head")), F.col("inner"))).otherwise(F.array().cast("array<long>")),
        F.when(final, F.array(F.when(F.col("ends") > 0, F.col("tail")).otherwise(F.col("carry") + F.col("n")))).otherwise(F.array().cast("array<long>")),
    )
    return stitched.select("file", "ordinal", F.posexplode(lengths).alias("k", "n_tokens")).select("file", (F.col("ordinal") + F.col("k")).alias("ordinal"), "n_tokens")


def count_tokens(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens), one row per input row: the documents are written as flat files to the shared folder, which are then scanned.

    Null and empty texts have no tokens; texts of any length and runs of one character are counted whole; repeated rows
    are counted each; other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    folder = new_path(spark, "tokens")
    written = materialize(write_flat(docs, folder, ranks_path, id_col, text_col), "token-files")
    counts = scan(spark, folder, written.select("file", "n_bytes").distinct())
    # no broadcast: both sides grow with the input, however well they compress
    return written.join(counts.hint("merge"), ["file", "ordinal"]).select(F.col("id").alias(id_col), "n_tokens")
