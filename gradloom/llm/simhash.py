"""SimHash near-duplicates, searched with BK-trees.

Whole texts become 64-bit fingerprints; equal fingerprints collapse to one node
before any search, so a group of copies of any size costs one node.  Two
fingerprints within two bits agree on at least two of four 16-bit blocks, so
each node goes into six shards keyed by a pair of blocks; a shard above
``SPLIT`` nodes is split again by a pair of the four 8-bit blocks of what is left.
Its members then agree on 48 bits: no shard can exceed 65,536 nodes.  In
each shard a BK-tree, children keyed by integer Hamming distance to the
parent, is searched following only edges within the radius.  The trees travel by
shuffle, as a broadcast would grow with the corpus.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import components, materialize

RADIUS = 2
SPLIT = 1024
PAIRS = list(combinations(range(4), 2))


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of a whole text; 0 for null and for a text without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) < 3:
        return digest(join(words), 42)
    h = np.fromiter((digest(join(s), 42) for s in zip(words, words[1:], words[2:])), np.uint64, len(words) - 2)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """(id, fp) and ``more``: one row per input row, the fingerprint as a signed long; other columns are ignored."""

    @F.pandas_udf("long")
    def fp(texts):
        import pandas as pd

        return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))

    return docs.select(F.col(id_col).alias("id"), fp(F.col(text_col)).alias("fp"), *more)


class BKTree:
    """Integers under Hamming distance; children are keyed by the distance to their parent."""

    def __init__(self):
        self.root = None

    def add(self, key: int, at: int) -> None:
        if self.root is None:
            self.root = (key, at, {})
            return
        node = self.root
        while True:
            d = (node[0] ^ key).bit_count()
            child = node[2].get(d)
            if child is None:
                node[2][d] = (key, at, {})
                return
            node = child

    def within(self, key: int, radius: int) -> list[tuple[int, int]]:
        """(distance, at) of every node within ``radius``."""
        found, todo = [], [self.root] if self.root else []
        while todo:
            node = todo.pop()
            d = (node[0] ^ key).bit_count()
            if d <= radius:
                found.append((d, node[1]))
            children = node[2]
            if children:
                for k in range(d - radius, d + radius + 1):
                    if (child := children.get(k)) is not None:
                        todo.append(child)
        return found


def _blocks(x: int, width: int, which) -> list[int]:
    return [(x >> (width * b)) & ((1 << width) - 1) for b in which]


def _first_shared(x: int, width: int) -> int:
    """Of the block pairs in which the difference ``x`` is zero, the first one's number."""
    clear = [not (x >> (width * b)) & ((1 << width) - 1) for b in range(4)]
    return next(k for k, (a, b) in enumerate(PAIRS) if clear[a] and clear[b])


def _rest(x: int, pair: int) -> int:
    """The two 16-bit blocks outside ``pair``, side by side."""
    a, b = _blocks(x, 16, [b for b in range(4) if b not in PAIRS[pair]])
    return a | b << 16


def shard_links(members: list[tuple[int, int]], pair: int, inner: int) -> list[tuple[int, int, int]]:
    """(fp, rows linked, local root) of the members of one shard that link there.

    A link counts only in the first shard that both ends share, so that no link is counted twice.
    """
    tree, up = BKTree(), list(range(len(members)))

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    near = [0] * len(members)
    for i, (fp, count) in enumerate(members):
        key = fp & 0xFFFFFFFFFFFFFFFF
        for _, j in tree.within(key, RADIUS):
            x = key ^ (members[j][0] & 0xFFFFFFFFFFFFFFFF)
            if _first_shared(x, 16) == pair and (inner < 0 or _first_shared(_rest(x, pair), 8) == inner):
                near[i] += members[j][1]
                near[j] += count
                up[find(i)] = find(j)
        tree.add(key, i)
    return [(members[i][0], n, members[find(i)][0]) for i, n in enumerate(near) if n]


def _shard_key(fp, width: int, pair: tuple[int, int]):
    mask = (1 << width) - 1
    a, b = (F.shiftrightunsigned(fp, width * k).bitwiseAND(F.lit(mask)) for k in pair)
    return a.bitwiseOR(F.shiftleft(b, width))


def link_nodes(nodes: DataFrame) -> DataFrame:
    """(fp, near, root) rows of the distinct fingerprints ``nodes`` (fp, cnt): partial link counts and spanning edges."""
    fp = F.col("fp")
    keyed = nodes.select("fp", "cnt", F.explode(F.array(*[F.struct(F.lit(k).cast("int").alias("pair"), _shard_key(fp, 16, p).alias("key")) for k, p in enumerate(PAIRS)])).alias("s")).select("fp", "cnt", "s.pair", "s.key")
    sizes = keyed.groupBy("pair", "key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    shared = keyed.join(sizes, ["pair", "key"])
    small = shared.where(F.col("m") <= SPLIT).select("fp", "cnt", "pair", "key", F.lit(-1).alias("inner"), F.lit(-1).cast("long").alias("sub"))
    rest = F.lit(None).cast("long")
    for k, p in enumerate(PAIRS):
        a, b = (F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4) if i not in p)
        rest = F.when(F.col("pair") == k, a.bitwiseOR(F.shiftleft(b, 16))).otherwise(rest)
    large = (
        shared.where(F.col("m") > SPLIT)
        .withColumn("rest", rest)
        .select("fp", "cnt", "pair", "key", F.explode(F.array(*[F.struct(F.lit(k).cast("int").alias("inner"), _shard_key(F.col("rest"), 8, p).alias("sub")) for k, p in enumerate(PAIRS)])).alias("s"))
        .select("fp", "cnt", "pair", "key", "s.inner", "s.sub")
    )
    shards = (
        small.unionByName(large)
        .groupBy("pair", "key", "inner", "sub")
        .agg(F.collect_list(F.struct("fp", "cnt")).alias("members"))  # at most SPLIT, or 65,536 where 48 bits agree
        .where(F.size("members") > 1)
        .select("pair", "inner", "members")
    )

    def search(batches):
        import pandas as pd

        for b in batches:
            out = []
            for pair, inner, members in zip(b["pair"], b["inner"], b["members"]):
                out += shard_links([(int(m["fp"]), int(m["cnt"])) for m in members], pair, inner)
            yield pd.DataFrame(out, columns=["fp", "near", "root"]).astype("int64")

    return shards.mapInPandas(search, "fp long, near long, root long")


def _classes(f: DataFrame) -> DataFrame:
    """(fp, n_near, component_id, root) of the distinct fingerprints in ``f`` (id, fp)."""
    nodes = materialize(f.groupBy("fp").agg(F.count(F.lit(1)).alias("cnt"), F.min("id").alias("first")), "simhash-nodes")
    links = materialize(link_nodes(nodes.select("fp", "cnt")), "simhash-links")
    near = links.groupBy("fp").agg(F.sum("near").alias("near"))
    roots = components(links.select(F.col("fp").alias("a"), F.col("root").alias("b")))
    placed = nodes.join(near, "fp", "left").join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "cnt", "first", F.coalesce("near", F.lit(0).cast("long")).alias("near"), F.coalesce("root", "fp").alias("root"))
    heads = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    return placed.join(heads, "root").select("fp", (F.col("cnt") - 1 + F.col("near")).alias("n_near"), "component_id", "root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fingerprint, n_near, component_id), one row per input row.

    Null and empty texts have fingerprint zero and link with each other; rows that
    repeat count as rows of their own; a null id stays null and is nobody's
    component unless a whole component has null ids.  An empty table gives an
    empty result; other columns are ignored.
    """
    f = materialize(fingerprints(docs, id_col, text_col), "simhash")
    return f.join(_classes(f), "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "n_near", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near-duplicates, all columns: that of the smallest id, null ids last.

    Of rows with that id the one of the smallest fingerprint and text hash stays, and of those with that text too the first by all
    columns written as JSON; so the result doesn't depend on the table's order.  Ids may repeat: rows of one id in two
    groups are judged apart.  An empty table gives an empty result; columns may have any names.
    """
    text_hash = F.xxhash64(F.col(text_col))
    f = materialize(fingerprints(docs, id_col, text_col, text_hash.alias("h")), "simhash")
    groups = f.join(_classes(f.select("id", "fp")).select("fp", "root"), "fp").groupBy("root", "id", "fp", "h").agg(F.count(F.lit(1)).alias("n"))
    best = groups.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "fp", "h", "n")).alias("b")).select("b.id", "b.h", "b.n")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("a"), text_hash.alias("b"))
    kept = rows.join(best, F.col("a").eqNullSafe(F.col("id")) & (F.col("b") == F.col("h")))
    one = kept.where("n = 1").select("row")
    first = kept.where("n > 1").groupBy("a", "b").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row")
    return one.unionByName(first).select("row.*")


__all__ = ["BKTree", "fingerprint", "fingerprints", "keep_one", "link_nodes", "near_duplicates", "shard_links"]
