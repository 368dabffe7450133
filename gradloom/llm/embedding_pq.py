"""Embedding near-duplicates by product quantisation.

Coarse inverted lists (k-means) with residual codes in subspaces.  Every vector
is indexed in its nearest list and queries its nearest ``PROBES`` lists.  In a
list, table-lookup distances between an exact query and coded members rule pairs
out; as each member's own quantisation error is kept, the triangle inequality makes that
exact.  What is left is ranked again by cosine in double precision.  Lists are worked
in blocks of bounded size, pairs of blocks spread over tasks; equal vectors
collapse to one node first.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import components, materialize

#: Rows that the index is fitted to, about; lists probed; subspaces; codes of each; members of a block.
FIT_ROWS, PROBES, SUBSPACES, CODES, BLOCK = 20_000, 4, 8, 256, 2048
COSINE = 0.9


def _kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        at = _nearest(x, centres, 1)[:, 0]
        n = np.bincount(at, minlength=len(centres))
        for d in range(x.shape[1]):
            total = np.bincount(at, x[:, d], len(centres))
            centres[:, d] = np.where(n > 0, total / np.maximum(n, 1), centres[:, d])
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the ``k`` nearest centres of each row, nearest first."""
    out = np.empty((len(x), k), np.int64)
    half = (centres**2).sum(axis=1) / 2
    for a in range(0, len(x), 4096):
        far = half - x[a : a + 4096] @ centres.T
        out[a : a + 4096] = np.argsort(far, axis=1, kind="stable")[:, :k] if k > 1 else far.argmin(axis=1)[:, None]
    return out


class Quantiser:
    """Coarse centres and residual codebooks."""

    def __init__(self, sample: np.ndarray, lists: int, probes: int = PROBES):
        self.centres = _kmeans(sample, max(1, min(lists, len(sample))))
        self.probes = min(probes, len(self.centres))
        home = _nearest(sample, self.centres, 1)[:, 0]
        residual = sample - self.centres[home]
        self.spans = np.array_split(np.arange(sample.shape[1]), min(SUBSPACES, sample.shape[1]))
        self.books = [_kmeans(residual[:, s], min(CODES, len(sample)), seed=5 + i) for i, s in enumerate(self.spans)]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(lists probed, home first; codes; quantisation errors) of unit rows."""
        lists = _nearest(x, self.centres, self.probes)
        residual = x - self.centres[lists[:, 0]]
        codes = np.stack([_nearest(residual[:, s], b, 1)[:, 0] for s, b in zip(self.spans, self.books)], axis=1).astype(np.uint8)
        return lists, codes, np.sqrt(((residual - self.decode(codes)) ** 2).sum(axis=1))

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([b[codes[:, i]] for i, b in enumerate(self.books)], axis=1)

    def lookup(self, queries: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Squared table-lookup distances between unit rows and the coded members of list ``at``."""
        residual = queries - self.centres[at]
        out = np.zeros((len(queries), len(codes)))
        for i, (s, b) in enumerate(zip(self.spans, self.books)):
            r = residual[:, s]
            tables = (r**2).sum(axis=1)[:, None] - 2 * r @ b.T + (b**2).sum(axis=1)
            out += tables[:, codes[:, i]]
        return out


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows divided by a power of two each, exactly, so that their largest component is near one and no square over- or underflows."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0))[1][:, None])


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row number reachable from each of ``n`` rows over the pairs (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            return label


def block_links(q: Quantiser, at: int, role: np.ndarray, node: np.ndarray, cnt: np.ndarray, x: np.ndarray, lists: np.ndarray, codes: np.ndarray, err: np.ndarray, cosine: float):
    """(node, rows linked, local root) of one block of list ``at``; role 0: member, 1: query, 2: both.

    A pair that two lists could find counts in the smaller one only.
    """
    size = np.sqrt((x**2).sum(axis=1))
    unit = x / size[:, None]
    members, queries = np.flatnonzero(role != 1), np.flatnonzero(role != 0)
    reach = np.sqrt(2 - 2 * cosine) + err[members] + 1e-7
    found_a, found_b = [], []
    for s in range(0, len(queries), 512):
        some = queries[s : s + 512]
        i, j = np.nonzero(q.lookup(unit[some], at, codes[members]) <= reach**2)
        a, b = some[i], members[j]
        keep = (role[a] != 2) | (role[b] != 2) | (a > b)
        a, b = a[keep], b[keep]
        home = lists[a, 0]
        keep = (home == at) | ~(lists[b] == home[:, None]).any(axis=1) | (at < home)
        a, b = a[keep], b[keep]
        for t in range(0, len(a), 50_000):
            u, v = a[t : t + 50_000], b[t : t + 50_000]
            ok = np.einsum("ij,ij->i", x[u], x[v]) / (size[u] * size[v]) >= cosine
            found_a.append(u[ok])
            found_b.append(v[ok])
    if not found_a:
        return node[:0], cnt[:0], node[:0]
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    links = np.bincount(a, cnt[b], len(node)) + np.bincount(b, cnt[a], len(node))
    root = _labels(len(node), a, b)
    some = np.flatnonzero(links > 0)
    return node[some], links[some].astype(np.int64), node[root[some]]


def _valid(vector: str):
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.isNotNull() & F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def index(nodes: DataFrame, rows: int, fit_rows: int = FIT_ROWS, probes: int = PROBES) -> tuple[DataFrame, Quantiser]:
    """Every node (node, cnt, v) with its lists, codes and error, and the quantiser, fitted to about ``fit_rows`` rows.

    There are about sqrt(rows) lists, at most one for each 20 rows of the sample.
    """
    draw = F.pmod(F.xxhash64(F.lit(3), "node"), F.lit(1 << 30)) / (1 << 30)
    sample = nodes.where(draw < min(1.0, fit_rows / rows)).select("node", "v").toPandas().sort_values("node")
    if not len(sample):
        sample = nodes.orderBy("node").limit(1).select("node", "v").toPandas()
    x = _scaled(np.array(sample["v"].tolist(), np.float64))
    x /= np.sqrt((x**2).sum(axis=1))[:, None]
    q = Quantiser(x, max(1, min(round(rows**0.5), len(x) // 20)), probes)

    def run(batches):
        import pandas as pd

        for b in batches:
            if not len(b):
                continue
            v = _scaled(np.array(b["v"].tolist(), np.float64))
            lists, codes, err = q.encode(v / np.sqrt((v**2).sum(axis=1))[:, None])
            yield pd.DataFrame({"node": b["node"], "cnt": b["cnt"], "v": b["v"], "lists": lists.astype(np.int32).tolist(), "code": [c.tobytes() for c in codes], "err": err})

    return nodes.mapInPandas(run, f"node long, cnt long, v {nodes.schema['v'].dataType.simpleString()}, lists array<int>, code binary, err double"), q


def link_nodes(coded: DataFrame, q: Quantiser, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """(node, links, root): partial link counts and spanning edges of the coded nodes."""
    spark = coded.sparkSession
    sent = coded.select("*", F.posexplode("lists").alias("probe", "at")).withColumn("home", F.col("probe") == 0)
    sizes = {r.at: (r.homes, r.visits) for r in sent.groupBy("at").agg(F.sum(F.col("home").cast("long")).alias("homes"), F.sum((~F.col("home")).cast("long")).alias("visits")).collect()}
    parts = spark.createDataFrame([(int(a), max(1, -(-h // block)), -(-v // block)) for a, (h, v) in sizes.items()], "at int, ns int, nv int")  # a row for each list
    salt = lambda n: F.pmod(F.xxhash64(F.lit(7), "node"), F.col(n)).cast("int")
    count = lambda n: F.filter(F.transform(F.sequence(F.lit(0), F.greatest(F.col(n), F.lit(1)) - 1), lambda i: i), lambda i: i < F.col(n))
    key = lambda ts, kind, qs, role: F.struct(ts.cast("int").alias("ts"), F.lit(kind).alias("kind"), qs.cast("int").alias("qs"), role.cast("int").alias("role"))
    own = F.col("salt")
    home = F.concat(
        F.transform(count("ns"), lambda i: key(F.least(i, own), "h", F.greatest(i, own), F.when(i == own, 2).when(i > own, 0).otherwise(1))),
        F.transform(count("nv"), lambda i: key(own, "v", i, F.lit(0))),
    )
    visit = F.transform(count("ns"), lambda i: key(i, "v", own, F.lit(1)))
    sent = sent.join(F.broadcast(parts), "at").withColumn("salt", F.when(F.col("home"), salt("ns")).otherwise(salt("nv")))
    cells = (
        sent.withColumn("cell", F.explode(F.when(F.col("home"), home).otherwise(visit)))
        .select("at", "cell.ts", "cell.kind", "cell.qs", F.struct("cell.role", "node", "cnt", "v", "lists", "code", "err").alias("m"))
        .groupBy("at", "ts", "kind", "qs")
        .agg(F.collect_list("m").alias("m"))  # about 2 * block at most
        .where(F.size("m") > 1)
        .select("at", "m.role", "m.node", "m.cnt", "m.v", "m.lists", "m.code", "m.err")
    )

    def run(batches):
        import pandas as pd

        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                x = _scaled(np.array(list(r.v), np.float64))
                codes = np.frombuffer(b"".join(r.code), np.uint8).reshape(len(x), -1)
                out.append(block_links(q, r.at, np.asarray(r.role), np.asarray(r.node, np.int64), np.asarray(r.cnt, np.float64), x, np.array(list(r.lists)), codes, np.asarray(r.err), cosine))
            if out:
                node, links, root = (np.concatenate(c) for c in zip(*out))
                yield pd.DataFrame({"node": node.astype(np.int64), "links": links.astype(np.int64), "root": root.astype(np.int64)})

    return cells.mapInPandas(run, "node long, links long, root long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """(id_col, n_links, component_id, kept), one row per input row; any labels are ignored.

    Vectors that are null, zero, or hold null or non-finite components link with nothing, nor do
    rows without an id (component null, not kept).  Vectors are compared with those of their own length, each length in an index of its own.
    Repeated rows count as rows of their own.  An empty table gives an empty result.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).withColumn("ok", _valid("v") & F.col("id").isNotNull())
    rows = rows.select("id", "v", "ok", F.when(F.col("ok"), F.xxhash64("v")).alias("h1"), F.when(F.col("ok"), F.xxhash64(F.lit(1), "v")).alias("h2"))
    alone = rows.where(~F.col("ok")).select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    same = rows.where("ok").groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("cnt"), F.min("id").alias("first"), F.any_value("v").alias("v"))
    nodes = materialize(same.withColumn("node", F.monotonically_increasing_id()), "pq-nodes")
    links = None
    for dim, n in sorted(nodes.groupBy(F.size("v").alias("d")).count().collect()):
        coded, q = index(nodes.where(F.size("v") == dim).select("node", "cnt", "v"), n)
        some = materialize(link_nodes(materialize(coded, "pq-index"), q, cosine), "pq-links")
        links = some if links is None else links.unionByName(some)
    if links is None:
        return alone
    roots = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    total = links.groupBy("node").agg(F.sum("links").alias("links"))
    placed = nodes.select("node", "h1", "h2", "cnt", "first").join(total, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    heads = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = placed.join(heads, "root").select("h1", "h2", (F.col("cnt") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    linked = rows.where("ok").join(classes, ["h1", "h2"]).select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
    return linked.unionByName(alone)
