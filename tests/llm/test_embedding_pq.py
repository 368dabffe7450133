import numpy as np
import pytest

from gradloom.llm import embedding_pq as E


def cloud(seed=0, n=700, dim=16, groups=25):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dim))
    for _ in range(groups):
        a = r.integers(n)
        for b in r.integers(0, n, 6):
            x[b] = x[a] * r.uniform(0.5, 2) + r.normal(size=dim) * r.choice([0.05, 0.15, 0.3])
    x[600:640] = x[5] * 3 + r.normal(size=(40, dim)) * 0.3  # a hot group
    x[650:655] = x[7]
    return x.astype(np.float32)


def brute(ids, x):
    x = x.astype(np.float64)
    size = np.sqrt((x**2).sum(axis=1))
    near = (x @ x.T) / np.outer(size, size) >= 0.9
    np.fill_diagonal(near, False)
    comp = np.array(ids)
    while True:
        low = np.array([min([comp[i], *comp[near[i]]]) for i in range(len(ids))])
        if (low == comp).all():
            break
        comp = low
    return {i: (int(n), int(c), bool(i == c)) for i, n, c in zip(ids, near.sum(axis=1), comp)}


@pytest.mark.parametrize("block", [2048, 16])
def test_recall_and_precision(spark, monkeypatch, block):
    monkeypatch.setattr(E.link_nodes, "__defaults__", (E.COSINE, block))
    x = cloud()
    ids = list(range(10, 710))
    df = spark.createDataFrame([(i, v.tolist(), 1, 5) for i, v in zip(ids, x)], "vec_id long, embedding array<float>, label int, cnt int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.near_duplicates(df).collect()}
    want = brute(ids, x)
    assert got.keys() == want.keys()
    assert all(got[i][0] <= want[i][0] for i in ids)
    assert sum(g[0] for g in got.values()) >= 0.97 * sum(w[0] for w in want.values())
    assert sum(got[i] == want[i] for i in ids) >= 0.97 * len(ids)


def test_all_probes_are_exact(spark):
    x = cloud(3)[400:]
    ids = list(range(300))
    nodes = spark.createDataFrame([(i, 1, v.tolist()) for i, v in zip(ids, x)], "node long, cnt long, v array<float>")
    coded, q = E.index(nodes, 300, 16, probes=1000)
    links = {r[0]: r[1] for r in E.link_nodes(coded, q, block=40).groupBy("node").sum("links").collect()}
    assert links == {i: n for i, (n, _, _) in brute(ids, x).items() if n}


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (9, [1.0, 2.0, 3.0]), (None, [1.0, 2.0]), (1, [1.0, 2.0]), (10, [-1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(((r.vec_id or -1), r.n_links, r.component_id, r.kept) for r in E.near_duplicates(df).collect())
    alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10)]
    assert got == sorted([(-1, 0, None, False), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), *alone])
    assert E.near_duplicates(df.limit(0)).collect() == []
    assert len(E.near_duplicates(df.where("vec_id in (3, 4)")).collect()) == 2


def test_lengths_and_extreme_sizes(spark):
    """Vectors of several lengths are all compared; squares that over- or underflow lose no link."""
    rows = [(1, [1.0, 0.0, 0.0]), (2, [1.0, 0.01, 0.0]), (3, [0.0, 1.0, 0.0]), (4, [1.0, 0.0]), (5, [1.0, 0.01]), (6, [1e200, 1e199]), (7, [1e-200, 1e-201]), (8, [5e-324, 0.0]), (9, [])]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    near = (4, 4, False)
    assert got == {1: (1, 1, True), 2: (1, 1, False), 3: (0, 3, True), 4: (4, 4, True), 5: near, 6: near, 7: near, 8: near, 9: (0, 9, True)}
