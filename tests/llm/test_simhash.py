import random

import numpy as np
import pytest
import xxhash

from gradloom.llm import simhash
from gradloom.llm._common import components


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    out = 0
    for bit in range(64):
        ones = sum(xxhash.xxh64_intdigest(s, seed=42) >> bit & 1 for s in shingles)
        out |= (2 * ones > len(shingles)) << bit
    return out


def brute_groups(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    n, comp = len(rows), list(range(len(rows)))
    near = [0] * n

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(n):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                near[i] += 1
                near[j] += 1
                comp[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return sorted((d, f"{fps[i]:016x}", near[i], low[find(i)]) for i, (d, _) in enumerate(rows))


def texts(seed=5):
    r = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "deltaÉ", "eps", "zeta", "中文", "x"]
    base = [" ".join(r.choices(words, k=r.choice([1, 2, 5, 60, 400]))) for _ in range(30)]
    out = base + [b + " tail" for b in base] + [base[3]] * 4 + ["", None, " \t\n", "One", "two words", "a b c\x0bd\x1ce"]
    return [(i, t) for i, t in enumerate(out)]


def test_fingerprint_matches_definition():
    for _, t in texts():
        assert simhash.fingerprint(t) == brute_fingerprint(t)
    assert simhash.fingerprint("a " * 100_000) == brute_fingerprint("a a a")


@pytest.mark.parametrize("split", [1024, 2])
def test_groups_match_brute_force(spark, monkeypatch, split):
    monkeypatch.setattr(simhash, "SPLIT", split)
    rows = texts()
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, fp int, component_id int")
    got = sorted(tuple(r) for r in simhash.near_duplicates(docs).select("doc_id", "fingerprint", "n_near", "component_id").collect())
    assert got == brute_groups(rows)


@pytest.mark.parametrize("split", [1024, 3])
def test_links_of_close_fingerprints(spark, monkeypatch, split):
    monkeypatch.setattr(simhash, "SPLIT", split)
    r = random.Random(1)
    fps = set()
    for _ in range(12):
        x = r.getrandbits(64)
        for _ in range(25):
            y = x
            for _ in range(r.randint(0, 4)):
                y ^= 1 << r.randrange(64)
            fps.add(y)
    signed = np.array(sorted(fps), np.uint64).view(np.int64).tolist()
    got = {f: n for f, n in simhash.link_nodes(spark.createDataFrame([(f, 1) for f in signed], "fp long, cnt long")).groupBy("fp").sum("near").collect()}
    mask = (1 << 64) - 1
    want = {f: n for f in signed if (n := sum((f ^ g) & mask != 0 and ((f ^ g) & mask).bit_count() <= 2 for g in signed))}
    assert got == want


def test_bk_tree_finds_all():
    r = random.Random(3)
    keys = [r.getrandbits(12) for _ in range(300)]
    tree = simhash.BKTree()
    for i, k in enumerate(keys):
        tree.add(k, i)
    for q in keys[:50]:
        assert sorted(i for _, i in tree.within(q, 2)) == [i for i, k in enumerate(keys) if (k ^ q).bit_count() <= 2]


def test_empty_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).collect() == []
    some = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (4, "a b c d")], "doc_id long, text string")
    assert sorted((r.doc_id is None, r.n_near, r.component_id) for r in simhash.near_duplicates(some).collect()) == [(False, 2, 4), (False, 2, 4), (True, 2, 4)]
    assert sorted((r.doc_id or -1) for r in simhash.keep_one(some).collect()) == [4]


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(5, 5), (None, 3)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    up = {}

    def find(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            up[y] = x
    assert got == {i: find(i) for i in up if find(i) != i}


def test_keep_one_whatever_the_order(spark):
    """Repeated and null ids, in every order of the rows."""
    from itertools import permutations

    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(3, b, "x"), (5, a, "x"), (5, b, "x"), (None, c, "z"), (None, c, "y"), (7, None, "x"), (8, "", "x"), (3, b, "w")]
    want = {(3, b, "w"), (5, a, "x"), (None, c, "y"), (7, None, "x")}
    for some in list(permutations(rows))[::9000]:
        got = simhash.keep_one(spark.createDataFrame(some, "doc_id long, text string, fp string").repartition(2)).collect()
        assert {tuple(r) for r in got} == want and len(got) == 4
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    assert simhash.keep_one(docs.limit(0)).collect() == [] and simhash.keep_one(docs).columns == docs.columns
