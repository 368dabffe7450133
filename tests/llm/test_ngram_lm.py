import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from gradloom.llm import ngram_lm as N

def corpus(seed=1):
    r = random.Random(seed)
    vocab = ["the", "of", "And", "É", "x1", *("w%d" % i for i in range(60))]
    passage = r.choices(vocab, k=150)
    rows = []
    for i in range(120):
        w = r.choices(vocab, weights=[30, 20, 10, 5, 5] + [1] * 60, k=r.choice([0, 1, 3, 30, 60]))
        if i % 6 == 0:
            a = r.randrange(100)
            w = w[:9] + passage[a : a + r.choice([5, 40, 150])] + w[9:]
        rows.append((i, " ".join(w)))
    rows += [(200, None), (201, ""), (5, rows[5][1]), (5, rows[5][1]), (202, " THE  of\tand\x0bx1 ")]
    rows += [(300 + i, "a " * 200) for i in range(3)]
    return rows


def held(i):
    return zlib.crc32(str(i).encode()) % 7 == 2


def brute(rows, hot=()):
    docs = [(i, (t or "").encode().lower().split() + [None]) for i, t in rows]
    train = [w for i, w in docs if not held(i)]
    c = Counter(x for w in train for x in w)
    total, known = sum(c.values()), len(c)
    grams = Counter(tuple(w[j:k]) for w in train for j in range(len(w)) for k in range(j + 1, len(w) + 1) if k - j < 260)

    def found(w, j):
        """Length, continuation's count and count of the longest context before token j that occurs."""
        for n in range(min(j, 258), 0, -1):
            if den := grams[tuple(w[j - n : j])]:
                return n, grams[tuple(w[j - n : j + 1])], den
        return 0, 0, 0

    sums = np.zeros((N.LENGTHS, N.COUNTS, 2))
    for w in train:
        for j in range(len(w) - 1):
            for n in range(1, 4):
                if j + n < len(w) and tuple(w[j : j + 2]) not in hot and (den := grams[tuple(w[j : j + n])] - 1):
                    sums[n - 1, min(int(math.log2(den)), N.COUNTS - 1)] += (grams[tuple(w[j : j + n + 1])] > 1, 1)
    trust = (sums[..., 0] + 0.5) / (sums[..., 1] + 1)
    out = []
    for i, w in docs:
        lo = hi = 0.0
        for j in range(len(w)):
            p = (c[w[j]] + 1) / (total + known + 1)
            r, num, den = found(w, j)
            t = trust[min(r, N.LENGTHS) - 1, min(int(math.log2(den)), N.COUNTS - 1)] if den else 0.0
            lo += math.log10(p)
            hi += math.log10(t * num / max(den, 1) + (1 - t) * p)
        out.append((i, held(i), len(w), sum(c[x] > 0 for x in w), total, lo, hi))
    return sorted(out)


def key_of(*words):
    return int(block_of([N.xxhash.xxh64_intdigest(w) for w in words]).spans(np.zeros(1, np.int64), len(words))[0])


def block_of(keys, *lengths):
    b = N.Block.__new__(N.Block)
    b.h = np.array(keys, np.uint64)
    b.end = np.repeat(np.cumsum(lengths or [len(keys)]), lengths or [len(keys)])
    return b


@pytest.mark.parametrize("split", [False, True])
def test_against_brute_force(spark, monkeypatch, split):
    rows = corpus()
    hot = {(b"the", b"the"): 3, (b"a", b"a"): 2, (b"the", b"of"): 4} if split else {}
    docs = spark.createDataFrame([(i, t, True, 3) for i, t in rows], "doc_id long, text string, held boolean, block int")
    if split:
        monkeypatch.setattr(N, "SHARD", 100)
        monkeypatch.setattr(N, "SHARD_BYTES", 256)
        monkeypatch.setattr(N, "hot_keys", lambda blocks, folder: {key_of(*k): n for k, n in hot.items()})
        docs = docs.repartition(12)
    got = sorted(tuple(x) for x in N.score_folds(docs).collect())
    want = brute(rows, hot)
    assert [x[:5] for x in got] == [x[:5] for x in want]
    assert [(a, b) for a, b in zip(got, want) if not np.allclose(a[5:], b[5:], rtol=1e-9)] == []
    scores = [(x[6] - x[5]) / x[2] for x in got if x[1]]
    assert np.mean(scores) > 0


def test_split_keys_change_no_result(spark, monkeypatch):
    """Keys split over shards count in the trust sums like all others."""
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    hot = {(b"the", b"the"): 3, (b"a", b"a"): 2, (b"the", b"of"): 4, (b"of", b"x1"): 2}
    monkeypatch.setattr(N, "SHARD", 100)
    monkeypatch.setattr(N, "SHARD_BYTES", 256)
    monkeypatch.setattr(N, "hot_keys", lambda blocks, folder: {key_of(*k): n for k, n in hot.items()})
    got, want = sorted(tuple(x) for x in N.score_folds(docs).collect()), brute(rows)
    assert [x[:5] for x in got] == [x[:5] for x in want]
    assert [(a, b) for a, b in zip(got, want) if not np.allclose(a[5:], b[5:], rtol=1e-9)] == []


def test_matches_of_every_length(spark):
    """Held-out texts that leave a training passage after 1 to 100 tokens, each prefix of which occurs in several texts."""
    r = random.Random(4)
    passage = ["p%d" % r.randrange(40) for _ in range(110)]
    train = [i for i in range(900) if not held(i)]
    other = [i for i in range(900) if held(i)]
    rows = [(train[k], " ".join([*(["u%d" % k] * (k % 3)), *passage[: 2 * k + 8], "v%d" % k])) for k in range(50)]
    rows += [(other[n], " ".join([*passage[:n], "zz", "u1"])) for n in range(1, 101)]
    got = sorted(tuple(x) for x in N.score_folds(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = brute(rows)
    assert [(a, b) for a, b in zip(got, want) if not np.allclose(a[5:], b[5:], rtol=1e-9)] == []


def test_hot_keys(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(N, "SHARD", 1000)
    whole = N.hot_keys
    monkeypatch.setattr(N, "hot_keys", lambda blocks, folder: seen.setdefault("hot", whole(blocks, folder)))
    train = [i for i in range(900) if not held(i)]
    docs = spark.createDataFrame([(i, "x " * 400) for i in train[:100]], "doc_id long, text string")
    assert N.score_folds(docs).count() == 100
    assert list(seen["hot"]) == [key_of(b"x", b"x")] and 60 < seen["hot"][key_of(b"x", b"x")] < 100


def test_long_repetition(spark):
    """One word thousands of times, in training and held-out texts."""
    train, other = (next(i for i in range(50) if held(i) is x) for x in (False, True))
    rows = [(train, "a " * 6000), (other, "a " * 5000 + "b")]
    got = sorted(tuple(x) for x in N.score_folds(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert [x[2] for x in got] == [n for _, n in sorted([(train, 6001), (other, 5002)])] and all(-50 < x[6] < 0 for x in got)


def test_edges(spark):
    docs = spark.createDataFrame([(None, "a b"), (2, None)], "doc_id long, text string")
    assert N.score_folds(docs.limit(0)).collect() == []
    got = N.score_folds(docs).collect()
    assert sorted((x.doc_id or 0, x.n_tokens, x.held_out) for x in got) == sorted([(0, 3, False), (2, 1, held(2))])
    only = next(i for i in range(99) if held(i))
    got = N.score_folds(spark.createDataFrame([(only, "a b")], "doc_id long, text string")).collect()
    assert [(x.train_tokens, x.n_known, x.base_score, x.score) for x in got] == [(0, 0, 0.0, 0.0)]


def test_keys_stand_for_grams():
    h = [N.xxhash.xxh64_intdigest(str(i % 3)) for i in range(400)]
    b = block_of(h, 200, 200)
    for n in (1, 2, 4, 16, 64):
        k = b.spans(np.r_[0 : 201 - n, 200 : 401 - n], n)
        assert len(np.unique(k)) == 3 and k[0] == k[3] == k[len(k) // 2 + 1]
    ends = b.spans(np.arange(150, 200), 64)  # what is left of a document
    assert len(np.unique(ends)) == 50 and (ends[-2:] == [key_of("0", "1"), key_of("1")]).all()


def test_deep_suffixes_share_their_text(tmp_path):
    """Overlapping suffixes of a deep level travel as one stretch of text: bytes in proportion to the tokens, not to tokens times width."""
    r = random.Random(7)
    b = block_of([r.getrandbits(64) for _ in range(3000)], 1800, 1200)
    b.folder, b.name = f"file://{tmp_path}", "0-0"
    b.number = np.array([r.randrange(1, 1 << 20) for _ in range(3000)])
    depth, width = N.level(3)
    at = np.flatnonzero(b.left(np.arange(3000)) > depth)
    rows = N.send(b, 3, at, at[::7], lambda k: np.ones(len(k), np.int64), 1)
    assert sum(len(d) for *_, d in rows) < 30 * 3000


def test_stretches():
    r = random.Random(9)
    for _ in range(30):
        text = np.array([r.randrange(1, 9) for _ in range(60)], np.uint32)
        begin = np.array([r.randrange(55) for _ in range(r.randrange(12))], np.int64)
        end = np.minimum(begin + 7, 20 * (begin // 20 + 1))
        where, place = N.stretches(begin, end)
        laid = N._laid(text[where], place, end - begin, 7)
        assert [list(x) for x in laid] == [[*text[a:e], *[0] * (7 - e + a)] for a, e in zip(begin, end)]
        assert len(where) == len(set(where))


@pytest.mark.parametrize("top", [9, 1 << 31, 1 << 40])
def test_words_are_packed_without_loss(top):
    r = random.Random(3)
    for n in (0, 1, 50):
        words = np.array(sorted([r.randrange(1, top) for _ in range(4)] for _ in range(n)), np.int64).reshape(n, 4)
        assert (N.unpack_words(*(N._unpack(N._pack(x)) for x in N.pack_words(words))) == words).all()


def test_requests_follow_the_keys(spark, monkeypatch):
    """A large corpus of few words is asked about in few rows, not in blocks times the shards of its suffixes."""
    r = random.Random(5)
    rows, whole = [], N.count_words
    monkeypatch.setattr(N, "SHARD", 200)
    monkeypatch.setattr(N, "count_words", lambda requests, shards: rows.append(requests.groupBy("block").count().collect()) or whole(requests, shards))
    docs = spark.createDataFrame([(i, " ".join(r.choices(["w%d" % k for k in range(60)], k=500))) for i in range(40)], "doc_id long, text string").repartition(4)
    assert N.score_folds(docs).count() == 40
    assert len(rows[0]) == 4 and max(x["count"] for x in rows[0]) <= 8


def test_near_positions_share_their_anchor():
    """Equal tokens have equal anchors, and a text's suffixes go to few shards, each with stretches of it."""
    r = random.Random(11)
    text = [r.getrandbits(64) for _ in range(2000)]
    b = block_of([1, 2, 3, *text, *text, 5], 2003, 2001)
    b.n, b.ends = np.array([2003, 2001]), np.array([2003, 4004])
    b.starts = b.ends - b.n
    at = np.arange(2000 - 64)
    one, two = b.anchors(at + 3, 64), b.anchors(at + 2003, 64)
    assert (one == two).all() and (b.anchors(at[5:9] + 3, 64) == one[5:9]).all()
    assert 20 < len(np.unique(one)) < len(one) / 10
    least = [min(b.spans(np.arange(k + 3, k + 52), 16)) for k in range(50)]
    assert (N._mix(np.array(least, np.uint64), np.zeros(1, np.uint64)) == one[:50]).all()
