import random
import zlib

import numpy as np

from gradloom.llm import quality


def test_model_learns_single_and_pair_effects():
    r = np.random.default_rng(1)
    x = r.normal(size=(3000, 4)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    m = quality.fit_model(x[:2000], y[:2000], rounds=30, pair_rounds=60, n_pairs=2)
    assert (0, 1) in m.pairs
    assert (((m.score(x[2000:]) > 0.5) == y[2000:]).mean()) > 0.9
    z = np.full(len(x), m.intercept)
    for i in range(200):  # scores are sums of table entries, looked up one by one
        v = m.intercept + sum(t[int((c <= x[i, f]).sum())] for f, (c, t) in enumerate(zip(m.cuts, m.tables)))
        v += sum(t[int((m.pair_cuts[a] <= x[i, a]).sum()), int((m.pair_cuts[b] <= x[i, b]).sum())] for (a, b), t in m.pairs.items())
        z[i] = 1 / (1 + np.exp(-v))
    assert np.allclose(z[:200], m.score(x[:200]))


def test_degenerate_fits():
    x = np.zeros((0, len(quality.FEATURES)), np.float32)
    assert quality.fit_model(x, np.zeros(0)).score(np.ones((2, len(quality.FEATURES)), np.float32)).tolist() == [0.5, 0.5]
    one = quality.fit_model(np.ones((3, len(quality.FEATURES)), np.float32), np.ones(3))
    assert one.score(np.ones((1, len(quality.FEATURES)), np.float32))[0] > 0.8


def test_features_of_odd_texts():
    for t in (None, "", " \n\t"):
        assert not quality.features(t).any()
    f = dict(zip(quality.FEATURES, quality.features("AA bb bb bb\nx | y\nx | y").tolist()))
    assert f["adjacent_repeats"] == np.float32(2 / 10) and f["pipes"] == np.float32(0.2) and f["repeated_lines"] == np.float32(1 / 3)
    assert np.isfinite(quality.features("é" * 200_000 + " 𝔘")).all()


def test_folds(spark):
    r = random.Random(2)
    rows = []
    for i in range(400):
        good = r.random() < 0.7
        words = ["alpha", "beta", "gamma.", "Delta", "eps"] if good else ["BUY!!", "$$$", "NOW%%%"]
        rows.append((i, " ".join(r.choices(words, k=r.randrange(3, 60))), int(good)))
    docs = spark.createDataFrame([(i, t, 3.5) for i, t, _ in rows] + [(900, None, 1.0), (901, "", 1.0), (None, "alpha beta", 1.0), (901, "", 1.0)], "doc_id long, text string, x double")
    labels = spark.createDataFrame([(i, q, 9) for i, _, q in rows] + [(None, 1, 0), (3, None, 0), (5000, 0, 0), (7, rows[7][2], 1)], "doc_id long, quality int, id int")
    got = quality.score_folds(docs, labels).collect()
    assert len(got) == 404
    held = [(x, rows[x.doc_id][2]) for x in got if x.held_out and x.doc_id < 400]
    assert all((zlib.crc32(str(x.doc_id).encode()) % 5 == 0) == x.held_out for x in got if x.doc_id is not None)
    assert sum(x.predicted == q for x, q in held) >= 0.95 * len(held) > 40
    assert all(x.predicted == (x.score >= 0.3) and 0 <= x.score <= 1 for x in got)
    assert quality.score_folds(docs.limit(0), labels).collect() == []
    assert {x.score for x in quality.score_folds(docs.limit(3), labels.limit(0)).collect()} == {0.5}
