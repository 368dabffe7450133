import random
import zlib

import numpy as np

from gradloom.llm import toxicity as X


def corpus(n=900, seed=3):
    r = random.Random(seed)
    vocab = ["".join(r.choices("abcdefghij", k=r.randint(2, 8))) for _ in range(400)]
    rows = []
    for i in range(n):
        toxic = r.random() < 0.2
        w = r.choices(vocab, k=r.randint(30, 300))
        for _ in range(max(2, len(w) // 15) if toxic else int(r.random() < 0.1)):
            w.insert(r.randrange(len(w)), r.choice(["Idiot", "scum,", "moron", "trash!"]))
        rows.append((i, " ".join(w), int(toxic)))
    return rows


def test_windows_compare_dictionaries():
    d = X.Distance(["idiot", "scum"], ["lamp", "rope"], ["the", "of", "and"])
    assert d.windows("the quick idiot of scum")[0] > 0 > d.windows("the lamp and rope")[0]
    assert d.windows("idiotic scumbag words") == [0]
    assert d.windows(None) == d.windows("") == [] and d.gain(None) == 0
    assert len(d.windows("w " * 100)) == 7


def test_isotonic():
    x, y = np.array([0, 1, 1, 2, 3, 4.0]), np.array([0, 1, 0, 0, 1, 1.0])
    k, v = X.isotonic(x, y, np.ones(6))
    assert (np.diff(v) >= -1e-9).all() and k[0] == 0 and len(k) == 3 or len(k) == 4


def test_folds(spark):
    rows = corpus()
    extra = [(5000, None, None), (5001, "", None), (None, "idiot scum", None), (5002, "idiot scum moron trash " * 20000, None), (5001, "", None)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t, _ in rows + extra], "doc_id long, text string, y int, made string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (7, None), (8, rows[8][2]), (77777, 1)], "doc_id long, toxic int")
    got = X.score_folds(docs, labels).collect()
    assert len(got) == len(rows) + len(extra)
    held = [(x.predicted, rows[x.doc_id][2]) for x in got if x.held_out and x.doc_id < 900]
    assert all((zlib.crc32(str(x.doc_id).encode()) % 3 == 1) == x.held_out for x in got if x.doc_id is not None)
    hit = sum(p and y for p, y in held)
    assert hit >= 0.85 * sum(y for _, y in held) > 20 and sum(p and not y for p, y in held) <= 0.03 * len(held)
    assert all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.7) for x in got)
    assert [x.predicted for x in got if x.doc_id == 5002] == [1] and {x.predicted for x in got if x.doc_id in (5000, 5001)} == {0}
    assert X.score_folds(docs.limit(0), labels).collect() == []
    assert {x.score for x in X.score_folds(docs.limit(3), labels.limit(0)).collect()} == {0.5}


def test_inflected_forms_match_by_stem(spark):
    d = X.Distance(["idiot", "achli*"], ["lamp", "rope"], ["the", "of", "and"])
    assert d.unit("achlichkeit") == "achli*" and d.unit("idiot") == "idiot" and d.unit("achl") == "achl"
    assert d.windows("ein achlichkeit und achlichung")[0] > 0
    r = random.Random(5)
    rows = corpus(600, 9)
    end = lambda: "".join(r.choices("klmnopqrst", k=5))
    rows = [(i, " ".join("bomen" + end() if x.strip(",!").lower() in ("idiot", "scum", "moron", "trash") else x for x in t.split()), y) for i, t, y in rows]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    held = [(x.predicted, rows[x.doc_id][2]) for x in X.score_folds(docs, labels).collect() if x.held_out]
    assert sum(p and y for p, y in held) >= 0.8 * sum(y for _, y in held) > 10 and sum(p and not y for p, y in held) <= 0.05 * len(held)
