import random
import zlib
from collections import Counter

import numpy as np

from gradloom.llm import langid


def brute_grams(text):
    out, words = Counter(), "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    joined = " " + " ".join(words) + " " if words else ""
    for n in (1, 2, 3):
        for i in range(len(joined) - n + 1):
            g = joined[i : i + n]
            if (n == 1 and g == " ") or (n == 3 and g[1] == " "):
                continue
            out[g] += 1
    return out


def key(g):
    k = 0
    for c in g:
        k = k << 21 | (1 if c == " " else ord(c) + 2)
    return k


def test_grams_and_distance_match_brute_force():
    texts = ["Hello, wörld  héllo!", "", None, "123 ...", "中文 x𝔘y", "a" * 3000, "the cat the dog the end"]
    for t in texts:
        keys, counts = langid.grams(t)
        assert dict(zip(keys.tolist(), counts.tolist())) == {key(g): n for g, n in brute_grams(t).items()}
    rank = lambda t: [key(g) for g, _ in sorted(brute_grams(t).items(), key=lambda x: (-x[1], key(x[0])))][:50]
    prof = {"aa": rank(texts[0]), "bb": rank(texts[6])}
    model = langid.Profiles(prof, 50)
    for t in ["the dog", "wörld", "zzz qqq"]:
        doc = rank(t)
        far = {lang: sum(abs(p.index(g) - i) if g in p else 50 for i, g in enumerate(doc)) for lang, p in prof.items()}
        best = min(sorted(far), key=far.get)
        assert model.predict(t) == (best, 1 - far[best] / (50 * len(doc)))
    assert model.predict(None) == model.predict("12 ?") == ("und", 0.0)


def corpus(n=240):
    r = random.Random(7)
    words = {"xx": ["the", "thing", "other", "with"], "yy": ["der", "und", "nicht", "schon"], "zz": ["que", "los", "para", "ción"]}
    return [(i, " ".join(r.choices(words[lang], k=r.randrange(1, 40))), lang) for i in range(n) for lang in [r.choice(sorted(words))]]


def test_folds_and_edges(spark):
    rows = corpus() + [(900, None, "xx"), (901, "", "yy"), (902, "12 34!", "zz"), (903, "und " * 40000, None), (None, "the thing", "xx"), (5, "los que", "zz")]
    docs = spark.createDataFrame([(i, t, lang, 1, 0.5) for i, t, lang in rows], "doc_id long, text string, lang string, lang_pred int, score double")
    got = langid.predict_folds(docs).collect()
    assert len(got) == len(rows)
    right = n = 0
    lang = {i: x for i, _, x in rows[:240]}
    for r in got:
        assert 0 <= r.score <= 1
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if r.held_out and r.doc_id in lang and r.doc_id != 5:
            n += 1
            right += r.lang_pred == lang[r.doc_id]
    assert right >= 0.95 * n > 20
    assert {r.lang_pred for r in got if r.doc_id in (900, 901, 902)} == {"und"}
    assert [r.lang_pred for r in got if r.doc_id == 903] == ["yy"]
    assert langid.predict_folds(docs.limit(0)).collect() == []
    none = langid.predict_folds(docs.withColumn("lang", docs.lang.substr(9, 1)).where("doc_id < 3").selectExpr("doc_id", "text", "cast(null as string) lang")).collect()
    assert {r.lang_pred for r in none} == {"und"}


def test_ties_go_by_key():
    keys, counts = np.array([5, 3, 9]), np.array([2, 2, 7])
    assert langid.ranked(keys, counts, 2).tolist() == [9, 3]
