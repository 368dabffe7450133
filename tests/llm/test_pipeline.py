import random

import pytest

import corpus_pipeline
from gradloom.llm import decontaminate, langid, quality, sentencepiece, simhash
from gradloom.llm.queries import PIECES

from .test_sentencepiece import needs_model
from .test_simhash import brute_groups

LANGS = {"en": ["the", "thing", "other", "with", "weather"], "de": ["der", "und", "nicht", "schon", "straße"]}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("pipeline"))
    r = random.Random(11)
    items = [(i, " ".join("".join(r.choices("etaoinsh", k=r.randint(3, 8))) for _ in range(20))) for i in range(5)]
    docs, labels = [], []
    for i in range(300):
        good, lang = r.random() < 0.8, r.choice(sorted(LANGS))
        words = [w + r.choice("abcdefgh") * (r.random() < 0.5) for w in r.choices(LANGS[lang], k=r.randint(30, 80))]
        text = " ".join(words) + "." if good else " ".join(w.upper() + "!!" for w in words)
        if i % 20 == 3:
            text = docs[i - 3][1]
        if i % 25 == 7:
            text += " " + items[i % 5][1]
        docs.append((i, text, lang, "src", len(text)))
        labels.append((i, int("!!" not in text), 0))
    docs += [(400, None, None, None, None), (401, "", "en", "src", 0), (402, "12 34. 56 78. 90.", "en", "src", 5), (0, docs[0][1], "en", "src", 3)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


@needs_model
def test_stages_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = sorted((tuple(x) for x in docs.collect()), key=str)

    def kept(k, before):
        df = corpus_pipeline.STAGES[k][1](spark, spark.createDataFrame(before, docs.schema), folder)
        assert df.columns == docs.columns
        return sorted((tuple(x) for x in df.collect()), key=str)

    model = quality.fit(docs, labels)
    want = [x for x in rows if model.score(quality.features(x[1])[None])[0] >= 0.3]
    first = kept(0, rows)
    assert first == want and 200 < len(first) < len(rows)
    assert not [x for x in first if x[1] and "!!" in x[1]] and sum("!!" not in (x[1] or "!!") for x in rows) - len(first) < 6

    profiles = langid.fit(langid.training_rows(spark.createDataFrame(first, docs.schema)))
    second = kept(1, first)
    want = [x for x in first if (p := profiles.predict(x[1]))[0] != "und" and p[1] >= corpus_pipeline.LEAST_LANGUAGE_SCORE]
    assert second == want and {x[2] for x in second if x[0] < 300} == {"en", "de"} and not [x for x in second if x[0] in (400, 401, 402)]

    third = kept(2, second)
    groups = {d: c for d, _, _, c in brute_groups([x[:2] for x in second])}
    assert sorted(x[0] for x in third) == sorted(set(groups.values())) and len(third) < len(second)

    fourth = kept(3, third)
    items = [tuple(x) for x in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert fourth == [x for x in third if not any(t in x[1] for _, t in items)] and len(fourth) < len(third)

    import sentencepiece as library

    ref = library.SentencePieceProcessor(model_file=PIECES)
    last = corpus_pipeline.STAGES[4][1](spark, spark.createDataFrame(fourth, docs.schema), folder).collect()
    assert {x.doc_id: x.ids for x in last} == {x[0]: ref.encode(x[1]) for x in fourth} and all(x.round_trip for x in last)
    whole = corpus_pipeline.run(spark, folder).collect()
    assert {x.doc_id: x.ids for x in whole} == {x.doc_id: x.ids for x in last}


def test_modules_are_the_ones_named():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_duplicates", "decontamination", "sentencepiece"]
    assert decontaminate.Index and sentencepiece.Transducer and simhash.BKTree
