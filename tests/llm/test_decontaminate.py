import random

import pytest

from gradloom.llm import decontaminate as D

ITEM = "If Anna walks 12 km in 3 hours then how far does Anna walk in 7 hours at the same speed as before"


def words(r, n):
    return " ".join("".join(r.choices("abcdefgh", k=r.randint(3, 7))) for _ in range(n))


def brute(texts, items):
    """(doc, item) pairs of slot-free lower-case texts: share of 8-word windows found, or 13 words in a row."""
    out = set()
    for d, t in texts:
        w = t.split()
        mine = {tuple(w[i : i + 8]) for i in range(len(w) - 7)}
        long = {tuple(w[i : i + 13]) for i in range(len(w) - 12)}
        for i, x in items:
            v = x.split()
            wins = [tuple(v[k : k + 8]) for k in range(len(v) - 7)]
            if wins and (sum(k in mine for k in wins) >= 0.5 * len(wins) or any(tuple(v[k : k + 13]) in long for k in range(len(v) - 12))):
                out.add((d, i))
    return out


@pytest.mark.parametrize("part", [8_000_000, 300])
def test_passages_against_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(D, "PART_CHARS", part)
    r = random.Random(3)
    items = [(i, words(r, r.randint(8, 40))) for i in range(15)]
    texts = []
    for d in range(60):
        t = words(r, r.randint(5, 200))
        if d % 3 == 0:
            v = r.choice(items)[1].split()
            a = r.randrange(len(v))
            t += " " + " ".join(v[a : a + r.randint(4, 40)]) + " " + words(r, 5)
        texts.append((d, t))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.contaminated(docs, bench).collect()
    want = brute(texts, items)
    assert {(x.doc_id, x.item_id) for x in got} == want and len(got) == len(want) and all(x.exact for x in got)
    kept = {x.doc_id for x in D.clean(docs, bench).collect()}
    assert kept == {d for d, _ in texts} - {d for d, _ in want}


def test_slots():
    index = D.Index([(7, ITEM)])
    found = lambda t: [(i, e) for i, _, _, e in index.hits(t)]
    assert found("Well. " + ITEM + " indeed") == [(7, True)]
    assert found(ITEM.replace("Anna", "Bob").replace("12", "40").replace("3 hours", "9 days").replace("7 hours", "2 days")) == [(7, False)]
    assert found(ITEM.replace("Anna walk in", "Bob walk in")) == []  # one name, two values
    assert found(words(random.Random(1), 300)) == found("") == found(None) == []


def test_templates_of_slots_only_match_nothing():
    index = D.Index([(1, "x 1 2 3 4 5 6 7 8 9 10 11 12"), (2, "too short"), (3, "five words are just enough")])
    assert [h[0] for h in index.hits("Too short.")] == [2] and index.hits("too short and long") == []
    assert index.hits("y 1 2 3 4 5 6 7 8 9 10 11 12") == []
    assert [h[0] for h in index.hits("and five words are just enough here")] == [3]
    assert index.hits("and five words are simply enough here") == []


def test_edges(spark):
    r = random.Random(5)
    item = words(r, 20)
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (None, item), (3, "")], "item_id long, text string")
    docs = spark.createDataFrame([(1, item, 5), (1, item, 5), (2, None, 5), (3, "", 5), (None, item, 5), (4, "x " * 50000 + item, 5)], "doc_id long, text string, item_id int")
    assert sorted((x.doc_id or -1, x.item_id) for x in D.contaminated(docs, bench).collect()) == sorted([(1, 1)] * 4 + [(-1, 1)] * 2 + [(4, 1)] * 2)
    assert sorted(x.doc_id for x in D.clean(docs, bench).collect()) == [2, 3]
    assert D.contaminated(docs.limit(0), bench).collect() == [] == D.contaminated(docs, bench.limit(0)).collect()
    assert D.clean(docs, bench.limit(0)).count() == 6


def test_verbatim_copies_need_no_typing():
    sums = "12 7 19 4 23 8 31 5 36 9 45 2"
    index = D.Index([(1, sums), (2, "Which river crosses the northern plain"), (3, "x 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15")])
    found = lambda t: [(i, e) for i, _, _, e in index.hits(t)]
    assert found("so " + sums + " is the row") == [(1, True)]
    assert found("so " + sums.replace("19", "20") + " is the row") == []
    assert found("y 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15") == [(3, True)]
    assert found("y 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16") == [(3, True)]
    assert found("y 21 22 23 24 25 26 27 28 29 30 31 32 33 34 35") == []
    assert found("Question: Which river crosses the northern plain") == [(2, True)]
    assert found("question which river crosses the southern plain") == []


def brute_slots(text, item):
    """Whether a text that is one sentence long asks an item again with other values, by aligning all of both."""
    import re

    def parse(x):
        out = []
        for i, w in enumerate(re.findall(r"[A-Za-z]+|\d+", x)):
            kind = "number" if w.isdigit() or w.lower() in D.NUMBER_WORDS else "name" if i and w[0].isupper() else None
            if kind and out and out[-1][0] == kind:
                out[-1][1] += " " + w.lower()
            else:
                out.append([kind, w.lower()])
        return out

    a, b = parse(item), parse(text)
    if len(a) != len(b) or any(x[0] != y[0] or x[0] is None and x[1] != y[1] for x, y in zip(a, b)):
        return False
    pairs = {(x[1], y[1]) for x, y in zip(a, b) if x[0]}
    return len(pairs) == len({x for x, _ in pairs}) == len({y for _, y in pairs})


def test_asked_again_with_other_values_against_brute_force():
    r = random.Random(8)
    names, numbers = ["Ann", "Bob", "Mary Ann Smith", "John Paul", "Eve"], ["12", "3", "forty two", "seven", "one hundred"]
    form = "when {a} gives {x} apples to {b} and keeps {y} pears then how many of the apples does {b} still owe to {a} after {x} days"
    fill = lambda: {"a": r.choice(names), "b": r.choice(names), "x": r.choice(numbers), "y": r.choice(numbers)}
    for _ in range(200):
        v = fill()
        item = form.format(**v)
        text = form.format(**fill())
        if r.random() < 0.4:  # the second mention has a value of its own
            head, _, tail = text.rpartition(" owe to ")
            text = f"{head} owe to {r.choice(names)} {tail.split(' ', 1)[1] if tail.startswith(('Ann', 'Bob', 'Eve')) else 'after ' + tail.split(' after ')[1]}"
        hits = D.Index([(1, item)]).hits(text)
        if brute_slots(text, item):
            assert [h[0] for h in hits] == [1], (item, text)
            assert hits[0][3] == (text == item)
    assert sum(brute_slots(form.format(**fill()), form.format(**fill())) for _ in range(50)) > 10


def test_repetitive_texts():
    words = "same " * 400
    assert [h[0] for h in D.Index([(1, words)]).hits(words + "end")] == [1]
