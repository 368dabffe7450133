import os
import random

import pytest

from gradloom.llm import sentencepiece as S

PATH = os.environ.get("GRADLOOM_TOKENIZERS", "/opt/tokenizers") + "/piece_bpe_32k.model"
needs_model = pytest.mark.skipif(not os.path.exists(PATH), reason="no model file")


def samples(n=800):
    r = random.Random(4)
    alphabet = ["a", "b", "the", "ing", " ", "  ", "\n", "\t", "▁", "☃", "é", "中文", ".", ",", "'", "12", "​", "𝔘", "tion", "</s>", "<0x41>", "aaaaaaa"]
    out = ["", " ", "a", "Hello  world\n x ☃ 12", "x" * 5000, "ab" * 20000, " the" * 9000]
    return out + ["".join(r.choices(alphabet, k=r.randrange(1, 40))) for _ in range(n)]


@needs_model
def test_same_ids_and_text_as_the_library():
    import sentencepiece

    ref = sentencepiece.SentencePieceProcessor(model_file=PATH)
    ours = S.compiled(PATH)
    for text in samples():
        ids = ours.encode(text)
        assert ids == ref.encode(text), text[:80]
        assert ours.decode(ids) == ref.decode(ids)


@needs_model
def test_pairs_against_merging():
    ours = S.compiled(PATH)
    r = random.Random(9)
    pieces = [p for p in ours.ids if len(p) < 7]
    stems = [p for p in pieces if p[0] in "taeoins▁"]
    for _ in range(20000):
        a, b = r.choice(pieces), r.choice(stems)
        if S.MARK in b:
            continue
        if all(len(p) == 1 or ours._halves(p) for p in (a, b)):
            assert ours._pair_ok(a, b) == (ours._merge(a + b) == [a, b]), (a, b)


@needs_model
def test_table(spark):
    rows = [(1, "Hello there"), (2, None), (3, ""), (None, "x\ny"), (5, "a▁b"), (5, "a▁b"), (4, "long " * 60000)]
    docs = spark.createDataFrame([(i, t, 0, [1]) for i, t in rows], "doc_id long, text string, n_tokens int, ids array<int>")
    got = S.encode_table(docs, PATH)
    assert got.columns == ["doc_id", "n_tokens", "ids", "round_trip"]
    back = S.decode_table(got, PATH).collect()
    assert len(back) == 7
    for r in back:
        assert r.n_tokens == len(r.ids)
        want = dict((i, t) for i, t in rows)[r.doc_id] or ""
        assert (r.text == want) == r.round_trip
        assert r.round_trip == ("▁" not in want)
    assert S.encode_table(docs.limit(0), PATH).collect() == []


def _message(fields):
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    out = b""
    for k, v in fields:
        if isinstance(v, int):
            out += varint(k << 3) + varint(v)
        elif isinstance(v, float):
            import struct

            out += varint(k << 3 | 5) + struct.pack("<f", v)
        else:
            out += varint(k << 3 | 2) + varint(len(v)) + v
    return out


def test_unigram_shortest_path():
    pieces = [("<unk>", 0.0, 2), ("▁", -2.0, 1), ("a", -3.0, 1), ("b", -3.5, 1), ("ab", -4.0, 1), ("▁a", -3.2, 1), ("ba", -5.0, 1), ("bab", -4.1, 1)]
    data = b"".join(_message([(1, _message([(1, p.encode()), (2, s), (3, k)]))]) for p, s, k in pieces)
    data += _message([(2, _message([(3, 1)])), (3, _message([(3, 1), (4, 1)]))])
    t = S.Transducer(data)
    scores = {p: s for p, s, _ in pieces[1:]}

    def best(text):
        if not text:
            return 0.0, []
        return max(((scores[p] + best(text[len(p) :])[0], [p] + best(text[len(p) :])[1]) for p in scores if text.startswith(p)), key=lambda x: x[0])

    for text in ["ab", "abab", "babab", "bb a", "aabba ab"]:
        assert [t.pieces[i] for i in t.encode(text)] == best("▁" + text.replace(" ", "▁"))[1]
    assert t.encode("  a   b ") == t.encode("a b")
    assert [t.pieces[i] for i in t.encode("aXYb")] == ["▁a", "<unk>", "b"]


def test_rewrite_rules():
    n = S.Normaliser({"ﬁ": "fi", "Ａ": "A", "ＡＢ": "x"}, True, False, True)
    assert n("ﬁ ＡＢＡ") == "▁fi▁xA"
