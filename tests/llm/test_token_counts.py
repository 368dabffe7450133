import os
import random
import struct

import numpy as np
import pytest

from gradloom.llm import token_counts as T
from gradloom.llm._common import new_path

PATH = os.environ.get("GRADLOOM_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.tiktoken"


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
def test_scan_matches_brute_force(spark, block):
    r = random.Random(block)
    folder = new_path(spark, "flat")
    at = folder.removeprefix("file:")
    os.makedirs(at)
    want, files = {}, []
    for k in range(6):
        ids = [r.choice([9, 1, 2, 3, 4]) for _ in range(r.choice([0, 1, 20, 101]))] if k else [9, 9, 1, 9]
        with open(f"{at}/f{k}.bin", "wb") as f:
            f.write(b"".join(struct.pack("<H", i) for i in ids))
        files.append((f"f{k}", 2 * len(ids)))
        n, o = 0, 0
        for i in ids:
            if i == 9:
                want[f"f{k}", o] = n
                n, o = 0, o + 1
            else:
                n += 1
        if n:
            want[f"f{k}", o] = n
    got = T.scan(spark, folder, spark.createDataFrame(files, "file string, n_bytes long"), end=9, block=block).collect()
    assert {(x.file, x.ordinal): x.n_tokens for x in got} == want and len(got) == len(want)


def test_scan_block():
    assert [x if isinstance(x, int) else x.tolist() for x in T.scan_block(np.array([5, 9, 6, 6, 9, 9, 7]), 9)] == [1, 3, 1, [2, 0]]
    assert T.scan_block(np.array([5, 5]), 9)[:3] == (2, 0, 2)


@pytest.mark.skipif(not os.path.exists(PATH), reason="no ranks")
def test_counts(spark):
    rows = [(1, "Hello there <|endoftext|>"), (2, None), (3, ""), (None, "x"), (1, "Hello there <|endoftext|>"), (4, "long text " * 30000), (5, "中文\n\n")]
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, ordinal int")
    enc = T.encoder(PATH)
    got = sorted((x.doc_id or 0, x.n_tokens) for x in T.count_tokens(docs, PATH).collect())
    assert got == sorted((i or 0, len(enc.encode_ordinary(t or ""))) for i, t in rows)
    assert T.count_tokens(docs.limit(0), PATH).collect() == []


def test_long_white_space():
    from gradloom.llm.queries import RANKS

    r = __import__("random").Random(2)
    for _ in range(300):
        text = "".join(r.choice(["a", "b1", ".", "\u00e9", *[c * r.randrange(1, 12) for c in " \n\t\u00a0\u2003"], " \n ", "\x1c"]) for _ in range(r.randrange(12)))
        assert T.encode(text, RANKS, 2) == T.encoder(RANKS).encode_ordinary(text), repr(text)
    assert len(T.encode(" " * 1_000_000 + "x", RANKS)) > 10_000
    assert T.encode(None, RANKS) == T.encode("", RANKS) == []
