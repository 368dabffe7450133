"""Language identification by rank-order n-gram profiles.

A language's profile is the ranking of its most frequent letter n-grams; a
document's most frequent n-grams are compared to each profile by the
out-of-place distance, the sum of rank differences, a missing n-gram counting
as far as a rank can be.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import fold_of

#: Ranks in a profile; training documents of one language that it is learned from, about.
RANKS, FIT_ROWS = 400, 4000
UND = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of the letter 1- to 3-grams of words padded with one blank; 21 bits a character."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le"), np.uint32).astype(np.int64)
    codes = np.where(_letters()[codes], codes + 2, 1)
    codes = np.concatenate(([1], codes, [1]))
    codes = codes[np.concatenate(([True], (codes[1:] != 1) | (codes[:-1] != 1)))]
    a, b, c = codes[:-2], codes[1:-1], codes[2:]
    inner = b != 1
    if not inner.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    two = codes[:-1] << 21 | codes[1:]
    return np.unique(np.concatenate((b[inner], two, (a << 42 | b << 21 | c)[inner])), return_counts=True)


def ranked(keys: np.ndarray, counts: np.ndarray, ranks: int) -> np.ndarray:
    """The most frequent keys, equal counts by key."""
    return keys[np.lexsort((keys, -counts))[:ranks]]


class Profiles:
    """Rank tables of all languages over the n-grams that any profile holds."""

    def __init__(self, profiles: dict[str, list[int]], ranks: int = RANKS):
        self.langs, self.ranks = sorted(profiles), ranks
        self.keys = np.array(sorted({k for p in profiles.values() for k in p}), np.int64)
        self.rank = np.full((len(self.keys) + 1, len(self.langs)), ranks, np.int64)
        for j, lang in enumerate(self.langs):
            for r, k in enumerate(profiles[lang]):
                self.rank[np.searchsorted(self.keys, k), j] = r

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score): und and 0 for a text without a letter; equal distances go to the first name."""
        top = ranked(*grams(text), self.ranks)
        if not len(top) or not self.langs:
            return UND, 0.0
        at = np.searchsorted(self.keys, top)
        at[at >= len(self.keys)] = 0
        at = np.where(self.keys[at] == top, at, len(self.keys))
        rank = self.rank[at]
        far = rank == self.ranks
        apart = np.where(far, self.ranks, np.abs(rank - np.arange(len(top))[:, None])).sum(axis=0)
        best = int(apart.argmin())
        return self.langs[best], float(1 - apart[best] / (self.ranks * len(top)))


def fit(docs: DataFrame, ranks: int = RANKS, fit_rows: int = FIT_ROWS) -> Profiles:
    """Profiles of the languages in ``docs`` (doc_id, text, lang).

    Each language is learned from about ``fit_rows`` of its rows with text, chosen
    by a hash of doc_id whatever the table's order; all rows of it where there are no more.  The names of
    the languages are collected: it is an error to have over 10,000.
    """
    known = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    sizes = dict(known.groupBy("lang").count().limit(10_001).collect())
    if len(sizes) > 10_000:
        raise ValueError("over 10,000 languages")
    if not sizes:
        return Profiles({}, ranks)
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, min(1.0, fit_rows / n)).otherwise(share)
    draw = F.pmod(F.xxhash64(F.lit(8), "doc_id"), F.lit(1 << 30)) / (1 << 30)
    sample = known.where(draw < share).select("lang", "text")

    def count(batches):
        import pandas as pd

        seen: dict[str, dict[int, int]] = {}
        for b in batches:
            for lang, text in zip(b["lang"], b["text"]):
                into = seen.setdefault(lang, {})
                for k, n in zip(*(x.tolist() for x in grams(text))):
                    into[k] = into.get(k, 0) + n
        for lang, into in seen.items():
            yield pd.DataFrame({"lang": lang, "gram": list(into.keys()), "n": list(into.values())})

    counts = sample.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("r", F.row_number().over(order)).where(F.col("r") <= ranks)
    profiles: dict[str, list[int]] = {}
    for lang, gram, _, r in sorted(top.collect(), key=lambda x: (x.lang, x.r)):
        profiles.setdefault(lang, []).append(gram)
    return Profiles(profiles, ranks)


def predict(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score), one row per input row, from whole texts alone.

    Null texts and texts without a letter are ``und`` with score 0.  Other columns are ignored;
    an empty table gives an empty result.
    """

    def run(batches):
        import pandas as pd

        for b in batches:
            out = [profiles.predict(t) for t in b["text"]]
            yield pd.DataFrame({id_col: b["id"], "lang_pred": [o[0] for o in out], "score": [o[1] for o in out]})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"`{id_col}` {kind}, lang_pred string, score double")


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows outside the held-out fold (crc32 of doc_id mod 4 = 2); rows without doc_id train."""
    return docs.where(F.coalesce(fold_of("doc_id", 4), F.lit(0)) != 2)


def predict_folds(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learned from the training fold, predicted for every row."""
    done = predict(docs, fit(training_rows(docs)))
    return done.select("doc_id", (F.coalesce(fold_of("doc_id", 4), F.lit(0)) == 2).alias("held_out"), "lang_pred", "score")
