"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature is cut into bins; cyclic boosting visits the features in turn and
fits a shallow tree to the current gradient over that feature's bins, adding its
leaves to the feature's lookup table.  The strongest pairs then get two-way
tables in the same way.  A score is the logistic of the intercept and the table
entries of a row's bins.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import fold_of

FEATURES = (
    "log_words", "word_length", "upper", "symbols", "digits", "spaces", "pipes", "distinct_words", "adjacent_repeats", "top_word",
    "repeated_lines", "line_words", "symbol_words", "upper_words", "ends", "non_ascii", "longest_word", "repeated_shingles",
)
#: Labelled training rows that the tables are fitted to, about; threshold of ``predicted``.
FIT_ROWS, THRESHOLD = 20_000, 0.3


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Of each code point: 0 other symbol, 1 upper, 2 other letter, 3 digit, 4 white space."""
    kind = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            kind[c] = 1 if ch.isupper() else 2
        elif ch.isdigit():
            kind[c] = 3
        elif ch.isspace():
            kind[c] = 4
    return kind


def features(text: str | None) -> np.ndarray:
    """The features of a whole text in the order of FEATURES; null counts as empty, whose features are zero."""
    text = text or ""
    words = text.split()
    out = np.zeros(len(FEATURES), np.float32)
    if not words:
        return out
    n, size = len(words), len(text)
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    kinds = _classes()[codes]
    symbol, upper, letter, digit, space = np.bincount(kinds, minlength=5).tolist()
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    shingles = Counter(zip(words, words[1:], words[2:]))
    word_chars = size - space
    out[:] = (
        np.log1p(n),
        word_chars / n,
        upper / max(1, upper + letter),
        symbol / size,
        digit / size,
        space / size,
        text.count("|") / n,
        len(counts) / n,
        sum(map(str.__eq__, words, words[1:])) / n,
        max(counts.values()) / n,
        1 - len(set(lines)) / len(lines),
        n / len(lines),
        sum(c for w, c in counts.items() if not w[-1].isalnum() and w[-1] not in ".,;:!?)\"'") / n,
        sum(c for w, c in counts.items() if len(w) > 1 and w.isupper()) / n,
        sum(text.count(x) for x in ".!?") / n,
        int((codes > 127).sum()) / size,
        max(map(len, counts)),
        1 - len(shingles) / max(1, n - 2) if n > 2 else 0,
    )
    return out


def feature_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x): the features of each row's whole text."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            x = [features(t.as_py()) for t in b.column(1)]
            flat = np.concatenate(x) if x else np.empty(0, np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(FEATURES), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=["id", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col)).mapInArrow(run, f"id {kind}, x array<float>")


def _leaves(g: np.ndarray, h: np.ndarray, depth: int, least: float) -> np.ndarray:
    """Newton steps of a tree of ``depth`` levels over ordered bins with gradient and curvature sums."""
    lam = 1.0
    step = np.full(len(g), g.sum() / (h.sum() + lam))
    if depth == 0 or len(g) < 2:
        return step
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + lam) + gr**2 / (hr + lam)
    gain[(hl < least) | (hr < least)] = -1
    k = int(gain.argmax())
    if gain[k] <= g.sum() ** 2 / (h.sum() + lam) + 1e-12:
        return step
    return np.concatenate((_leaves(g[: k + 1], h[: k + 1], depth - 1, least), _leaves(g[k + 1 :], h[k + 1 :], depth - 1, least)))


def _quadrants(g: np.ndarray, h: np.ndarray, least: float) -> tuple[np.ndarray, float]:
    """Newton steps of the best cut of a two-way table into four, and its gain."""
    lam = 1.0
    cg, ch = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))
    i, j = np.meshgrid(np.arange(1, g.shape[0]), np.arange(1, g.shape[1]), indexing="ij")
    if not i.size:
        return np.zeros_like(g), 0.0

    def parts(c):
        a = c[i, j]
        b, d = c[i, -1] - a, c[-1, j] - a
        return a, b, d, c[-1, -1] - a - b - d

    gs, hs = parts(cg), parts(ch)
    gain = sum(x**2 / (y + lam) for x, y in zip(gs, hs))
    k = np.unravel_index(int(gain.argmax()), gain.shape)
    steps = [x[k] / (y[k] + lam) if y[k] >= least else 0.0 for x, y in zip(gs, hs)]
    out = np.empty_like(g)
    a, b = k[0] + 1, k[1] + 1
    out[:a, :b], out[:a, b:], out[a:, :b], out[a:, b:] = steps
    return out, float(gain[k] - cg[-1, -1] ** 2 / (ch[-1, -1] + lam))


class AdditiveModel:
    """Lookup tables of single features and pairs of features."""

    def __init__(self, cuts: list[np.ndarray], intercept: float, tables: list[np.ndarray], pair_cuts: list[np.ndarray], pairs: dict[tuple[int, int], np.ndarray]):
        self.cuts, self.intercept, self.tables, self.pair_cuts, self.pairs = cuts, intercept, tables, pair_cuts, pairs

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row: one bin lookup and addition a table."""
        z = np.full(len(x), self.intercept)
        for f, (c, t) in enumerate(zip(self.cuts, self.tables)):
            z += t[np.searchsorted(c, x[:, f], side="right")]
        coarse = {f: np.searchsorted(self.pair_cuts[f], x[:, f], side="right") for f in {f for p in self.pairs for f in p}}
        for (a, b), t in self.pairs.items():
            z += t[coarse[a], coarse[b]]
        return 1 / (1 + np.exp(-z))


def _cut(x: np.ndarray, bins: int) -> np.ndarray:
    """Cut points at quantiles, half way between the values beside them."""
    values = np.unique(x)
    if len(values) < 2:
        return np.empty(0)
    marks = np.unique(np.quantile(x, np.arange(1, bins) / bins, method="lower"))
    at = np.minimum(np.searchsorted(values, marks, side="right"), len(values) - 1)
    return np.unique((values[at].astype(np.float64) + values[at - 1]) / 2)


def fit_model(x: np.ndarray, y: np.ndarray, rounds: int = 150, pair_rounds: int = 60, rate: float = 0.15, bins: int = 48, pair_bins: int = 12, n_pairs: int = 8, least: float = 1.0) -> AdditiveModel:
    """Cyclic boosting on a bounded sample; without rows of both labels the model is their share (0.5 without rows)."""
    width = x.shape[1]
    cuts = [_cut(x[:, f], bins) for f in range(width)]
    coarse = [_cut(x[:, f], pair_bins) for f in range(width)]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = AdditiveModel(cuts, float(np.log(share / (1 - share))), tables, coarse, {})
    if not len(y) or y.min() == y.max():
        return model
    z = np.full(len(y), model.intercept)
    at = [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(cuts)]

    def slopes():
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f in range(width):
            if len(cuts[f]):
                g, h = slopes()
                n = len(tables[f])
                step = rate * _leaves(np.bincount(at[f], g, n), np.bincount(at[f], h, n), 2, least)
                tables[f] += step
                z += step[at[f]]
    at2 = [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(coarse)]

    def two_way(a, b, v):
        n, m = len(coarse[a]) + 1, len(coarse[b]) + 1
        return np.bincount(at2[a] * m + at2[b], v, n * m).reshape(n, m)

    g, h = slopes()
    gains = {(a, b): _quadrants(two_way(a, b, g), two_way(a, b, h), least)[1] for a, b in combinations(range(width), 2)}
    best = sorted(gains, key=lambda p: (-gains[p], p))[:n_pairs]
    model.pairs = {(a, b): np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1)) for a, b in best}
    for _ in range(pair_rounds):
        for (a, b), t in model.pairs.items():
            g, h = slopes()
            step = rate * _quadrants(two_way(a, b, g), two_way(a, b, h), least)[0]
            t += step
            z += step[at2[a], at2[b]]
    return model


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", modulus: int = 5, held_out: int = 0, fit_rows: int = FIT_ROWS) -> AdditiveModel:
    """Tables fitted to about ``fit_rows`` labelled rows of ``docs`` outside the held-out fold, drawn by a hash of doc_id.

    The ids drawn are few enough to be sent to every task.  Rows without doc_id or label are no training rows; a doc_id labelled twice counts twice.
    """
    known = labels.select(F.col("doc_id").alias("id"), F.col(label_col).alias("y")).where(F.col("id").isNotNull() & F.col("y").isNotNull() & (fold_of("id", modulus) != held_out))
    n = known.count()
    draw = F.pmod(F.xxhash64(F.lit(9), "id"), F.lit(1 << 30)) / (1 << 30)
    drawn = known.where(draw < min(1.0, fit_rows / max(n, 1)))
    texts = docs.select(F.col("doc_id").alias("id"), "text")
    sample = texts.join(F.broadcast(drawn.select("id").distinct()), "id", "left_semi")
    rows = feature_table(sample, "id").join(F.broadcast(drawn), "id").select("id", "x", "y").toPandas()
    x = np.array(rows["x"].tolist(), np.float32).reshape(-1, len(FEATURES))
    order = np.lexsort((*x.T, rows["y"].to_numpy(), rows["id"].to_numpy()))
    return fit_model(x[order], rows["y"].to_numpy(np.float64)[order])


def scores(model: AdditiveModel, text: Column) -> Column:
    """Score of each text, from its features."""

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        return pd.Series(model.score(np.array([features(t) for t in texts], np.float32).reshape(-1, len(FEATURES))))

    return score(text)


def score_folds(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of ``docs``.

    Held out are rows whose crc32(doc_id) mod 5 is 0.  Null and empty texts have
    the score of their zero features; rows without doc_id are scored too and not held out.  An empty table gives an empty result.
    """
    done = docs.select("doc_id", scores(fit(docs, labels), F.col("text")).alias("score"))
    return done.select("doc_id", (F.coalesce(fold_of("doc_id", 5), F.lit(1)) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
