"""Toxicity by compression distance.

Two zstandard dictionaries, one of toxic and one of ordinary text, compress every
window of a document; a window counts by how many bytes shorter the toxic one
makes it.  The dictionaries are picked word lists, not trained by zstandard.  Words are coded in eight bytes each and the shortest match is seven
bytes, so that only whole words match; a word with a toxic stem, its first STEM characters, has the stem's code, so that all its forms match.
Both dictionaries end with the words that are common in ordinary text; before
them the toxic one holds the words that are used significantly more in toxic
documents (likelihood ratio) and the stems of which that holds for the rest of their words, the ordinary one as much ordinary text.  Window gains, summed and divided by a document's length, are calibrated
by isotonic regression on labelled rows that the dictionaries weren't made of.
"""

from __future__ import annotations

import numpy as np
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import fold_of

#: Words of a window; half of the labelled rows of each class that are used, about; words in a dictionary; threshold.
WINDOW, FIT_ROWS, WORDS, THRESHOLD = 16, 6000, 1024, 0.7
COMMON, LEAST_RATIO, LEAST_RATE = 256, 20.0, 4.0
#: Characters of a stem.
STEM = 5
EDGE = ".,;:!?\"'()*$%&#|"
#: Starts each window and ends each dictionary, so that windows are always stored as compressed blocks.
LEAD = bytes(range(64))


def words(text: str | None) -> list[str]:
    """Lower-case words of a whole text, without punctuation at their edges; none for null."""
    return [w for w in (x.strip(EDGE) for x in (text or "").lower().split()) if w]


def stem(word: str) -> str | None:
    """The stem of a word, marked so that it is no word; none if the word is shorter."""
    return word[:STEM] + "*" if len(word) >= STEM else None


def _dictionary(parts: list[str]) -> zstandard.ZstdCompressor:
    raw = b"".join(xxhash.xxh64_digest(w) for w in parts) + LEAD
    how = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_FAST, min_match=7, window_log=15, hash_log=14, chain_log=14, search_log=3, target_length=0, write_content_size=False, write_dict_id=False)
    return zstandard.ZstdCompressor(compression_params=how, dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT))


class Distance:
    """Compares windows under the two dictionaries; ``toxic`` has words and stems."""

    def __init__(self, toxic: list[str], ordinary: list[str], common: list[str]):
        self.parts = toxic, ordinary, common
        self.stems = {x for x in toxic if x.endswith("*")}
        self.whole = set(toxic) - self.stems
        self.by_toxic = _dictionary(common[::-1] + toxic[::-1])
        self.by_ordinary = _dictionary(common[::-1] + ordinary[::-1])

    def __reduce__(self):
        return Distance, self.parts

    def unit(self, word: str) -> str:
        """What is coded for a word: its stem, if that is toxic and the word isn't listed itself, else the word."""
        s = stem(word) if self.stems and word not in self.whole else None
        return s if s in self.stems else word

    def windows(self, text: str | None) -> list[int]:
        """Of each window of a text, the bytes by which the toxic dictionary makes it shorter."""
        codes = [xxhash.xxh64_digest(self.unit(w)) for w in words(text)]
        a, b = self.by_ordinary.compress, self.by_toxic.compress
        out = []
        for i in range(0, len(codes), WINDOW):
            w = LEAD + b"".join(codes[i : i + WINDOW])
            out.append(len(a(w)) - len(b(w)))
        return out

    def gain(self, text: str | None) -> float:
        """Positive window gains over the number of words; a short text counts as 30 words more than it has."""
        gains = self.windows(text)
        return sum(g for g in gains if g > 0) / (30 + WINDOW * len(gains))


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising step function nearest to y under weights w: pooled levels at their mean x, a little shrunk to a half."""
    blocks: list[list[float]] = []
    at, inverse = np.unique(x, return_inverse=True)
    for v, total, weight in zip(at, np.bincount(inverse, y * w), np.bincount(inverse, w)):
        blocks.append([v * weight, total, weight])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([(b[1] + 0.05) / (b[2] + 0.1) for b in blocks])


class Classifier:
    """Distance and calibration."""

    def __init__(self, distance: Distance | None, knots: np.ndarray, levels: np.ndarray):
        self.distance, self.knots, self.levels = distance, knots, levels

    def score(self, text: str | None) -> float:
        return float(np.interp(self.distance.gain(text) if self.distance else 0.0, self.knots, self.levels))


def _scored(made: DataFrame, sizes: dict[int, int], unit) -> DataFrame:
    """(w, o, t, llr, rate): counts in ordinary and toxic rows of what ``unit`` makes of words, where it isn't None.

    A count is that of the documents or of the words it follows, if they are fewer, so that neither copies nor one long text count much.
    """

    def uses(batches):
        import pandas as pd

        for b in batches:
            seen: dict[tuple[str, int, int], int] = {}
            for text, y in zip(b["text"], b["y"]):
                w = words(text)
                u = [unit(x) for x in w]
                for x in set(u):
                    seen[x, -1, y] = seen.get((x, -1, y), 0) + 1
                seen.update(dict.fromkeys(zip(u, [0, *(xxhash.xxh64_intdigest(x) >> 1 for x in w)], [y] * len(w)), 1))
            yield pd.DataFrame([(*k, n) for k, n in seen.items() if k[0] is not None], columns=["w", "p", "y", "n"])

    no, nt = sizes.get(0, 0), sizes.get(1, 0)
    of = lambda y: F.sum(F.when(F.col("y") == y, F.col("n")).otherwise(0))
    each = made.mapInPandas(uses, "w string, p long, y int, n long").groupBy("w", "p").agg(of(0).alias("o"), of(1).alias("t"))
    least = lambda k: F.least(F.sum(F.when(F.col("p") < 0, F.col(k)).otherwise(0)), F.sum(F.when(F.col("p") >= 0, F.least(F.col(k), F.lit(1))).otherwise(0)))
    counts = each.groupBy("w").agg(least("o").alias("o"), least("t").alias("t"))
    both = F.col("o") + F.col("t")
    part = lambda k, m: F.when(F.col(k) > 0, F.col(k) * F.log(F.col(k) / (both * m / max(1, no + nt)))).otherwise(0.0)
    rate = (F.col("t") + 0.5) / (nt + 1) / ((F.col("o") + 0.5) / (no + 1))
    return counts.select("w", "o", "t", (2 * (part("o", no) + part("t", nt))).alias("llr"), rate.alias("rate"))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", modulus: int = 3, held_out: int = 1, fit_rows: int = FIT_ROWS) -> Classifier:
    """Dictionaries and calibration from labelled rows outside the held-out fold.

    Each part (seven tenths make the dictionaries, the rest calibrates) is drawn from about ``fit_rows`` rows of each class, drawn by a hash of doc_id; the ids drawn are few enough
    to be sent to every task.  A doc_id labelled twice counts once, as toxic if either label says so.
    Without rows of both classes there are no dictionaries and the score is the toxic share (0.5 without rows).
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull() & (fold_of("doc_id", modulus) != held_out)).groupBy("doc_id").agg(F.max((F.col(label_col) > 0).cast("int")).alias("y"))
    sizes = dict(known.groupBy("y").count().collect())
    if len(sizes) < 2:
        return Classifier(None, np.zeros(1), np.array([float(next(iter(sizes), 0.5))]))
    share = F.when(F.col("y") == 1, min(1.0, 2 * fit_rows / sizes[1])).otherwise(min(1.0, 2 * fit_rows / sizes[0]))
    draw = lambda k: F.pmod(F.xxhash64(F.lit(k), "doc_id"), F.lit(1 << 30)) / (1 << 30)
    drawn = known.where(draw(10) < share).select("doc_id", "y", (draw(11) < 0.7).alias("made"))
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")

    made = rows.where("made").select("text", "y")
    sizes_made = dict(made.groupBy("y").count().collect())
    scored = _scored(made, sizes_made, lambda w: w)
    telling = (F.col("t") >= 3) & (F.col("llr") >= LEAST_RATIO) & (F.col("rate") >= LEAST_RATE)
    toxic = [r.w for r in scored.where(telling).orderBy(F.desc("llr"), "w").limit(WORDS).collect()]
    plain = [r.w for r in scored.where(F.col("rate") < 1.5).orderBy(F.desc("o"), "w").limit(COMMON + WORDS).collect()]
    listed = set(toxic)
    rest = _scored(made, sizes_made, lambda w: None if w in listed else stem(w))
    toxic += [r.w for r in rest.where(telling).orderBy(F.desc("llr"), "w").limit(WORDS - len(toxic)).collect()]
    distance = Distance(toxic, plain[COMMON : COMMON + len(toxic)], plain[:COMMON])

    def gains(batches):
        import pandas as pd

        for b in batches:
            yield pd.DataFrame({"y": b["y"], "gain": [distance.gain(t) for t in b["text"]]})

    found = rows.where("not made").select("text", "y").mapInPandas(gains, "y int, gain double").toPandas()
    if not len(found):
        return Classifier(distance, np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    w = {1: sizes[1] / max(1, min(sizes[1], 2 * fit_rows)), 0: sizes[0] / max(1, min(sizes[0], 2 * fit_rows))}
    return Classifier(distance, *isotonic(found["gain"].to_numpy(), found["y"].to_numpy(float), found["y"].map(w).to_numpy(float)))


def score_table(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score), one row per input row, from whole texts alone."""

    def run(batches):
        import pandas as pd

        for b in batches:
            yield pd.DataFrame({id_col: b["id"], "score": [model.score(t) for t in b["text"]]})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"`{id_col}` {kind}, score double")


def score_folds(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of ``docs``.

    Held out are rows whose crc32(doc_id) mod 3 is 1.  Null and empty texts are
    scored as texts without windows; rows without doc_id are scored and not held out.
    """
    done = score_table(docs, fit(docs, labels))
    return done.select("doc_id", (F.coalesce(fold_of("doc_id", 3), F.lit(0)) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
