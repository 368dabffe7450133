"""Unbounded n-gram scoring of texts against a corpus by sharded suffix arrays.

Each token is predicted from the longest context before it that occurs in the
training corpus, by the counts of that context and of that context with the token.  The training corpus's
suffixes lie in suffix arrays sharded by key range, so that a query goes to one shard and
not to every one: a shard sorts its suffixes and finds by binary search, token after token, the interval of those that start as the
query does; the interval's weight at each depth is the count of that n-gram.

A shard can't hold unbounded suffixes, so they come in levels: level 0 is keyed by the first two tokens and holds the next two, level r is
keyed by the hash of the first 4^r tokens and holds the next 3 * 4^r, without bound.  A suffix goes on to the next level only if a query asks for its
key.  If t[s..] matches M[s] tokens, the longest context of token i starts at the first s with
s + M[s] >= i; so held-out texts query at each start, and a start whose every match also matches from the start before it
(equal interval weights tell) need not go on.  A training text occurs itself, so its longest context is all before the
token: one query from its start gives all counts, until only itself is left.

Blocks of documents are kept as files in the shared folder; equal suffixes of a block travel as one row with a weight, and a
key with more rows than a shard should hold is split over several, whose answers are summed.

The continuation probability is smoothed with the base unigram probability.  How far a match is trusted, by its length and count, is
the share of all training positions whose continuation occurs elsewhere too.
"""

from __future__ import annotations

import pickle
import uuid
from functools import cache, cached_property

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import drop_path, files_of, fold_of, materialize, new_path, transient_shuffles
from .token_counts import _open

#: Tokens of a block; suffixes of a shard, about; bytes of the suffixes of a shard at the deeper levels, about.
BLOCK, SHARD, SHARD_BYTES = 1_000_000, 2_000_000, 1 << 25
#: Match lengths and powers of two of counts by which matches are trusted; one in SAMPLE starts shows which keys are hot.
LENGTHS, COUNTS, SAMPLE = 3, 16, 64
END = xxhash.xxh64_intdigest(b"\n")
_ODD = 0xD6E8FEB86659FD93
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
REQUEST = "block string, shard int, keys binary, own binary, anchors binary"
SENT = "block string, shard int, data binary"
#: Added to the class of a suffix's first token where its key is split over several shards.
SPLIT = 64


def tokens(text: str | None) -> list[int]:
    """64-bit keys of the words of a whole text (A-Z lowered), then of the end."""
    digest = xxhash.xxh64_intdigest
    return [*map(digest, (text or "").encode().lower().split()), END]


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = a * _A + b
        h ^= h >> np.uint64(30)
        h *= _B
        h ^= h >> np.uint64(27)
        h *= _C
        return h ^ (h >> np.uint64(31))


def level(r: int) -> tuple[int, int]:
    """Tokens of a key at level ``r`` and tokens held after it."""
    return (2, 2) if r == 0 else (4**r, 3 * 4**r)


def _small(x: np.ndarray) -> np.ndarray:
    """Whole numbers from zero on in the fewest bytes that hold them."""
    return x.astype(np.min_scalar_type(int(x.max()))) if len(x) else x.astype(np.uint8)


@cache
def _zstd() -> tuple:
    """This process's compressor and decompressor: making them costs more than a small array."""
    import zstandard

    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _pack(x: np.ndarray) -> bytes:
    """Bytes of whole numbers from zero on, place by place, compressed."""
    x = np.ascontiguousarray(_small(x))
    planes = x.data if x.itemsize == 1 else np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).data
    return x.dtype.char.encode() + _zstd()[0].compress(planes)


def _unpack(x: bytes) -> np.ndarray:
    kind = np.dtype(bytes(x[:1]).decode())
    flat = np.frombuffer(_zstd()[1].decompress(bytes(x[1:])), np.uint8)
    return np.ascontiguousarray(flat.reshape(kind.itemsize, -1).T).view(kind).ravel()


def _pack_rising(x: np.ndarray) -> bytes:
    """Rising 64-bit keys by their differences."""
    return _pack(np.diff(x, prepend=np.uint64(0)) if len(x) else x)


def _unpack_rising(x: bytes) -> np.ndarray:
    return np.cumsum(_unpack(x).astype(np.uint64), dtype=np.uint64)


def _save(folder: str, name: str, **arrays: np.ndarray) -> None:
    """Write arrays of whole numbers from zero on as one file; a repeated attempt puts the same file in its place."""
    data = pickle.dumps({k: _pack(v.astype(np.uint8) if v.dtype == bool else v) for k, v in arrays.items()})
    system, at = _open(folder)
    system.create_dir(at, recursive=True)
    with system.open_output_stream(part := f"{at}/{name}.{uuid.uuid4().hex}.part") as f:
        f.write(data)
    system.move(part, f"{at}/{name}")


def _read(folder: str, name: str) -> dict[str, np.ndarray]:
    system, at = _open(folder)
    with system.open_input_stream(f"{at}/{name}") as f:
        return {k: _unpack(v) for k, v in pickle.loads(f.read()).items()}


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, rising, and the place of each key among them."""
    order = np.argsort(keys)
    ordered = keys[order]
    first = np.concatenate(([True], ordered[1:] != ordered[:-1])) if len(keys) else np.empty(0, bool)
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(first) - 1
    return ordered[first], place


def _own(distinct: np.ndarray, place: np.ndarray, train: np.ndarray) -> np.ndarray:
    """Of each distinct key, twice the training tokens that have it, and one more if a held-out token does.

    ``place`` is each asking token's key among the distinct ones, ``train`` whether it trains.
    """
    own = np.bincount(place[train], minlength=len(distinct)) * 2
    own[place[~train]] |= 1
    return own


def _requests(block: str, distinct: np.ndarray, own: np.ndarray, shards: int) -> list[tuple]:
    """Rows that ask for the corpus counts of keys, one for each shard: what the block's training tokens add, and whether its held-out tokens ask."""
    shard = ((distinct >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
    cuts = np.searchsorted(shard, np.arange(shards + 1, dtype=np.uint64))
    return [(block, int(s), _pack_rising(distinct[cuts[s] : cuts[s + 1]]), _pack(own[cuts[s] : cuts[s + 1]])) for s in np.flatnonzero(np.diff(cuts))]


def shards_for(entries: int, most: int | None = None) -> int:
    """Shards for so many keys of blocks: as rows number blocks times shards, no more of them than the keys need."""
    return int(min(max(8, -(-2 * entries // SHARD)), most or 1 << 31))


def _frame(rows: list[tuple]):
    import pandas as pd

    out = pd.DataFrame([x[:4] for x in rows], columns=["block", "shard", "keys", "own"])
    out["anchors"] = [x[4] if len(x) > 4 else None for x in rows]
    return out


def write_blocks(docs: DataFrame, folder: str) -> DataFrame:
    """(block, words): write blocks of (id, text, held) as files; the distinct words of each.

    A block is named after its partition and its place there, so that a repeated attempt makes the same blocks.
    """

    def run(batches):
        import pandas as pd
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        ids, flat, sizes, flags = [], [], [], []

        def close():
            h = np.array(flat, np.uint64)
            n, held = np.array(sizes, np.int64), np.array(flags, bool)
            name = f"{part}-{made}"
            words, place = _distinct(h)
            null = np.array([i is None for i in ids], bool)
            known = np.array([0 if i is None else i for i in ids], np.int64)
            _save(folder, name, words=np.diff(words, prepend=np.uint64(0)), place=place, n=n, held=held, id=known.view(np.uint64), null=null)
            _save(f"{folder}/asks", name, words=np.diff(words, prepend=np.uint64(0)), own=_own(words, place, ~np.repeat(held, n)))
            for x in (ids, flat, sizes, flags):
                x.clear()
            return pd.DataFrame({"block": [name], "words": [len(words)]})

        for b in batches:
            for i, text, held in zip(b["id"], b["text"], b["held"]):
                keys = tokens(text)
                ids.append(None if i is None or i != i else int(i))
                flat.extend(keys)
                sizes.append(len(keys))
                flags.append(held)
                if len(flat) >= BLOCK:
                    yield close()
                    made += 1
        if sizes:
            yield close()

    return docs.mapInPandas(run, "block string, words long")


def ask_words(blocks: DataFrame, folder: str, shards: int) -> DataFrame:
    """The blocks' requests for the counts of their distinct words."""

    def run(batches):
        for b in batches:
            for name in b["block"]:
                had = _read(f"{folder}/asks", name)
                yield _frame(_requests(name, np.cumsum(had["words"].astype(np.uint64), dtype=np.uint64), had["own"], shards))

    return _spread(blocks, "block").mapInPandas(run, REQUEST)


class Block:
    """A block's tokens: their keys, end of their document, whether they train, and once words are counted their numbers (from one on) and counts."""

    def __init__(self, folder: str, name: str):
        base = _read(folder, name)
        self.folder, self.name = folder, name
        self.n, self.held, self.null = base["n"].astype(np.int64), base["held"].astype(bool), base["null"].astype(bool)
        self.id = base["id"].astype(np.uint64).view(np.int64)
        self.place = base["place"].astype(np.int64)
        self.words = np.cumsum(base["words"].astype(np.uint64), dtype=np.uint64)
        self.h = self.words[self.place]
        self.ends = np.cumsum(self.n)
        self.starts = self.ends - self.n
        self.end, self.start = np.repeat(self.ends, self.n), np.repeat(self.starts, self.n)
        self.train = ~np.repeat(self.held, self.n)

    def numbered(self) -> Block:
        found = _read(f"{self.folder}/words", self.name)
        self._numbers = found["number"].astype(np.int64), found["count"].astype(np.int64)
        return self

    @cached_property
    def number(self) -> np.ndarray:
        return self._numbers[0][self.place]

    @cached_property
    def count(self) -> np.ndarray:
        return self._numbers[1][self.place]

    def text(self, at: np.ndarray) -> np.ndarray:
        """The numbers at positions."""
        return self.number[at] if "number" in self.__dict__ else self._numbers[0][self.place[at]]

    def left(self, at: np.ndarray) -> np.ndarray:
        """Tokens of its document from each position on."""
        return self.end[at] - at

    def columns(self, at: np.ndarray, depth: int, width: int) -> np.ndarray:
        """The numbers of ``width`` tokens from ``depth`` tokens after each position on, zero after the document's end."""
        if 4 * len(at) > len(self.h):
            out = np.zeros((len(at), width), np.int64)
            for k in range(depth, depth + width):
                later = np.concatenate((self.number[k:], np.zeros(min(k, len(self.number)), np.int64)))
                later[self.end - k <= np.arange(len(later))] = 0
                out[:, k - depth] = later[at]
            return out
        where = at[:, None] + np.arange(depth, depth + width)
        inside = where < self.end[at][:, None]
        return np.where(inside, self.number[np.minimum(where, len(self.number) - 1)], 0)

    @cached_property
    def _sums(self) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the tokens' keys times powers of an odd number, and that number's inverse powers."""
        with np.errstate(over="ignore"):
            powers = [np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(len(self.h), x, np.uint64)))) for x in (_ODD, pow(_ODD, -1, 1 << 64))]
            return np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.h * powers[0][:-1], dtype=np.uint64))), powers[1]

    def spans(self, at: np.ndarray, size: int) -> np.ndarray:
        """Keys of the next ``size`` tokens of the document, or what is left of it."""
        sums, inverse = self._sums
        with np.errstate(over="ignore"):
            return _mix((sums[np.minimum(at + size, self.end[at])] - sums[at]) * inverse[at], np.zeros(1, np.uint64))


    def anchors(self, at: np.ndarray, size: int) -> np.ndarray:
        """Keys of the least of all stretches of a quarter of ``size`` in the next ``size`` tokens of each position: the same for equal tokens, and often for positions that are near.

        All positions have as many tokens left.
        """
        if not len(at):
            return np.zeros(0, np.uint64)
        doc = np.searchsorted(self.ends, at, "right")
        some = np.unique(doc)
        n = self.n[some]
        first = np.cumsum(n) - n
        least = self.spans(np.repeat(self.starts[some], n) + _ragged(n), max(1, size // 4))
        width, step = size - max(1, size // 4) + 1, 1
        while 2 * step <= width:
            least[:-step] = np.minimum(least[:-step], least[step:])
            step *= 2
        if rest := width - step:
            least[:-rest] = np.minimum(least[:-rest], least[rest:])
        return _mix(least[first[np.searchsorted(some, doc)] + at - self.starts[doc]], np.zeros(1, np.uint64))


def count_shard(keys: list[np.ndarray], own: list[np.ndarray]) -> list[np.ndarray]:
    """Answers to each block's keys: twice the corpus count, and one more if a held-out token asks anywhere.

    The shard's keys are sorted, and those of each block found by binary search.
    """
    whole = np.concatenate(keys)
    order = np.argsort(whole)
    whole, added = whole[order], np.concatenate(own)[order].astype(np.int64)
    starts = np.flatnonzero(np.concatenate(([True], whole[1:] != whole[:-1])))
    totals = np.add.reduceat(added >> 1, starts) << 1 | np.maximum.reduceat(added & 1, starts)
    distinct = whole[starts]
    return [totals[np.searchsorted(distinct, k)] for k in keys]


def _spread(df: DataFrame, key: str) -> DataFrame:
    """Rows by ``key``, over so many tasks whatever their bytes: what a row costs isn't its size."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * df.sparkSession.sparkContext.defaultParallelism), key)


def _by_shard(requests: DataFrame, run, schema: str) -> DataFrame:
    return _spread(requests, "shard").groupBy("shard").applyInPandas(run, schema)


def count_words(requests: DataFrame, shards: int) -> DataFrame:
    """(block, shard, data, known, total): each asked word's corpus count and a number of its own; on one row of a shard the counted words and all their counts."""

    def run(pdf):
        import pandas as pd

        keys = [_unpack_rising(k) for k in pdf["keys"]]
        own = [_unpack(t) for t in pdf["own"]]
        found = [c >> 1 for c in count_shard(keys, own)]
        distinct, at = np.unique(np.concatenate(keys), return_index=True)
        rank = np.empty(len(distinct), np.int64)
        rank[np.argsort(-np.concatenate(found)[at], kind="stable")] = np.arange(len(distinct))  # frequent words get numbers of few bytes
        shard = int(pdf["shard"].iloc[0])
        data = [pickle.dumps((_pack(c), _pack(rank[np.searchsorted(distinct, k)] * shards + shard + 1))) for c, k in zip(found, keys)]
        known = len(np.unique(np.concatenate([k[c > 0] for k, c in zip(keys, found)])))
        head = np.arange(len(pdf)) == 0
        return pd.DataFrame({"block": pdf["block"], "shard": pdf["shard"], "data": data, "known": np.where(head, known, 0), "total": np.where(head, sum(int((t >> 1).sum()) for t in own), 0)})

    return _by_shard(requests, run, f"{SENT}, known long, total long")


def count_keys(requests: DataFrame) -> DataFrame:
    """(block, shard, data, rows, anchors): of each key its suffixes and whether a query asks for it; on one row of a shard the suffixes that are asked for; the sampled anchors, handed on."""

    def run(pdf):
        import pandas as pd

        keys = [_unpack_rising(k) for k in pdf["keys"]]
        found = count_shard(keys, [_unpack(t) for t in pdf["own"]])
        both = np.concatenate(found)
        _, first = np.unique(np.concatenate(keys), return_index=True)
        asked = both[first]
        return pd.DataFrame({"block": pdf["block"], "shard": pdf["shard"], "data": [_pack(c) for c in found], "rows": np.where(np.arange(len(pdf)) == 0, int((asked >> 1)[(asked & 1) > 0].sum()), 0), "anchors": pdf["anchors"]})

    return _by_shard(requests, run, f"{SENT}, rows long, anchors binary")


def _rate(r: int) -> int:
    """One in so many suffixes of a deep level shows which anchors are hot."""
    return max(1, min(SAMPLE, SHARD_BYTES // (4 * level(r)[1]) // 64))


def hot_anchors(keys: DataFrame, rate: int, limit: int) -> np.ndarray:
    """Anchors with more suffixes than ``limit``, as sampled: at most as many as would fill a shard's share each, so they fit a closure.  Their suffixes are spread by their keys instead; results don't depend on it."""

    def each(batches):
        import pandas as pd

        for b in batches:
            for x in b["anchors"]:
                anchor, n = np.unique(_unpack(x).astype(np.uint64), return_counts=True)
                yield pd.DataFrame({"anchor": anchor.view(np.int64), "n": n})

    found = keys.where("anchors is not null").select("anchors").mapInPandas(each, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    return np.sort(np.array([x.anchor for x in found.where(F.col("n") * rate > limit).select("anchor").collect()], np.int64).view(np.uint64))


def _ragged(lens: np.ndarray) -> np.ndarray:
    """0, 1, ... for each length."""
    return np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)


def _narrow(column: np.ndarray, lo: np.ndarray, hi: np.ndarray, x: np.ndarray, right: bool) -> np.ndarray:
    """Binary search for ``x`` within each interval [lo, hi) of a column that is sorted there."""
    a, b = lo.copy(), hi.copy()
    todo = np.flatnonzero(a < b)
    while len(todo):
        mid = (a[todo] + b[todo]) >> 1
        before = column[mid] <= x[todo] if right else column[mid] < x[todo]
        a[todo] = np.where(before, mid + 1, a[todo])
        b[todo] = np.where(before, b[todo], mid)
        todo = todo[a[todo] < b[todo]]
    return a


def _among(x: np.ndarray, rising: np.ndarray) -> np.ndarray:
    if not len(rising):
        return np.zeros(len(x), bool)
    return rising[np.minimum(np.searchsorted(rising, x), len(rising) - 1)] == x


class SuffixArray:
    """Sorted suffixes: a key, the columns of the tokens after it and a weight each."""

    def __init__(self, key: np.ndarray, columns: np.ndarray, weight: np.ndarray):
        wide = columns.size and int(columns.max()) >> 32
        if columns.shape[1] == 2:
            a, b = columns.T.astype(np.uint64)
            order = np.lexsort((b, a, key)) if wide else np.lexsort((a << np.uint64(32) | b, key))
        else:
            parts = [key[:, None].astype(">u8").view(np.uint8), np.ascontiguousarray(columns.astype(">u8" if wide else ">u4")).view(np.uint8)]
            text = np.ascontiguousarray(np.concatenate(parts, axis=1))
            order = np.argsort(text.view(f"S{text.shape[1]}").ravel(), kind="stable")
        self.order, self.key, self.columns = order, key[order], np.asfortranarray(columns[order])
        self.sums = np.concatenate(([0], np.cumsum(weight[order])))

    def search(self, key: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(depths found of each query, from the key alone on; the counts at these depths one query after another; the last intervals)."""
        lo, hi = np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")
        found, who, depths = [], np.flatnonzero(hi > lo), np.zeros(len(key), np.int64)
        for c in range(columns.shape[1] + 1):
            if c:
                x, column = columns[who, c - 1], self.columns[:, c - 1]
                left, right = lo[who], hi[who]
                part = np.flatnonzero((column[left] != x) | (column[right - 1] != x))
                if len(part):  # other intervals go on whole
                    end = right[part]
                    left[part] = _narrow(column, left[part], end, x[part], False)
                    right[part] = _narrow(column, left[part], end, x[part], True)
                    lo[who], hi[who] = left, right
                ok = (right > left) & (x > 0)
                who = who if ok.all() else who[ok]
            if not len(who):
                break
            depths[who] += 1
            found.append((who, self.sums[hi[who]] - self.sums[lo[who]]))
        starts = np.cumsum(depths) - depths
        counts = np.empty(int(depths.sum()), np.int64)
        for c, (who, n) in enumerate(found):
            counts[starts[who] + c] = n
        return depths, counts, lo, hi

    def runs(self, columns: int) -> np.ndarray:
        """Of each suffix in order, the count of its key with the first ``columns`` tokens."""
        new = self.key[1:] != self.key[:-1]
        for c in range(columns):
            new = new | (self.columns[1:, c] != self.columns[:-1, c])
        at = np.concatenate(([0], np.flatnonzero(new) + 1))
        sizes = np.diff(np.concatenate((at, [len(self.key)])))
        return np.repeat(np.diff(self.sums[np.concatenate((at, [len(self.key)]))]), sizes)


def _size_class(count: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(count, 1)).astype(np.int64), COUNTS - 1)


def continued(array: SuffixArray, first: np.ndarray) -> np.ndarray:
    """Sums of (positions whose continuation occurs elsewhere, positions) by context length 1 to LENGTHS and class of the context's count elsewhere.

    ``first``: one more than the class of each suffix's first token, 0 if it occurs nowhere else, 255 to leave the suffix out.
    """
    out = np.zeros((LENGTHS, COUNTS, 2))
    if not len(array.key):
        return out
    weight = np.diff(array.sums)
    counts = [array.runs(0), array.runs(1), array.runs(2)]
    for d in range(LENGTHS):
        there = first < 255 if d == 0 else (first < 255) & (array.columns[:, d - 1] > 0)
        there = there & (first > 0 if d == 0 else counts[d - 1] > 1)
        bucket = (first.astype(np.int64) - 1 if d == 0 else _size_class(counts[d - 1] - 1))[there]
        out[d, :, 0] = np.bincount(bucket, (weight * (counts[d] > 1))[there], COUNTS)
        out[d, :, 1] = np.bincount(bucket, weight[there], COUNTS)
    return out


def trigrams(array: SuffixArray, first: np.ndarray) -> bytes | None:
    """Of a shard's share of split keys, for each key and next token: class of the first token, suffixes, those that go on to a fourth token, and those of them whose fourth token occurs there elsewhere.

    Equal suffixes of four tokens are never split, so these numbers add up over the shards.
    """
    some = np.flatnonzero((first >= SPLIT) & (first < 255))
    if not len(some):
        return None
    key, token, weight = array.key[some], array.columns[some, 0].astype(np.int64), np.diff(array.sums)[some]
    on = weight * (array.columns[some, 1] > 0)
    at = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (token[1:] != token[:-1]))))
    return pickle.dumps([_pack(x) for x in (key[at], token[at], first[some][at] - SPLIT, *(np.add.reduceat(x, at) for x in (weight, on, on * (array.runs(2)[some] > 1))))])


def split_sums(answers: DataFrame) -> np.ndarray:
    """The sums of ``continued`` for the keys that are split, from all shards' trigrams."""
    spark, out = answers.sparkSession, np.zeros((LENGTHS, COUNTS, 2))
    names = ["key", "token", "first", "n", "on", "again"]

    def rows(batches):
        import pandas as pd

        for b in batches:
            for x in b["split"]:
                yield pd.DataFrame({k: _unpack(v).astype(np.uint64).view(np.int64) for k, v in zip(names, pickle.loads(x))})

    each = answers.where("split is not null").select("split").mapInPandas(rows, ", ".join(f"{k} long" for k in names))
    three = materialize(each.groupBy("key", "token").agg(F.max("first").alias("first"), *(F.sum(k).alias(k) for k in names[3:])), "ngram-split")
    size = lambda k: F.least(F.length(F.bin(F.col(k) - 1)) - 1, F.lit(COUNTS - 1))
    two = three.groupBy("key").agg(F.max("first").alias("first"), F.sum("n").alias("all"), F.sum(F.expr("if(token > 0, n, 0)")).alias("n"), F.sum(F.expr("if(token > 0 and n > 1, n, 0)")).alias("again"))
    one = two.where("first > 0").groupBy((F.col("first") - 1).alias("k")).agg(F.sum(F.expr("if(all > 1, all, 0)")), F.sum("all"))
    for d, df in enumerate((one, two.where("all > 1").groupBy(size("all").alias("k")).agg(F.sum("again"), F.sum("n")), three.where("n > 1").groupBy(size("n").alias("k")).agg(F.sum("again"), F.sum("on")))):
        for k, again, n in df.collect():
            out[d, k] = again, n
    for p in files_of(three):
        drop_path(spark, p)
    return out


def _pairs(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """One key for each two words, in their order where all numbers have 32 bits."""
    one, two = one.astype(np.uint64), two.astype(np.uint64)
    return one << np.uint64(32) | two


def _four(words: np.ndarray) -> np.ndarray:
    """Keys of rows of four words."""
    a, b, c, d = words.T.astype(np.uint64)
    return _mix(_mix(_mix(a, b), c), d)


def _wide(words: np.ndarray) -> bool:
    return bool(words.size) and int(words.max()) >> 32 > 0


def pack_words(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of four words, best in order: the first two as differences of pairs (one number a row, or two where numbers are wide), the last two column by column."""
    head = words[:, :2].T.ravel() if _wide(words[:, :2]) else np.diff(_pairs(words[:, 0], words[:, 1]), prepend=np.uint64(0))
    return head, words[:, 2:].T.ravel()


def unpack_words(head: np.ndarray, tail: np.ndarray) -> np.ndarray:
    n = len(tail) // 2
    out = np.empty((n, 4), np.uint32 if len(head) == n and tail.dtype != np.uint64 else np.uint64)
    if len(head) == n:
        pair = np.cumsum(head.astype(np.uint64), dtype=np.uint64)
        out[:, 0], out[:, 1] = pair >> np.uint64(32), pair & np.uint64(0xFFFFFFFF)
    else:
        out[:, :2] = head.reshape(2, -1).T
    out[:, 2:] = tail.reshape(2, -1).T
    return out


def stretches(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the union of the stretches [begin, end) of a text, and each stretch's place among them; later stretches end no earlier."""
    order = np.argsort(begin, kind="stable")
    a, e = begin[order], end[order]
    gap = np.maximum(a[1:] - e[:-1], 0)
    new = np.concatenate(([True], gap > 0))[: len(a)]
    last = np.concatenate((new[1:], [True]))[: len(a)]
    lens = e[last] - a[new]
    place = np.empty(len(a), np.int64)
    place[order] = a - a[:1] - np.concatenate(([0], np.cumsum(gap)))[: len(a)]
    return np.repeat(a[new], lens) + _ragged(lens), place


def _laid(text: np.ndarray, place: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """Rows of ``width`` tokens of a text from each place on, zero after ``size`` tokens."""
    where = place[:, None] + np.arange(width)
    inside = np.arange(width) < size[:, None]
    return np.where(inside, text[np.minimum(where, len(text) - 1)], text.dtype.type(0)) if len(text) else np.zeros(where.shape, text.dtype)


def search_shards(sent: DataFrame, r: int) -> DataFrame:
    """(block, shard, data, going, sums, split): the answers to each block's queries; how many keys the block may ask for at the next level; at level 0 also which of its suffixes a query matches to their end, and on one row of a shard the trust sums and split keys' trigrams."""

    def run(pdf):
        import pandas as pd

        got = [{k: _unpack(v) for k, v in pickle.loads(d).items()} for d in pdf["data"]]
        width, sizes = level(r)[1], [len(d["asked_size"]) for d in got]
        if r == 0:
            words, asked = (np.concatenate([unpack_words(d[k], d[f"{k}_next"]) for d in got]) for k in ("words", "asked"))
            wide = _wide(words) or _wide(asked)
            key, ask = (_mix(x[:, 0], x[:, 1]) if wide else _pairs(x[:, 0], x[:, 1]) for x in (words, asked))
            columns, asked_columns = (x[:, 2:].astype(np.uint64 if wide else np.uint32) for x in (words, asked))
        else:
            kind = np.uint64 if any(d["text"].dtype == np.uint64 for d in got) else np.uint32
            keys = [np.cumsum(d["keys"].astype(np.uint64), dtype=np.uint64) for d in got]
            key, ask = (np.concatenate([k[d[x]] for k, d in zip(keys, got)]) for x in ("key", "asked"))
            columns, asked_columns = (np.concatenate([_laid(d["text"].astype(kind), np.cumsum(d[f"{x}place"].astype(np.uint64), dtype=np.uint64).astype(np.int64), d[f"{x}size"], width) for d in got]) for x in ("", "asked_"))
        array = SuffixArray(key, columns, np.concatenate([d["weight"].astype(np.int64) for d in got]))
        del columns
        depths, counts, lo, hi = array.search(ask, asked_columns)
        deep = np.zeros(len(array.key), bool)
        full = depths == width + 1
        if r == 0:
            marks = np.zeros(len(deep) + 1, np.int64)
            np.add.at(marks, lo[full], 1)
            np.add.at(marks, hi[full], -1)
            deep[array.order] = np.cumsum(marks[:-1]) > 0
        out, going, a, b, c = [], [], 0, 0, 0
        for d, n in zip(got, sizes):
            m, size = len(d["weight"]), int(depths[a : a + n].sum())
            matched = _four(words[c : c + m][deep[c : c + m]]) if r == 0 else np.zeros(0, np.uint64)
            going.append(int(full[a : a + n].sum()) + (len(matched) if r == 0 else int((d["size"] == width).sum())))
            out.append(pickle.dumps((_pack(depths[a : a + n]), _pack(counts[b : b + size]), _pack(matched))))
            a, b, c = a + n, b + size, c + m
        sums, split = [None] * len(pdf), [None] * len(pdf)
        if r == 0:
            first = np.concatenate([d["first"] for d in got])[array.order]
            sums[0], split[0] = continued(array, np.where(first < SPLIT, first, 255)).ravel(), trigrams(array, first)
        return pd.DataFrame({"block": pdf["block"], "shard": pdf["shard"], "data": out, "going": going, "sums": sums, "split": split})

    return _by_shard(sent, run, f"{SENT}, going long, sums array<double>, split binary")


def _shard_of(key: np.ndarray, salt: np.ndarray, shards: int) -> np.ndarray:
    key = np.where(salt > 0, _mix(key, salt.astype(np.uint64)), key)
    return (((key >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


def send(b: Block, r: int, index: np.ndarray, asking: np.ndarray, parts_of, shards: int, hot: np.ndarray | None = None) -> list[tuple]:
    """Rows (block, shard, data) of level ``r``: the block's suffixes at ``index`` and its queries at ``asking``; what it asked is saved.

    ``parts_of`` gives the number of shards over which each key is split.  Given ``hot``, suffixes go to shards by anchors, so that those of
    a shard share their text, and by keys only where the anchor is among the hot ones.
    """
    depth, width = level(r)

    def home(at: np.ndarray, key: np.ndarray) -> np.ndarray:
        if hot is None:
            return key
        anchor = b.anchors(at, depth)
        return np.where(_among(anchor, hot), key, anchor)

    key, ask = b.spans(index, depth), b.spans(asking, depth)
    span = b.spans(index, depth + width)
    order = np.argsort(span)
    at = np.flatnonzero(np.concatenate(([True], span[order[1:]] != span[order[:-1]]))[: len(order)])
    weight = np.diff(np.concatenate((at, [len(order)])))
    index, key, span = index[order[at]], key[order[at]], span[order[at]]
    words, asked = (b.columns(x, 0, 4) for x in (index, asking)) if r == 0 else (None, None)
    some = place = np.arange(len(asking))
    if r:
        _, some, place = np.unique(b.spans(asking, depth + width), return_index=True, return_inverse=True)
    unique, ask = asking[some], ask[some]
    _save(f"{b.folder}/asked-{r}", b.name, at=np.diff(asking, prepend=0), place=place)
    parts, ask_parts = parts_of(key), parts_of(ask)
    salt = (span % parts.astype(np.uint64)).astype(np.int64) if (parts > 1).any() else np.zeros(len(index), np.int64)
    who = np.repeat(np.arange(len(unique)), ask_parts)
    shard, ask_shard = _shard_of(home(index, key), salt, shards), _shard_of(home(unique, ask)[who], _ragged(ask_parts), shards)
    if len(who) > len(unique):  # parts of a key that share a shard are asked there once
        who, ask_shard = np.divmod(np.unique(who * shards + ask_shard), shards)
    if r == 0 and not (_wide(words) or _wide(asked)):
        pair, ask_pair = _pairs(words[:, 0], words[:, 1]), _pairs(asked[:, 0], asked[:, 1])
        order = np.argsort(pair, kind="stable")
        order, ask_order = order[np.argsort(_small(shard[order]), kind="stable")], np.lexsort((ask_pair[who], ask_shard))
    else:
        order, ask_order = np.argsort(_small(shard), kind="stable"), np.argsort(_small(ask_shard), kind="stable")
    cuts, ask_cuts = (np.searchsorted(x, np.arange(shards + 1)) for x in (shard[order], ask_shard[ask_order]))
    _save(f"{b.folder}/order-{r}", b.name, who=who[ask_order])
    first = np.zeros(len(index), np.uint8)
    if r == 0:
        n = b.count[index]
        first = (np.where(n > 1, 1 + _size_class(n - 1), 0) + np.where(parts > 1, SPLIT, 0)).astype(np.uint8)
    out = []
    for s in np.flatnonzero((np.diff(cuts) > 0) | (np.diff(ask_cuts) > 0)):
        i, j = order[cuts[s] : cuts[s + 1]], who[ask_order[ask_cuts[s] : ask_cuts[s + 1]]]
        if r == 0:
            (head, tail), (ask_head, ask_tail) = pack_words(words[i]), pack_words(asked[j])
            data = {"words": head, "words_next": tail, "first": first[i], "asked": ask_head, "asked_next": ask_tail, "asked_size": np.zeros(len(j), np.uint8)}
        else:
            i = i[np.argsort(index[i])]
            keys, which = np.unique(np.concatenate((key[i], ask[j])), return_inverse=True)
            begin = np.concatenate((index[i], unique[j])) + depth
            end = np.minimum(begin + width, b.end[begin - depth])
            text, at = stretches(begin, end)
            size, n = end - begin, len(i)
            places = (np.diff(x, prepend=0).view(np.uint64) for x in (at[:n], at[n:]))
            data = {"keys": np.diff(keys, prepend=np.uint64(0)), "key": which[:n], "asked": which[n:], "text": b.text(text), "size": size[:n], "asked_size": size[n:]} | dict(zip(("place", "asked_place"), places))
        data["weight"] = weight[i]
        out.append((b.name, int(s), pickle.dumps({k: _pack(v) for k, v in data.items()})))
    return out


def _sent(rows: list[tuple]):
    import pandas as pd

    return pd.DataFrame(rows, columns=["block", "shard", "data"])


class Answers:
    """What a block's queries of one level found."""

    def __init__(self, folder: str, r: int, name: str):
        found = _read(f"{folder}/level-{r}", name)
        self.depth, self.width = level(r)
        self.at, self.place, self.lens = (found[k].astype(np.int64) for k in ("at", "place", "lens"))
        self.at, self.starts, self.counts = np.cumsum(self.at), np.cumsum(self.lens) - self.lens, found["counts"].astype(np.int64)

    def count(self, k: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Counts of the first ``length`` tokens of the queries numbered ``k``, zero where they don't occur."""
        p, d = self.place[k], length - self.depth
        ok = d < self.lens[p]
        return np.where(ok, self.counts[np.where(ok, self.starts[p] + d, 0)] if len(self.counts) else 0, 0)


def keep_answers(b: Block, r: int, pdf) -> np.ndarray:
    """Save a level's answers, summed over the shards of a split key; what suffixes queries match to their end."""
    ordered = [pickle.loads(d) for _, d in sorted(zip(pdf["shard"], pdf["data"]))]
    depths, counts, matched = (np.concatenate([_unpack(x[k]).astype(np.uint64 if k == 2 else np.int64) for x in ordered]) for k in range(3))
    who = _read(f"{b.folder}/order-{r}", b.name)["who"].astype(np.int64)
    asked = _read(f"{b.folder}/asked-{r}", b.name)
    lens = np.zeros(int(asked["place"].astype(np.int64).max(initial=-1)) + 1, np.int64)
    np.maximum.at(lens, who, depths)
    total = np.zeros(int(lens.sum()), np.int64)
    np.add.at(total, np.repeat((np.cumsum(lens) - lens)[who], depths) + _ragged(depths), counts)
    _save(f"{b.folder}/level-{r}", b.name, at=asked["at"], place=asked["place"], lens=lens, counts=total)
    return matched


def going_on(b: Block, a: Answers) -> np.ndarray:
    """The starts that must be asked for at the next level."""
    k, end = np.arange(len(a.at)), a.depth + a.width
    full = a.lens[a.place] == a.width + 1
    last, before = a.count(k, np.full(len(k), end)), a.count(k, np.full(len(k), end - 1))
    covered = np.zeros(len(k), bool)  # every match from here on is one from the start before
    covered[1:] = full[:-1] & (a.at[1:] == a.at[:-1] + 1) & (a.at[1:] != b.start[a.at[1:]]) & (last[:-1] == before[1:])
    return a.at[full & (b.left(a.at) > end) & np.where(b.train[a.at], last > 1, ~covered)]


def ask_keys(b: Block, r: int, index: np.ndarray, asking: np.ndarray, shards: int, rate: int) -> list[tuple]:
    """Rows that ask for which keys of level ``r`` there are suffixes and queries."""
    depth, width = level(r)
    index = index[b.left(index) > depth]
    _save(f"{b.folder}/next-{r}", b.name, index=np.diff(index, prepend=0), asking=np.diff(asking, prepend=0))
    if not len(index) and not len(asking):
        return []
    span, some = np.unique(_mix(b.spans(index, depth), b.spans(index, depth + width)), return_index=True)
    distinct, place = _distinct(np.concatenate((b.spans(index[some], depth), b.spans(asking, depth))))
    rows = _requests(b.name, distinct, _own(distinct, place, np.arange(len(place)) < len(some)), shards)
    seen = b.anchors(index[some[span % np.uint64(rate) == 0]], depth)
    return [(*rows[0], _pack(seen)), *rows[1:]] if len(seen) else rows


def token_scores(b: Block, total: int, known: int, trust: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 base and model probabilities of a block's tokens."""
    from pyarrow import fs

    system, at = _open(b.folder)
    levels = []
    while system.get_file_info(f"{at}/level-{len(levels)}/{b.name}").type == fs.FileType.File:
        levels.append(Answers(b.folder, len(levels), b.name))
    here = np.arange(len(b.h))
    match = (b.count > 0).astype(np.int64)
    for a in levels:
        n = a.lens[a.place]
        match[a.at] = np.where(n > 0, a.depth + n - 1, match[a.at])
    reach = np.maximum.accumulate(here + np.where(b.train, 0, match))
    reach = np.where(b.train, b.end, reach)
    begin = np.where(b.train, b.start, np.maximum(np.searchsorted(np.maximum.accumulate(reach), here), b.start))
    length = here - begin

    def counts(size: np.ndarray) -> np.ndarray:
        """Counts of the ``size`` tokens from ``begin`` on; a training text past what was asked has only itself."""
        out = np.where(size == 1, b.count[begin], 0)
        known = np.flatnonzero((size > 1) & (size <= match[begin]))
        for a in levels:
            n = size[known]
            there = known[(n > a.depth) & (n <= a.depth + a.width) | (n == 2) & (a.depth == 2)]
            if len(there):
                k = np.minimum(np.searchsorted(a.at, begin[there]), len(a.at) - 1)
                ok = a.at[k] == begin[there]
                out[there[ok]] = a.count(k[ok], size[there[ok]])
        return np.where(b.train & (size > 0), np.maximum(out, 1), out)

    den, num = counts(length), counts(length + 1)
    base = (b.count + 1) / (total + known + 1)
    t = np.where(den > 0, trust[np.clip(length, 1, LENGTHS) - 1, _size_class(den)], 0.0)
    return np.log10(base), np.log10(t * num / np.maximum(den, 1) + (1 - t) * base)


def _by_block(answers: DataFrame, folder: str, run, schema: str) -> DataFrame:
    """``run`` of each block and its answers, rows of the shape ``schema``."""
    make = _frame if schema == REQUEST else _sent

    def each(key, pdf):
        return make(run(Block(folder, key[0]), pdf))

    return _spread(answers.select("block", "shard", "data"), "block").groupBy("block").applyInPandas(each, schema)


def hot_keys(blocks: DataFrame, folder: str) -> dict[int, int]:
    """Level 0's keys with more suffixes than half a shard, and in how many parts they are split; counted on one start in SAMPLE.

    There are at most 2 / SHARD as many as tokens in the corpus, so they fit a closure.  As no shard has all of their counts, their trust sums are added up from all shards' (``split_sums``): results don't depend on what is split.
    """
    limit = SHARD // 2

    @F.pandas_udf("array<long>")
    def some(names):
        import pandas as pd

        out = []
        for name in names:
            b = Block(folder, name)
            at = np.flatnonzero(b.train & (b.end - np.arange(len(b.h)) > 1))
            at = at[_mix(at.astype(np.uint64), np.full(1, xxhash.xxh64_intdigest(name), np.uint64)) % np.uint64(SAMPLE) == 0]
            out.append(b.spans(at, 2).view(np.int64))
        return pd.Series(out)

    each = blocks.select(F.explode(some("block")).alias("key")).groupBy("key").count().where(F.col("count") * SAMPLE > limit)
    return {r.key & 0xFFFFFFFFFFFFFFFF: -(-r["count"] * SAMPLE // limit) for r in each.collect()}


def _parts(hot: dict[int, int]):
    keys = np.array(sorted(hot), np.uint64)
    parts = np.array([hot[int(k)] for k in keys], np.int64)

    def of(key: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.ones(len(key), np.int64)
        k = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where(keys[k] == key, parts[k], 1)

    return of


def score_table(docs: DataFrame, held, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per input row.

    The model is learned from the rows for which the boolean column ``held`` is
    not true, and scores every row, its training rows with their own text in the corpus.  Null texts
    count as empty (one token, the end); ids are long; repeated rows count as often as they occur; an empty table gives an empty
    result; other columns are ignored.  Texts of any length are scored whole; a long text is one block.  Without training rows both scores are those of counts zero.
    """
    spark = docs.sparkSession
    folder = new_path(spark, "ngram")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.coalesce(held, F.lit(False)).alias("held"))
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = int(max(8, -(-size // (5 * SHARD))))
    old: list[DataFrame] = []

    def kept(df: DataFrame) -> DataFrame:
        out = materialize(df, "ngram")
        while old:
            for p in files_of(old.pop()):
                drop_path(spark, p)
        old.append(out)
        return out

    with transient_shuffles(spark):
        blocks = materialize(write_blocks(rows, folder), "ngram-blocks")
        few = shards_for(blocks.agg(F.sum("words")).first()[0] or 0)
        words = kept(count_words(ask_words(blocks, folder, few), few))
        drop_path(spark, f"{folder}/asks")
        total, known = (x or 0 for x in words.agg(F.sum("total"), F.sum("known")).first())
        hot = hot_keys(blocks, folder)

        def start(b: Block, pdf):
            found = [pickle.loads(d) for _, d in sorted(zip(pdf["shard"], pdf["data"]))]
            _save(f"{folder}/words", b.name, count=np.concatenate([_unpack(c) for c, _ in found]), number=np.concatenate([_unpack(n).astype(np.int64) for _, n in found]))
            b.numbered()
            at = np.arange(len(b.h))
            more = b.left(at) > 1
            return send(b, 0, np.flatnonzero(b.train & more), np.flatnonzero(more & (~b.train | (at == b.start)) & (b.count > 0)), _parts(hot), shards)

        answers = kept(search_shards(_by_block(words, folder, start, SENT), 0))
        sums = np.zeros(LENGTHS * COUNTS * 2)
        for x in answers.where("sums is not null").select(F.posexplode("sums").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).collect():
            sums[x.k] = x.v
        if hot:
            sums += split_sums(answers).ravel()
        r = 0
        while not answers.isEmpty():

            few = shards_for(answers.agg(F.sum("going")).first()[0], shards)

            rate = _rate(r + 1)

            def ask(b: Block, pdf, r=r, few=few, rate=rate):
                matched = keep_answers(b, r, pdf)
                a = Answers(b.folder, r, b.name)
                if r:
                    index = np.cumsum(_read(f"{b.folder}/index-{r}", b.name)["index"].astype(np.int64))
                else:
                    b.numbered()
                    index = np.flatnonzero(b.train & (b.end - np.arange(len(b.h)) > 4))
                    index = index[_among(_four(b.columns(index, 0, 4)), np.unique(matched))]
                asking = going_on(b, a)
                return ask_keys(b, r + 1, index, asking, few, rate)

            def tell(b: Block, pdf, r=r + 1, room=SHARD_BYTES):
                b.numbered()
                depth, width = level(r)
                found = np.concatenate([_unpack(d).astype(np.int64) for _, d in sorted(zip(pdf["shard"], pdf["data"]))])
                had = _read(f"{b.folder}/next-{r}", b.name)
                index, asking = (np.cumsum(had[k].astype(np.int64)) for k in ("index", "asking"))
                distinct = np.unique(np.concatenate((b.spans(index, depth), b.spans(asking, depth))))
                there = lambda at: found[np.searchsorted(distinct, b.spans(at, depth))]
                index, asking = index[there(index) & 1 > 0], asking[there(asking) > 1]
                _save(f"{b.folder}/index-{r}", b.name, index=np.diff(index, prepend=0))
                if not len(index) and not len(asking):
                    return []
                each = max(1, room // (4 * width))
                return send(b, r, index, asking, lambda k: np.maximum(1, -(-(found[np.searchsorted(distinct, k)] >> 1) // each)), wide, hot_here)

            keys = kept(count_keys(_by_block(answers, folder, ask, REQUEST)))
            for done in ("asked", "order", "index"):
                drop_path(spark, f"{folder}/{done}-{r}")
            r += 1
            wide = int(max(8, -(-4 * level(r)[1] * (keys.agg(F.sum("rows")).first()[0] or 0) // SHARD_BYTES)))
            hot_here = hot_anchors(keys, rate, SHARD_BYTES // (8 * level(r)[1]))
            answers = kept(search_shards(_by_block(keys, folder, tell, SENT), r))
            drop_path(spark, f"{folder}/next-{r}")

    sums = sums.reshape(LENGTHS, COUNTS, 2)
    trust = (sums[..., 0] + 0.5) / (sums[..., 1] + 1)

    def final(batches):
        import pandas as pd

        for batch in batches:
            for name in batch["block"]:
                b = Block(folder, name).numbered()
                lo, hi = token_scores(b, total, known, trust)
                add = lambda x: np.add.reduceat(x, b.starts)
                ids = pd.array(b.id, "Int64")
                ids[b.null] = pd.NA
                yield pd.DataFrame({id_col: ids, "held_out": b.held, "n_tokens": b.n, "n_known": add((b.count > 0).astype(np.int64)), "train_tokens": total, "base_score": add(lo), "score": add(hi)})

    spread = blocks.repartition(max(1, min(10_000, 4 * spark.sparkContext.defaultParallelism)), "block")
    return spread.mapInPandas(final, f"`{id_col}` long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score_folds(docs: DataFrame) -> DataFrame:
    """Scores of every document, learned from those whose crc32(doc_id) mod 7 is not 2."""
    return score_table(docs, fold_of("doc_id", 7) == 2)
