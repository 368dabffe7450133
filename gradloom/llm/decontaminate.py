"""Benchmark decontamination by template canonicalisation.

Texts become templates: numbers, names and units turn into typed placeholders.
Windows of template tokens are hashed and looked up among the benchmark's
windows; the matches of a document and an item are chained along a diagonal, and the
values in their slots must map to each other one to one, which catches
re-parameterised questions and leaves chance agreements alone.  Windows of the plain
lower-case tokens are looked up beside them, so that a verbatim copy of a whole item or of RUN tokens
in a row is found however its tokens are typed, and whatever share of them are slots.  All this is done a second time with
names in a row, and numbers in a row, as one slot each, so that a value of several words may stand for one of one word.
An item too short for windows is found in a document that has exactly its tokens.  The benchmark's hashes go to
every task in parts of bounded size, one pass over the documents for each part.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tokens of a window (items shorter than that match as a whole, from SHORTEST tokens on).
WINDOW, SHORTEST = 8, 4
#: A document is contaminated by an item from this share of its windows, or this many tokens in a row, on.
COVERAGE, RUN = 0.5, 13
#: Characters of benchmark text in one part.
PART_CHARS = 8_000_000
_TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+|[.!?\n]")
LITERAL, NUMBER, UNIT, NAME, STOP = range(5)
NUMBER_WORDS = set("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())
UNITS = set(
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg ton tons ounce ounces oz lb lbs pound pounds ml l liter liters litre litres gallon gallons "
    "second seconds minute minutes hour hours day days week weeks month months year years percent dollar dollars euro euros cent cents degree degrees "
    "mph kph meter meters metre metres kilometer kilometers kilogram kilograms gram grams watt watts volt volts joule joules".split()
)
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_MARKS = np.array([0, 0x1111111111111111, 0x2222222222222222, 0x3333333333333333], np.uint64)


#: Distinct raw tokens that a worker remembers at once.
MEMO = 1 << 18


class _Vocabulary(dict):
    """Number of a raw token; beside it the token's kind and hash."""

    def __init__(self):
        self.kinds = np.zeros(MEMO + 64, np.int8)
        self.hashes = np.zeros(MEMO + 64, np.uint64)

    def __missing__(self, token: str) -> int:
        low = token.lower()
        if token in ".!?\n":
            kind = STOP
        elif token[0].isdigit() or low in NUMBER_WORDS:
            kind = NUMBER
        elif low in UNITS:
            kind = UNIT
        elif token[0].isupper() and token[1:].islower():
            kind = NAME
        else:
            kind = LITERAL
        at = len(self)
        if at >= len(self.kinds):
            self.kinds = np.concatenate((self.kinds, np.zeros_like(self.kinds)))
            self.hashes = np.concatenate((self.hashes, np.zeros_like(self.hashes)))
        self.kinds[at], self.hashes[at] = kind, xxhash.xxh64_intdigest(low)
        self[token] = at
        return at


_words = _Vocabulary()


def _parse(text: str | None) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray, np.ndarray]:
    """(code of each template token, whether it is a slot, all raw tokens, the template's places among them, the hash of each of its tokens in lower case)."""
    global _words
    if len(_words) > MEMO:
        _words = _Vocabulary()
    raw = _TOKEN.findall(text) if text else []
    at = np.fromiter(map(_words.__getitem__, raw), np.int64, len(raw))
    kinds = _words.kinds[at]
    stop = kinds == STOP
    before = np.concatenate(([STOP], kinds[:-1]))
    kinds[(kinds == NAME) & (before == STOP) | (kinds == UNIT) & (before != NUMBER)] = LITERAL
    places = np.flatnonzero(~stop)
    kinds = kinds[places]
    slot = kinds != LITERAL
    plain = _words.hashes[at[places]]
    codes = plain.copy()
    codes[slot] = _MARKS[kinds[slot]]
    return codes, slot, raw, places, plain


def template(text: str | None) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(code of each template token, whether it is a slot, its lower-case text).

    A unit counts only after a number, a name only inside a sentence.
    """
    codes, slot, raw, places, _ = _parse(text)
    return codes, slot, [raw[i].lower() for i in places]


def window_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """One hash for each window of ``n`` codes."""
    if len(codes) < n:
        return np.empty(0, np.uint64)
    size = len(codes) - n + 1
    with np.errstate(over="ignore"):
        h = codes[:size] * _MULTIPLY
        for i in range(1, n):
            h += codes[i : size + i]
            h *= _MULTIPLY
        return h ^ (h >> np.uint64(29))


class Parsed:
    """A text's template: codes, whether each is a slot, plain hashes, and the raw tokens [begin, stop) of each."""

    def __init__(self, codes: np.ndarray, slot: np.ndarray, plain: np.ndarray, raw: list[str], begin: np.ndarray, stop: np.ndarray):
        self.codes, self.slot, self.plain, self.raw, self.begin, self.stop = codes, slot, plain, raw, begin, stop

    def low(self, i: int) -> str:
        return " ".join(self.raw[self.begin[i] : self.stop[i]]).lower()

    def merged(self) -> Parsed | None:
        """The same with names in a row, and numbers in a row, as one slot each; None if there are no such rows."""
        c = self.codes
        again = (c[1:] == c[:-1]) & ((c[1:] == _MARKS[NUMBER]) | (c[1:] == _MARKS[NAME])) & self.slot[1:] & (self.begin[1:] == self.stop[:-1])
        if not again.any():
            return None
        at = np.flatnonzero(np.concatenate(([True], ~again)))
        inside = np.arange(len(c)) - np.repeat(at, np.diff(np.concatenate((at, [len(c)]))))
        with np.errstate(over="ignore"):
            power = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(int(inside.max()), _MULTIPLY))))
            plain = np.add.reduceat(self.plain * power[inside], at)
        return Parsed(c[at], self.slot[at], plain, self.raw, self.begin[at], np.concatenate((self.stop[at[1:] - 1], self.stop[-1:])))


def parsed(text: str | None) -> Parsed:
    codes, slot, raw, places, plain = _parse(text)
    return Parsed(codes, slot, plain, raw, places, places + 1)


class View:
    """The windows of some parsed benchmark items, as templates (``telling`` ones, at least half words) and as plain tokens."""

    def __init__(self, items: list[Parsed]):
        self.items = items
        self.lows = [{i: x.low(i) for i in np.flatnonzero(x.slot).tolist()} for x in items]
        where: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        self.windows, self.telling = [], []
        for k, x in enumerate(items):
            n = min(WINDOW, len(x.codes))
            found = 0
            telling = np.zeros(0, bool)
            if n >= SHORTEST:
                telling = np.array([2 * int(x.slot[p : p + n].sum()) <= n for p in range(len(x.codes) - n + 1)], bool)
                for p, (h, exact) in enumerate(zip(window_hashes(x.codes, n).tolist(), window_hashes(x.plain, n).tolist())):
                    if telling[p]:  # else almost any text with slots agrees
                        where[n][h].append((k, p))
                        found += 1
                    if exact != h:
                        where[n][exact].append((k, p))
            self.windows.append(found)
            self.telling.append(telling)
        self.where = {n: dict(x) for n, x in where.items()}
        self.seen = {}
        for n, x in self.where.items():
            self.seen[n] = np.zeros(1 << 20, bool)
            self.seen[n][np.array(list(x), np.uint64) & np.uint64((1 << 20) - 1)] = True

    def hits(self, doc: Parsed) -> dict[int, tuple[float, int, bool]]:
        """(share of its windows found, longest run of tokens, whether every slot has its own value) of each item found."""
        codes, plain = doc.codes, doc.plain
        chains: dict[tuple[int, int], tuple[set[int], set[int]]] = defaultdict(lambda: (set(), set()))  # starts found as templates; all starts
        width: dict[int, int] = {}
        slots = bool(doc.slot.any())
        for n, where in self.where.items():
            for exact, h in enumerate((window_hashes(codes, n), window_hashes(plain, n))[: 1 + slots]):
                for p in np.flatnonzero(self.seen[n][h & np.uint64((1 << 20) - 1)]).tolist():
                    for k, q in where.get(int(h[p]), ()):
                        chains[k, p - q][1].add(q)
                        if not exact and self.telling[k][q]:
                            chains[k, p - q][0].add(q)
                        width[k] = n
        best: dict[int, tuple[float, int, bool]] = {}
        for (k, shift), (by_template, either) in chains.items():
            item, low = self.items[k], self.lows[k]
            n = width[k]
            first = max(0, -shift)
            last = min(len(item.codes), len(codes) - shift)
            alike = item.codes[first:last] == codes[first + shift : last + shift]
            verbatim = item.plain[first:last] == plain[first + shift : last + shift]
            found = []  # (share, longest run, same) by templates alone, by both, and by verbatim copies alone
            for starts, agreeing in ((by_template, alike), (either, alike | verbatim)):
                if not starts or starts is either and either == by_template and (alike | ~verbatim).all():
                    continue
                maps, back, same, ok = {}, {}, True, True
                agree = np.flatnonzero(np.concatenate(([False], agreeing, [False])) == 0)
                covered = []  # the stretches of agreement that hold a window found of which half are words
                for a, b in zip(agree, agree[1:]):
                    a, b = first + int(a), first + int(b) - 1
                    if b - a >= n and any(q in starts and self.telling[k][q] for q in range(a, b - n + 1)):
                        covered += range(a, b)
                for i in covered:
                    if item.slot[i]:
                        a, b = low[i], doc.low(i + shift)
                        same &= a == b
                        ok &= maps.setdefault(a, b) == b and back.setdefault(b, a) == a
                if not ok:
                    continue
                run = longest = 0
                for a, b in zip([-2, *covered], covered):
                    run = run + 1 if b == a + 1 else 1
                    longest = max(longest, run)
                share = sum(bool(self.telling[k][q]) for q in starts) / max(1, self.windows[k])
                if share >= COVERAGE or longest >= RUN:
                    found.append((share, longest, same))
            gaps = np.flatnonzero(np.concatenate(([False], verbatim, [False])) == 0)
            copied = int(np.diff(gaps).max()) - 1  # tokens of the longest verbatim stretch
            if copied >= min(RUN, len(item.codes)):
                found.append(((copied - n + 1) / (len(item.codes) - n + 1), copied, True))
            best[k] = max([best.get(k, (0.0, 0, False)), *found])
        return {k: v for k, v in best.items() if v[1]}


class Index:
    """Some benchmark items (id, text), token by token and with rows of names and of numbers merged."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = items
        flat = [parsed(t) for _, t in items]
        rows = [x.merged() for x in flat]
        self.flat = View(flat)
        self.rows = any(x is not None for x in rows)
        self.merged = View([x or y for x, y in zip(rows, flat)])
        self.short: dict[tuple, list[int]] = defaultdict(list)
        for k, x in enumerate(flat):
            if 0 < len(x.codes) < SHORTEST:
                self.short[tuple(x.plain.tolist())].append(k)

    def __reduce__(self):
        return Index, (self.items,)

    def hits(self, text: str | None) -> list[tuple[int, float, int, bool]]:
        """(item id, share of its windows found, longest run of tokens, whether every slot has its own value) of each item in ``text``."""
        doc = parsed(text)
        best = self.flat.hits(doc)
        rows = doc.merged()
        if rows is not None or self.rows:
            for k, v in self.merged.hits(rows or doc).items():
                best[k] = max(best.get(k, v), v)
        if len(doc.codes) < SHORTEST:
            best.update(dict.fromkeys(self.short.get(tuple(doc.plain.tolist()), ()), (1.0, len(doc.codes), True)))
        return [(self.items[k][0], *v) for k, v in sorted(best.items())]


def indexes(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> list[Index]:
    """The benchmark in parts of about PART_CHARS characters, each small enough to be sent to every task.

    Items without an id or text, or without tokens, match nothing.
    """
    items = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).where("i is not null and t is not null")
    size = items.agg(F.sum(F.length("t"))).first()[0] or 0
    parts = max(1, -(-size // PART_CHARS))
    out = []
    for k in range(parts):
        out.append(Index(sorted(tuple(r) for r in items.where(F.pmod(F.xxhash64("i"), F.lit(parts)) == k).collect())))
    return out


def hits_column(index: Index, text: Column) -> Column:
    """array<struct<item_id, coverage, run, exact>> of the items of one index in a text."""

    @F.pandas_udf("array<struct<item_id:long,coverage:double,run:int,exact:boolean>>")
    def find(texts):
        import pandas as pd

        return pd.Series([[{"item_id": i, "coverage": c, "run": r, "exact": e} for i, c, r, e in index.hits(t)] for t in texts])

    return find(text)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, item_id, coverage, run, exact): a row for each document row and item that contaminates it.

    Texts are searched whole; null and empty texts hold nothing; repeated rows and
    items give rows of their own.  ``exact`` is false where slot values differ.  Empty tables give an empty result; other columns are ignored.
    """
    out = None
    for index in indexes(benchmark):
        found = docs.select(F.col(id_col), F.explode(hits_column(index, F.col(text_col))).alias("hit")).select(id_col, "hit.*")
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text no item contaminates, in one narrow pass for each part of the benchmark."""
    for index in indexes(benchmark):
        docs = docs.where(F.size(hits_column(index, F.col(text_col))) == 0)
    return docs
