"""SentencePiece encoding and decoding by weighted finite-state transducers.

The model file compiles to three machines: a normaliser (longest-match rewrite
rules, dummy prefix, white space marks), a piece machine (a trie whose accepting
arcs emit piece ids at a weight) and byte fallback arcs for characters outside
the vocabulary.  They are composed with each input, and the output is the
shortest path in the tropical semiring.

Weights: for a unigram model an arc weighs the piece's negative score.  A BPE
model's merges aren't a sum of scores, so there an arc remembers the piece before
it and weighs zero if merging the two pieces' text gives those two pieces again,
else infinity; exactly one path of finite weight is left, the one that merging
gives.  Both kinds of path extend prefix by prefix, so one state for each input
position is enough.

No piece spans a place where a mark follows another character, nor a character
that occurs in no longer piece, so texts are cut there and the paths of the
distinct segments are remembered, a bounded number of them.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
#: Segments whose paths a worker remembers, and the longest segment remembered.
MEMO, MEMO_CHARS = 180_000, 64


def _fields(data: bytes):
    """(number, value) of each field of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value = varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            value, at = data[at : at + n], at + n
        yield tag >> 3, value


def _charsmap_rules(blob: bytes) -> dict[str, str]:
    """The rewrite rules of a precompiled character map, a double-array trie followed by the replacements."""
    if not blob:
        return {}
    size = int.from_bytes(blob[:4], "little")
    units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
    texts = blob[4 + size :]
    rules: dict[str, str] = {}
    offset = lambda u: (u >> 10) << ((u & 512) >> 6)
    todo = [(offset(units[0]), b"")]
    while todo:
        base, key = todo.pop()
        for c in range(1, 256):
            if (at := base ^ c) < len(units) and units[at] & 0x800000FF == c:
                below, longer = at ^ offset(units[at]), key + bytes([c])
                if units[at] >> 8 & 1:
                    start = units[below] & 0x7FFFFFFF
                    rules[longer.decode(errors="ignore")] = texts[start : texts.index(b"\0", start)].decode()
                todo.append((below, longer))
    rules.pop("", None)
    return rules


class Normaliser:
    """Longest-match rewriting, then white space to marks, with an optional leading mark."""

    def __init__(self, rules: dict[str, str], dummy_prefix: bool, squeeze: bool, escape: bool):
        self.rules, self.dummy, self.squeeze, self.space = rules, dummy_prefix, squeeze, MARK if escape else " "
        self.rewrite = re.compile("|".join(map(re.escape, sorted(rules, key=len, reverse=True)))) if rules else None

    def __call__(self, text: str) -> str:
        if self.rewrite:
            text = self.rewrite.sub(lambda m: self.rules[m[0]], text)
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        return (" " * self.dummy + text).replace(" ", self.space)


class Memo(dict):
    """Paths used of late: when ``MEMO`` are held, they become the old ones and the old ones before them go."""

    before: dict = {}

    def keep(self, text: str, path: tuple[int, ...]) -> tuple[int, ...]:
        if len(text) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.before = dict(self)
                self.clear()
            self[text] = path
        return path

    def old(self, text: str) -> tuple[int, ...] | None:
        path = self.before.get(text)
        return None if path is None else self.keep(text, path)


class Transducer:
    """One compiled model: ``encode`` and ``decode``."""

    def __init__(self, data: bytes):
        pieces, kind, rules, flags, self.byte_fallback = [], 1, b"", {3: 1, 4: 1, 5: 1}, False
        for field, value in _fields(data):
            if field == 1:
                one = dict(_fields(value))
                pieces.append((one[1].decode(), float(np.frombuffer(one.get(2, b"\0\0\0\0"), "<f4")[0]), one.get(3, NORMAL)))
            elif field == 2:
                spec = dict(_fields(value))
                kind, self.byte_fallback = spec.get(3, 1), bool(spec.get(35, 0))
            elif field == 3:
                spec = dict(_fields(value))
                rules, flags = spec.get(2, b""), flags | {k: v for k, v in spec.items() if k in flags}
        if kind not in (1, 2):
            raise ValueError("only unigram and BPE models are supported")
        self.bpe = kind == 2
        self.normalise = Normaliser(_charsmap_rules(rules), bool(flags[3]), bool(flags[4]), bool(flags[5]))
        self.pieces = [p for p, _, _ in pieces]
        self.unk = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
        self.ids = {p: i for i, (p, _, k) in enumerate(pieces) if k in (NORMAL, USER)}
        self.scores = {p: s for p, s, k in pieces if k in (NORMAL, USER)}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == BYTE}
        self.unknown_weight = 10 - min(self.scores.values(), default=0.0)
        self.surface = [b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, " ").encode() for p, _, k in pieces]
        self.trie: dict = {}
        for p, i in self.ids.items():
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[""] = i
        inner = {c for p in self.ids if len(p) > 1 for c in p} - {MARK}
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids):
            cut = r"(?s).+"
        else:
            held = "".join(re.escape(c) for c in sorted(inner)) or MARK
            cut = f"{MARK}*[{held}]+|{MARK}+|[^{MARK}{held}]"
        self.cut = re.compile(cut)
        self.allowed: dict[tuple[str, str], bool] = {}
        self.split: dict[str, tuple[str, str, float] | None] = {}
        self.beside = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.memo, self.parts = Memo(), Memo()

    def _merge(self, text: str, stop: int = 1) -> list[str]:
        """The pieces that merging gives, best score first and leftmost among equals, or the ``stop`` parts before the last merges."""
        parts, score = list(text), self.scores
        while len(parts) > stop:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _halves(self, piece: str) -> tuple[str, str, float] | None:
        """The two parts whose merge makes a piece, and when that is; None if merging never makes it."""
        found = self.split.get(piece, False)
        if found is False:
            found = None
            parts = self._merge(piece, 2)
            if len(parts) == 2:
                sides = [self._halves(x) if len(x) > 1 else ("", "", float("-inf")) for x in parts]
                if None not in sides:
                    found = (*parts, max(-self.scores[piece], sides[0][2], sides[1][2]))
            self.split[piece] = found
        return found

    def _pair_ok(self, a: str, b: str) -> bool:
        """Whether merging the text of two pieces gives those two again.

        Going back in time, the part beside the seam that was made last is undone; the pieces are split
        differently if two parts that were side by side would have merged before either's own merge.
        """
        ok = self.allowed.get((a, b))
        if ok is None:
            if len(self.allowed) > 4 * MEMO:
                self.allowed.clear()
            scores, x, y, after_x, after_y, ok = self.scores, a, b, float("inf"), float("inf"), True
            while True:
                joined = scores.get(x + y)
                if joined is not None and -joined < after_x and -joined <= after_y:
                    ok = False
                    break
                made_x = self._halves(x)[2] if len(x) > 1 else float("-inf")
                made_y = self._halves(y)[2] if len(y) > 1 else float("-inf")
                if made_x == made_y == float("-inf"):
                    break
                if made_x > made_y:
                    x, after_x = self._halves(x)[1], made_x
                else:
                    y, after_y = self._halves(y)[0], made_y
            self.allowed[a, b] = ok
        return ok

    def _arcs(self, text: str, at: int) -> list[int]:
        """Where the piece arcs that leave position ``at`` end, shortest first; the next position if no piece is one character."""
        node, ends, n, e = self.trie, [], len(text), at
        while e < n:
            node = node.get(text[e])
            if node is None:
                break
            e += 1
            if "" in node:
                ends.append(e)
        if not ends or ends[0] != at + 1:
            ends.insert(0, at + 1)
        return ends

    def _finite_path(self, text: str) -> list[str]:
        """The one path of finite weight of a BPE model, longest arcs first.

        A prefix has one such path, so a position that led nowhere is never entered again.
        """
        at, n, prev = 0, len(text), ""
        path: list[str] = []
        left: list[list[int]] = []
        seen = set()
        allowed, pair_ok, halves = self.allowed, self._pair_ok, self._halves
        arcs = self._arcs(text, 0)
        while at < n:
            while arcs:
                e = arcs.pop()
                if e in seen:
                    continue
                piece = text[at:e]
                if (ok := allowed.get((prev, piece))) is None:
                    ok = pair_ok(prev, piece) if prev else e == at + 1 or halves(piece) is not None
                if ok:
                    seen.add(e)
                    path.append(piece)
                    left.append(arcs)
                    at, prev, arcs = e, piece, self._arcs(text, e)
                    break
            else:
                at -= len(path.pop())
                prev, arcs = path[-1] if path else "", left.pop()
        return path

    def _lightest_path(self, text: str) -> list[str]:
        """The path of least weight of a unigram model."""
        n, scores = len(text), self.scores
        cost: list[float] = [0.0] + [float("inf")] * n
        back = [0] * (n + 1)
        for s in range(n):
            for e in self._arcs(text, s):
                w = cost[s] - scores.get(text[s:e], -self.unknown_weight)
                if w < cost[e]:
                    cost[e], back[e] = w, s
        path = []
        while n:
            path.append(text[back[n] : n])
            n = back[n]
        return path[::-1]

    def _path(self, text: str) -> tuple[int, ...]:
        """Output of the shortest path through the composition of the machines with one segment."""
        out: list[int] = []
        fused = False
        for piece in self._finite_path(text) if self.bpe else self._lightest_path(text):
            i = self.ids.get(piece)
            if i is not None:
                out.append(i)
            elif self.byte_fallback and self.bytes:
                out += [self.bytes[b] for b in piece.encode()]
            elif not fused:
                out.append(self.unk)
            fused = i is None
        return tuple(out)

    def _segment(self, text: str) -> tuple[int, ...]:
        """The path of a segment: those of its parts between characters that stand side by side in no piece."""
        path = self.memo.old(text)
        if path is None:
            beside, parts, a = self.beside, self.parts, 0
            cuts = [i for i in range(1, len(text)) if text[i - 1 : i + 1] not in beside]
            out: tuple[int, ...] = ()
            for b in [*cuts, len(text)]:
                part = text[a:b]
                found = (parts.get(part) or parts.old(part)) if cuts else None  # a whole segment is kept once
                out += (parts.keep(part, self._path(part)) if cuts else self._path(part)) if found is None else found
                a = b
            path = self.memo.keep(text, out)
        return path

    def encode(self, text: str | None) -> list[int]:
        """Piece ids; none for null and empty texts."""
        parts = self.cut.findall(self.normalise(text)) if text else []
        memo = self.memo
        out: list[int] = []
        for part in parts:
            out += memo.get(part) or self._segment(part)
        if self.byte_fallback or self.unk not in out:
            return out
        return [i for k, i in enumerate(out) if i != self.unk or not k or out[k - 1] != self.unk]

    def decode(self, ids) -> str:
        """The text of piece ids, without the leading mark that encoding adds."""
        text = b"".join(map(self.surface.__getitem__, ids)).decode(errors="replace")
        return text[1:] if self.normalise.dummy and text.startswith(" ") else text


@lru_cache(maxsize=2)
def compiled(path: str) -> Transducer:
    """The model at ``path``, compiled once in each worker; every worker must be able to read the file."""
    with open(path, "rb") as f:
        return Transducer(f.read())


def encode_table(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids, round_trip), one row per input row, in one narrow pass over whole texts.

    ``round_trip`` tells whether decoding the ids gives the text back; it is false where the model's
    normaliser loses something (a literal white space mark, for instance).  Null texts count as
    empty: no ids, round trip true.  Other columns are ignored; an empty table gives an empty result.
    """

    def run(batches):
        import pyarrow as pa

        model = compiled(model_path)
        for b in batches:
            flat, sizes, same = [], [0], []
            for text in b.column(1):
                text = text.as_py()
                ids = model.encode(text)
                flat.append(np.array(ids, np.int32))
                sizes.append(len(ids))
                same.append(model.decode(ids) == (text or ""))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(np.concatenate(flat) if flat else np.empty(0, np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes[1:], pa.int32()), lists, pa.array(same, pa.bool_())], names=[id_col, "n_tokens", "ids", "round_trip"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_tokens int, ids array<int>, round_trip boolean")


def decode_table(encoded: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """``encoded`` with ``out_col``, the text of its ids; null ids give null, no ids the empty text."""

    @F.pandas_udf("string")
    def text_of(ids):
        model = compiled(model_path)
        return ids.map(lambda x: None if x is None else model.decode(x))

    return encoded.withColumn(out_col, text_of(F.col(ids_col)))
