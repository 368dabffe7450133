"""Main text of web pages by nearest-URL page differencing.

Pages are put in order of host and URL path and each is paired with the
neighbour in its host that shares the longer part of its path.  The text lines of the pair are aligned by
longest common subsequence, and the lines they share, a site's furniture, are
deleted.  Lines of a marked ``article`` or ``main`` stay: articles of one host do share lines that are their own text.  A pair that shares nearly
all of a page's text outside holds the same text at two addresses, and it stays too.  What elements declare is furniture (``nav``, ``footer``, a container of class ``ad``) is dropped as well, and all outside
the article where a page marks one that isn't only a teaser of the page's text.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import materialize

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)", re.S)
_ENDS = re.compile(r"['\">]")
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "xmp", "noembed", "noframes"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = set("head nav header footer aside form button select option svg canvas object audio video dialog menu map".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
FURNITURE = set(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted sidebar side aside menu menubar nav navbar navigation breadcrumb breadcrumbs "
    "footer header masthead topbar comment comments commentlist disqus reply replies respond discussion cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup "
    "login share sharing social related recommended recommendations widget widgets toolbar pagination pager form search contentinfo complementary hidden".split()
)
CLOSES = {
    "p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
}
#: Containers that a class, id or role can make furniture; parts of such a name that don't say what it is.
CONTAINERS = set("div section ul ol dl table tbody center fieldset span ins details figure".split())
GENERIC = set("site page main top bottom left right inner outer upper lower wrap wrapper container box bar block section list area item items global primary secondary links link button buttons icons group row col module unit slot zone panel content text body global".split())


def _furniture(attrs: str) -> bool:
    """Whether a name in class, id or role says so: one whose parts are furniture or say nothing, as in ``site-footer`` but not in ``share-price`` or ``has-sidebar``."""
    for m in _NAMES.finditer(attrs):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            parts = [x for x in re.split(r"[^a-z]+", name) if x]
            if any(x in FURNITURE for x in parts) and all(x in FURNITURE or x in GENERIC for x in parts):
                return True
    return False


class _Tags:
    """Finds the end of each tag; every scan is paid by the text it passes, but for one."""

    def __init__(self, html: str):
        self.html, self.quoted = html, True
        self.last = {c: html.rfind(c) for c in "'\">"}

    def end(self, at: int) -> int:
        """Where the tag ends whose attributes start at ``at``: the first > outside quotes, else the first at all; -1 without any."""
        html, last = self.html, self.last
        if at > last[">"]:
            return -1
        i = at
        while self.quoted:
            m = _ENDS.search(html, i)
            if m is None:
                self.quoted = False
            elif m[0] == ">":
                return m.start()
            elif m.start() >= last[m[0]]:  # not closed
                break
            else:
                i = html.index(m[0], m.end()) + 1
        return html.index(">", at)


def lines_of(html: str | None) -> list[tuple[str, int]]:
    """The text lines of a page in page order with their zone, in time linear in its length.

    A line is a block's text, references decoded, white space squeezed.  Zones: 2 in the article, 1 outside,
    0 in furniture.  An unclosed tag ends with its parent; furniture that is still open ends where an article begins.
    A < that no > follows is text.
    """
    html = html or ""
    out: list[tuple[str, int]] = []
    buffer: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # element, furniture, article; inline elements only where they are furniture
    blocks: list[int] = []  # places in the stack of elements that are neither inline nor p
    opened: dict[str, int] = {}
    dropped = inside = 0
    tags = _Tags(html)
    unclosed: set[str] = set()

    def flush() -> None:
        if buffer:
            text = " ".join(unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                out.append((text, 0 if dropped else 2 if inside else 1))

    def pop() -> None:
        nonlocal dropped, inside
        name, d, a = stack.pop()
        opened[name] -= 1
        if blocks and blocks[-1] == len(stack):
            blocks.pop()
        dropped -= d
        inside -= a

    def close(name: str) -> None:
        while stack[-1][0] != name:
            pop()
        pop()

    at, size = 0, len(html)
    while at < size:
        m = _TAG.search(html, at)
        end = -1 if m is None else m.end() if m[2] is None else tags.end(m.end())
        if end < 0:
            buffer.append(html[at:])
            break
        if m.start() > at:
            buffer.append(html[at : m.start()])
        if m[2] is None:
            at = end
            if m[0].startswith("<![CDATA["):
                buffer.append(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        attrs, at = html[m.end() : end], end + 1
        name = m[2].lower()
        if m[1]:
            if name not in INLINE:
                flush()
            if opened.get(name):
                close(name)
            continue
        if name in RAW:
            found = None if name in unclosed else re.compile(rf"</{name}\s*/?>", re.I).search(html, at)
            if found is None:
                unclosed.add(name)
            at = found.end() if found else size
            continue
        inline = name in INLINE
        if not inline:
            flush()
        if name in VOID or inline and attrs.rstrip().endswith("/"):
            continue
        closes = CLOSES.get(name, ())
        top = blocks[-1] if blocks else -1
        if "p" in closes:
            if opened.get("p") and any(s[0] == "p" for s in stack[top + 1 :]):
                close("p")
        elif top >= 0 and stack[top][0] in closes:
            close(stack[top][0])
        main = name in ("article", "main")
        bad = name in DROPPED or name in CONTAINERS and _furniture(attrs)
        if inline and not bad:
            continue
        if main and dropped and not inside:
            while dropped:
                pop()
        if not inline and name != "p":
            blocks.append(len(stack))
        stack.append((name, bad, main))
        opened[name] = opened.get(name, 0) + 1
        dropped += bad
        inside += main
    flush()
    return out


def _rows(a: list, b: list) -> list[int]:
    """Bit-parallel longest common subsequence: after each item of ``a``, a bit for each item of ``b``, 0 where the length grows."""
    masks: dict = {}
    for i, x in enumerate(b):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(b)) - 1
    v, out = full, []
    for x in a:
        u = v & masks.get(x, 0)
        v = ((v + u) | (v - u)) & full
        out.append(v)
    return out


def _lengths(v: int, n: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(v.to_bytes((n + 7) // 8 or 1, "little"), np.uint8), bitorder="little")[:n]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def common_lines(a: list, b: list, cells: int = 1 << 26) -> list[int]:
    """Positions in ``a`` of a longest common subsequence of ``a`` and ``b``; halves ``a`` where the table would exceed ``cells`` bits."""
    lead = 0
    while lead < min(len(a), len(b)) and a[lead] == b[lead]:
        lead += 1
    trail = 0
    while trail < min(len(a), len(b)) - lead and a[-1 - trail] == b[-1 - trail]:
        trail += 1
    ends = [*range(lead)], [*range(len(a) - trail, len(a))]
    x, y = a[lead : len(a) - trail], b[lead : len(b) - trail]
    if not x or not y:
        return ends[0] + ends[1]
    if len(x) * len(y) > cells and len(x) > 1:
        half = len(x) // 2
        first = _lengths(_rows(x[:half], y)[-1], len(y))
        last = _lengths(_rows(x[half:][::-1], y[::-1])[-1], len(y))[::-1]
        cut = int((first + last).argmax())
        found = common_lines(x[:half], y[:cut], cells) + [half + i for i in common_lines(x[half:], y[cut:], cells)]
    else:
        rows, found, j = [(1 << len(y)) - 1, *_rows(x, y)], [], len(y)
        for i in range(len(x), 0, -1):
            while j and rows[i] >> (j - 1) & 1:
                j -= 1
            if not j:
                break
            if rows[i - 1] >> (j - 1) & 1:  # the length grows here first with this line
                found.append(i - 1)
                j -= 1
        found.reverse()
    return ends[0] + [lead + i for i in found] + ends[1]


def _hash(line: str) -> int:
    return xxhash.xxh64_intdigest(line) - (1 << 63)


#: A marked article is a teaser if the page has this many times its text outside, and so many characters at least.
TEASER_TIMES, TEASER_CHARS = 4, 200
#: From this share of a page's text outside a marked article on, what a pair shares is the same text at two addresses.
SAME_PAGE = 0.9


def _chosen(marks: list[tuple[int, int]]) -> list[int]:
    """Of lines (zone, length), the places of those that are the main text."""
    article, rest = (sum(n for z, n in marks if z == zone) for zone in (2, 1))
    least = 1 if not article or rest >= max(TEASER_CHARS, TEASER_TIMES * article) else 2
    return [i for i, (z, _) in enumerate(marks) if z >= least]


def shared_lines(own: list[int], marks: list[tuple[int, int]], neighbour: list[int]) -> list[int]:
    """Places of the lines that a page's neighbour takes from its main text; none where what they share is the same article.

    ``own`` and ``neighbour``: line hashes; ``marks``: zone and length of each own line.
    """
    shared = common_lines(own, neighbour)
    outside = [i for i in range(len(own)) if marks[i][0] == 1]
    gone = {i for i in shared if marks[i][0] == 1}
    if sum(marks[i][1] for i in gone) >= SAME_PAGE * sum(marks[i][1] for i in outside):
        return []
    whole = _chosen(marks)
    left = [i for i in range(len(own)) if i not in gone]
    after = [left[i] for i in _chosen([marks[i] for i in left])]
    return sorted(gone) if after != whole else []


def main_text(html: str | None, shared: list[int] | None = None) -> str:
    """The main text of a page, lines joined by a space; ``shared``: places of the lines that its neighbour takes from it."""
    gone = set(shared or ())
    lines = [x for i, x in enumerate(lines_of(html)) if i not in gone]
    return " ".join(lines[i][0] for i in _chosen([(z, len(t)) for t, z in lines]))


def _host_and_path(url):
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"[?#].*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*:", "")
    host = F.regexp_extract(bare, r"^//([^/]*)", 1)
    return F.lower(host), F.regexp_replace(F.regexp_replace(bare, r"^//[^/]*", ""), r"/+$", "")


def pair_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, digest, shared): pages whose nearest page in the same host takes lines from them, and which.

    ``pages``: page_id, url, html; ``digest`` is a hash of the html.  The order is cut into ranges, so that a host of any size spreads over tasks;
    the ends of a range meet the ends of the ranges beside it.  Pages alone in their host are left out, as are copies of one page.
    """

    @F.pandas_udf("hashes array<long>, marks array<long>")
    def parsed(html):
        import pandas as pd

        lines = [lines_of(h) for h in html]
        return pd.DataFrame({"hashes": [[_hash(t) for t, _ in x] for x in lines], "marks": [[len(t) << 2 | z for t, z in x] for x in lines]})

    host, path = _host_and_path(F.col("url"))
    keyed = pages.select("page_id", "url", F.xxhash64("html").alias("digest"), host.alias("host"), path.alias("path"), parsed("html").alias("p")).where("host != '' and page_id is not null")
    once = keyed.groupBy("host", "path", "url", "page_id", "digest").agg(F.any_value("p").alias("p"))  # copies parse alike
    key = ["host", "path", "url", "page_id", "digest"]
    placed = materialize(once.repartitionByRange(*key).sortWithinPartitions(*key).select(*key, F.col("p.hashes").alias("lines"), F.col("p.marks").alias("marks")).withColumn("part", F.spark_partition_id()), "pages")
    whole = F.struct(*key, "lines")
    ends = placed.groupBy("part").agg(F.min(whole).alias("first"), F.max(whole).alias("last"))  # one row a range
    order = Window.orderBy("part")
    ends = ends.select("part", F.lag("last").over(order).alias("before"), F.lead("first").over(order).alias("after"))
    inside = Window.partitionBy("part").orderBy(*key)
    near = placed.withColumn("prev", F.lag(whole).over(inside)).withColumn("next", F.lead(whole).over(inside)).join(ends, "part")
    near = near.withColumn("prev", F.coalesce("prev", "before")).withColumn("next", F.coalesce("next", "after"))

    @F.pandas_udf("int")
    def alike(a, b):
        import os.path

        import pandas as pd

        return pd.Series([-1 if y is None else len(os.path.commonprefix([x, y])) for x, y in zip(a, b)])

    @F.pandas_udf("array<int>")
    def taken(own, marks, other):
        import pandas as pd

        return pd.Series([shared_lines(list(x), [(int(m) & 3, int(m) >> 2) for m in y], list(z)) for x, y, z in zip(own, marks, other)])

    same = lambda side: F.when(F.col(f"{side}.host") == F.col("host"), F.col(f"{side}.path"))
    scored = near.withColumn("p", alike("path", same("prev"))).withColumn("n", alike("path", same("next")))
    nearest = scored.where("p >= 0 or n >= 0").withColumn("other", F.when(F.col("p") >= F.col("n"), F.col("prev.lines")).otherwise(F.col("next.lines")))
    return nearest.select("page_id", "url", "digest", taken("lines", "marks", "other").alias("shared")).where(F.size("shared") > 0)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), one row per row of ``pages`` (page_id, url, html).

    Null and empty html gives an empty text; a null url or page_id has no pair; repeated rows stay; an
    empty table gives an empty result; other columns are ignored.  Pages are parsed in linear time, whatever their length or faults.
    Only the places of deleted lines travel to the pages.
    """
    pages = pages.select("page_id", "url", "html")

    @F.pandas_udf("string")
    def text_of(html, shared):
        import pandas as pd

        return pd.Series([main_text(h, None if x is None else list(x)) for h, x in zip(html, shared)])

    taken = materialize(pair_pages(pages), "pairs")
    found = pages.withColumn("digest", F.xxhash64("html")).join(taken, ["page_id", "url", "digest"], "left")
    return found.select("page_id", "url", text_of("html", "shared").alias("text")).withColumn("n_chars", F.length("text").cast("long"))
