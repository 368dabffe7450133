import random

from gradloom.llm import html_main as H


def test_article():
    page = (
        '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>";</script></head><body><nav><ul><li>Home</ul></nav>'
        '<div class="ad">Buy</div><!-- <article>no</article> --><article><h1>Caf&eacute; &amp; co</h1><p>One <b>two</b>three<br>four\n  five<p>six &#8212; &lt;b&gt;'
        '<div class="share-bar">Tweet</div><aside>see also</aside><form><input>name</form><ul><li>a<li>b</ul><table><tr><td>x<td>y</table>'
        '<section id="comments"><article><p>I agree</p></article></section></article><footer>&copy; us</footer></body></html>'
    )
    assert H.main_text(page) == "Café & co One twothree four five six — <b> a b x y"


def test_unclosed_and_odd():
    assert H.main_text("<nav>menu<article>text<p>more") == "text more"
    assert H.main_text("plain &nbsp; text") == "plain text"
    assert H.main_text(None) == H.main_text("") == H.main_text("<p></p><script>x") == ""
    assert H.main_text("<main>a <i>b</i>&#x4e2d;</main>tail") == "a b中"
    assert H.main_text('<article title="a > b">ok</article>') == "ok"
    assert H.main_text("<article>" + "<p>w " * 30000 + "</article>") == " ".join(["w"] * 30000)


def lcs(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            d[i + 1][j + 1] = d[i][j] + 1 if a[i] == b[j] else max(d[i][j + 1], d[i + 1][j])
    return d[-1][-1]


def test_common_lines_against_the_table():
    r = random.Random(1)
    for _ in range(800):
        a, b = ([r.randrange(6) for _ in range(r.randrange(14))] for _ in range(2))
        for cells in (1 << 26, 8):
            p = H.common_lines(a, b, cells)
            it = iter(b)
            assert p == sorted(set(p)) and len(p) == lcs(a, b) and all(a[i] in it for i in p)
    assert len(H.common_lines(list(range(9000)), list(range(4500, 20000)))) == 4500


def test_differencing_and_edges(spark):
    body = lambda own: f"<div><p>Site name</p><p>{own}</p><p>All rights reserved</p></div>"
    rows = [
        (1, "http://h.example/a/1", body("first")),
        (2, "https://h.example/a/2?x=1", body("second &amp; more")),
        (3, "http://h.example/b/9", "<div><p>Other site name</p><p>third</p><p>All rights reserved</p></div>"),
        (4, "http://alone.example/x", body("fourth")),
        (5, None, body("fifth")),
        (6, "http://h.example/a/1#top", "<article>kept</article>" + body("no")),
        (7, "http://h.example/a/7", None),
        (None, "http://h.example/a/8", body("eighth")),
        (1, "http://h.example/a/1", body("first")),
    ]
    pages = spark.createDataFrame([(*x, "t", 1) for x in rows], "page_id long, url string, html string, text string, lines int")
    got = sorted(((x.page_id or 0), x.text, x.n_chars) for x in H.extract(pages).collect())
    whole = lambda own: f"Site name {own} All rights reserved"
    want = [(0, whole("eighth")), (1, "first"), (1, "first"), (2, "second & more"), (3, "Other site name third"), (4, whole("fourth")), (5, whole("fifth")), (6, "kept"), (7, "")]
    near = {1: {"first", whole("first")}, 2: {"second & more", whole("second & more")}, 3: {"Other site name third", "Other site name third All rights reserved"}}
    for g, w in zip(got, want):
        assert g[0] == w[0] and g[1] in near.get(g[0], {w[1]}) and g[2] == len(g[1])
    assert H.extract(pages.limit(0)).collect() == []


def test_pairs_span_ranges(spark):
    rows = [(i, f"http://big.example/p/{i:04d}", f"<p>furniture</p><p>own {i}</p>") for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {x.page_id: x.text for x in H.extract(pages).collect()} == {i: f"own {i}" for i in range(200)}


def test_linear_time():
    """Hostile pages of about a million characters; the limit is loose, a quadratic parser takes minutes."""
    import time

    for page in ("<a " * 340_000, "<div>" * 90_000 + "</span></p></x>" * 40_000, '<a "x>y" ' * 110_000, "<b><p>" * 90_000, "<span class=ad><p>" * 50_000, "<a '" * 250_000, "<" * 1_000_000):
        began = time.time()
        H.main_text(page)
        assert time.time() - began < 15


def test_names_of_furniture():
    keep = ("alert-level", "share-price", "has-sidebar", "comments-open", "adventure", "")
    drop = ("ad", "ad-banner", "site-footer", "comment-list", "x sidebar", "cookie_notice")
    page = "".join(f'<div class="{c}">{i}</div>' for i, c in enumerate((*keep, *drop)))
    assert H.main_text(f"<article class='post has-sidebar'>{page}<p class=alert>z</article>") == "0 1 2 3 4 5 z"
    assert H.main_text("<article>teaser</article><div id=story>" + "story " * 60 + "</div>").startswith("teaser story story")


def brute(rows):
    """Main texts by the rule written out: pairs from a sorted list, the table of common lines, deletions."""
    key = {i: (u.split("/")[2], "/" + "/".join(u.split("/")[3:]), u, i) for i, u, _ in rows}
    order = sorted(key, key=key.get)
    lines = {i: H.lines_of(h) for i, _, h in rows}

    def common(a, b):
        n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in reversed(range(len(a))):
            for j in reversed(range(len(b))):
                n[i][j] = n[i + 1][j + 1] + 1 if a[i] == b[j] else max(n[i + 1][j], n[i][j + 1])
        i = j = 0
        while i < len(a) and j < len(b):
            if a[i] == b[j]:
                yield i
                i, j = i + 1, j + 1
            elif n[i + 1][j] >= n[i][j + 1]:
                i += 1
            else:
                j += 1

    out = {}
    for k, i in enumerate(order):
        best, other = -1, None
        for j in order[max(0, k - 1) : k] + order[k + 1 : k + 2]:
            if key[i][0] == key[j][0]:
                n = 0
                while n < min(len(key[i][1]), len(key[j][1])) and key[i][1][n] == key[j][1][n]:
                    n += 1
                if n > best:
                    best, other = n, j
        own, gone = lines[i], set()
        if other is not None:
            shared = set(common([t for t, _ in own], [t for t, _ in lines[other]]))
            all_, some = (sum(len(t) for p, (t, y) in enumerate(own) if y == 1 and p in q) for q in (range(len(own)), shared))
            if some < 0.9 * all_:
                gone = {p for p in shared if own[p][1] == 1}
        left = [x for p, x in enumerate(own) if p not in gone]
        article, rest = (sum(len(t) for t, y in left if y == z) for z in (2, 1))
        both = not article or rest >= max(200, 4 * article)
        out[i] = " ".join(t for t, z in left if z == 2 or z == 1 and both)
    return out


def test_extract_against_brute_force(spark):
    r = random.Random(3)
    words = lambda n: " ".join("".join(r.choices("abcdefg", k=4)) for _ in range(n))
    pool = {h: [words(r.randrange(1, 6)) for _ in range(6)] for h in range(3)}
    rows = []
    for i in range(150):
        h = r.randrange(3)
        menu = [x for x in pool[h] if r.random() < 0.8]
        half = len(menu) // 2
        own = [words(r.choice([1, 5, 40])) for _ in range(r.randrange(4))]
        body = "".join(f"<p>{x}</p>" for x in own)
        body = r.choice(["<article>{}</article>", "<div>{}</div>", "<main><p>Read on</p>{}<p>Share it</p></main>"]).format(body)
        page = "".join(f"<div>{x}</div>" for x in menu[:half]) + body + "".join(f"<div>{x}</div>" for x in menu[half:])
        rows.append((i, f"http://h{h}.example/{r.choice('abc')}/{r.randrange(10**6)}", page))
    want = brute(rows)
    got = {x.page_id: x.text for x in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want
    assert sum(want[i] != H.main_text(h) for i, _, h in rows) > 30  # the neighbour decides
