"""Operators 2 and 6 against plain versions, and on awkward rows."""

import html
import random
import re
import time

import pytest

from isospark.llm import html_templates as H
from isospark.llm import license_scan as L
from isospark.llm import queries

SF = "/root/testdata/sf0.01"


def pages_of(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows], "page_id long, url string, html string, text string, host string")


def plain_article(page):
    """The text of the given pages, whose markup is regular."""
    inner = re.search(r"(?s)<article>(.*)</article>", page)[1]
    parts = [re.sub(r"<[^>]*>", " " if "<br>" in b else "", b) for b in re.split(r"</?(?:p|h1)>", inner)]
    return "\n\n".join(x for x in (" ".join(html.unescape(b).split()) for b in parts) if x)


def test_query(spark):
    want = {r.page_id: plain_article(r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = queries.op2_html_templates(spark, SF)
    assert got.columns[:4] == ["page_id", "url", "text", "n_chars"]
    rows = got.collect()
    assert {r.page_id: r.text for r in rows} == want and all(r.n_chars == len(r.text) for r in rows)


PAGE = """<!DOCTYPE html><html><head><title>T &lt;</title><style>p{}</style><script>var a="</p><p>x";</script></head>
<body><header class=top>Site</header><nav><ul><li><a href=/a>A<li>B</ul></nav><div id="cookie-notice">We use cookies</div>
<div class="sidebar-left"><p>Side</div><main><article class="post"><header><h1>Tit&eacute;l</h1></header>
<p>One &amp; <b>two<br>three</b>\n  four<p>Five<div class="ad">Buy</div><ul><li>six<li>seven</ul><!-- no <p>comment</p> -->
<aside>See also</aside><form><input name=q><button>Go</button></form><table><tr><td>a<td>b<tr><td>c</table><pre>x  y</pre></article>
<section id="comments"><article class="comment"><p>First!</p></article></section></main><footer>&copy;</footer></body></html>"""


def test_extract():
    assert H.extract(PAGE) == "Titél\n\nOne & two three four\n\nFive\n\nsix\n\nseven\n\na b\n\nc\n\nx y"
    for empty in (None, "", " ", "<p>", "<", "<script>never closed", "<!-- never closed"):
        assert H.extract(empty) in ("", "<")
    assert H.extract("no markup &#233; at all") == "no markup é at all"
    assert H.extract("<p>a</b></div></p>b<p>c") == "a\n\nb\n\nc"
    assert H.extract("<div>" * 3000 + "deep") == "deep"
    assert H.extract('<p>x<a title="1 > 0">y</a> <img src="q>z') == "xy z"
    assert H.extract("<x " * 20_000) == ""


@pytest.mark.parametrize("most", [H.MAX_BROADCAST, 0])
def test_templates(spark, most):
    rows = []
    for i in range(30):
        box = "<div><p>Call us now</p><ul><li>news</li></ul></div>" if i % 2 else ""
        rows.append((i, f"http://a.example/{i}", f"<body>{box}<div><p>Own text {i}</p></div><div><p>end {i % 3}</p></div></body>"))
    rows += [(100 + i, "http://b.example/", "<body><div><p>Copied</p></div></body>") for i in range(30)]
    rows += [(200, None, None), (201, "", ""), (None, "http://a.example/z", rows[1][2]), (1, "http://a.example/1", rows[1][2])]
    out = H.main_text(pages_of(spark, rows), min_pages=10, max_broadcast=most)
    got = {}
    for r in out.collect():
        got.setdefault(r.page_id, set()).add(r.text)
    assert out.count() == len(rows)
    for i in range(30):
        # "end" recurs on ten different pages for each i % 3, as the box does on fifteen.
        assert got[i] == {f"Own text {i}"}
    assert got[100] == {"Copied"} and got[200] == got[201] == {""} and got[None] == got[1]
    assert H.main_text(pages_of(spark, [])).count() == 0


def test_names_are_whole():
    for kept in ("ad-free", "share-price", "notice-period", "has-comments", "no-sidebar", "content-with-sidebar", "elementor-widget-text-editor", "comment-on-budget", "post", "entry-content", "text"):
        assert H.extract(f'<main>A<div class="{kept}">kept</div></main>') == "A\n\nkept", kept
        assert H.extract(f'<article class="post {kept}" id="{kept}">kept</article>') == "kept"
    for gone in ("ad", "ads", "cookie-notice", "site-footer", "adBox", "ad-container-3", "comment-list", "share-buttons", "related-posts", "newsletter_signup", "sidebar-left"):
        assert H.extract(f'<main>A<div class="x {gone}">gone</div></main>') == "A", gone
    # An element that holds the article stays; text of main outside of it does, too.
    assert H.extract('<div class="widget"><form><main><p>a</p><article>b</article><p>c</p></main></form></div>') == "a\n\nb\n\nc"
    assert H.extract('<nav>' + "menu " * 50 + '</nav><div><p>short</p></div>') == "short"


def sites(rng):
    """Pages of sites whose furniture has neutral names and stands in the article: (url, html, main text, recurring)."""
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7)))
    prose = lambda: " ".join(word() for _ in range(rng.randint(15, 40)))
    rows = []
    for host in range(6):
        before = f"<div class=c{host}><p>{prose()}</p><ul><li>{word()}</li><li>{word()}</li></ul></div>"
        after = f"<section><p>{word()} {word()}</p></section><div><p>{prose()}</p></div>"
        for k in range(12 + 5 * host):
            own = [prose() for _ in range(3)]
            rows.append((f"http://h{host}.example/{k}", f"<html><body><article><h1>{own[0]}</h1>{before}<p>{own[1]}</p><p>{own[2]}</p>{after}</article></body></html>", "\n\n".join(own)))
        # An article that was copied with a word changed here and there is no furniture.
        base = [prose() for _ in range(5)]
        for k in range(12):
            mine = [b.split() for b in base]
            b = rng.choice(mine)
            b[rng.randrange(len(b))] = word()
            mine = [" ".join(b) for b in mine]
            rows.append((f"http://h{host}.example/c{k}", "<article>" + "".join(f"<p>{b}</p>" for b in mine) + "</article>", "\n\n".join(mine)))
        # Passages that articles share are no furniture, wherever they stand.
        shared = prose()
        for k in range(40):
            mine = [prose() for _ in range(rng.randint(3, 9))]
            mine.insert(rng.randint(0, len(mine)), shared)
            rows.append((f"http://h{host}.example/q{k}", "<article>" + "".join(f"<p>{b}</p>" for b in mine) + "</article>", "\n\n".join(mine)))
        # Short texts recur by chance.
        for k in range(60):
            mine = [prose(), prose(), *[rng.choice(["Of it.", "The end."] + [word() for _ in range(60)]) for _ in range(2)]]
            rows.append((f"http://h{host}.example/s{k}", "<article>" + "".join(f"<section>{b}</section>" for b in mine) + "</article>", "\n\n".join(mine)))
    return rows


def test_templates_decide_against_a_plain_count(spark):
    rows = sites(random.Random(5))
    out = {r.page_id: r for r in H.main_text(pages_of(spark, [(i, u, h) for i, (u, h, _) in enumerate(rows)])).collect()}
    assert {i: r.text for i, r in out.items()} == {i: t for i, (_, _, t) in enumerate(rows)}
    changed = {i for i, (_, h, t) in enumerate(rows) if H.extract(h) != t}
    assert changed == {i for i, r in out.items() if r.n_templates} and len(changed) == sum(12 + 5 * k for k in range(6))
    # The same templates by plain counting.
    seen, slots = {}, {}
    for u, h in {(u.split("/")[2], h) for u, h, _ in rows}:
        about, found = H.candidates(h, u)
        for key, slot, n in found:
            seen.setdefault((u, key, slot, n), []).append(about)
            slots[u, slot] = slots.get((u, slot), 0) + 1
    want = set()
    for (u, key, slot, n), pages in seen.items():
        if len(set(pages)) >= H.MIN_PAGES and max(map(pages.count, pages)) <= H.MAX_OF_ONE * len(pages) and (n >= H.LONG_WORDS or len(pages) >= H.MIN_OF_SLOT * slots[u, slot]):
            want.add((u, key))
    pages = pages_of(spark, [(i, u, h) for i, (u, h, _) in enumerate(rows)])
    assert {tuple(r) for r in H.site_templates(H.page_subtrees(pages)).collect()} == want and want


# 6


def plain_align(doc, template):
    """Local alignment without a band, cell by cell."""
    best, h = (0, 0, 0, 0), {}
    for i, c in enumerate(template):
        for j, d in enumerate(doc):
            s, m, start = h.get((i - 1, j - 1), (0, 0, j))
            cell = (s + (L.MATCH if c == d else L.MISMATCH), m + (c == d), start)
            for x in (h.get((i - 1, j)), h.get((i, j - 1))):
                if x and x[0] + L.GAP > cell[0]:
                    cell = (x[0] + L.GAP, x[1], x[2])
            if cell[0] > 0:
                h[i, j] = cell
                if cell[0] > best[0] or (cell[0] == best[0] and j + 1 < best[3]):
                    best = (cell[0], cell[1], cell[2], j + 1)
    return best


def test_banded_alignment():
    rng = random.Random(0)
    for _ in range(60):
        t = [rng.randint(1, 40) for _ in range(25)]
        d = t[:]
        for _ in range(3):
            k = rng.randrange(len(d))
            d[k : k + rng.randint(0, 1)] = [rng.randint(1, 40)] * rng.randint(0, 2)
        d = [50 + x for x in range(5)] + d + [60]
        assert L.align(d, t, 5 - 8, 5 + 8) == plain_align(d, t)


def test_winnowing_guarantee():
    rng = random.Random(1)
    for _ in range(200):
        h = [rng.randint(0, 5) for _ in range(rng.randint(1, 30))]
        kept = L.winnow(h)
        assert all(any(a <= k < a + L.WINDOW for k in kept) for a in range(max(1, len(h) - L.WINDOW + 1)))


def test_license_query(spark):
    rows = queries.op6_license_scan(spark, SF).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    lines = {k: v for k, v in L.NOTICES if k.endswith("-line")}
    want = sorted((i, k, m.start()) for i, t in docs.items() for k, v in lines.items() for m in re.finditer(re.escape(v.rstrip(".")), t))
    assert sorted((r.doc_id, r.license, r.start_char) for r in rows if r.coverage == 1.0 and r.license in lines) == want
    for r in rows:
        found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", docs[r.doc_id][r.start_char : r.end_char].lower())
        assert len(found) == r.end_word - r.start_word


def test_license_scan(spark):
    grant = dict(L.license_texts())["isc"].split("\n\n")[0]
    w = grant.split()
    changed = " ".join(w[:10] + ["really"] + w[10:20] + w[22:])
    texts = ["é " * 50 + grant + " tail", changed, grant + " x y z. " + grant, None, "", "nothing here", "short Text", "a퟿ " * 5000 + changed]
    docs = spark.createDataFrame([(None if i == 2 else i, t, "q") for i, t in enumerate(texts)], "doc_id long, text string, license string")
    table = spark.createDataFrame([("isc-grant", grant), ("two", "short text"), ("none", None), ("empty", "..")], "license string, text string")
    for words in (L.BLOCK_WORDS, 3):
        rows = L.scan(docs, table, block_words=words).collect()
        by = {}
        for r in rows:
            by.setdefault((r.doc_id, r.license), []).append(r)
        assert set(by) == {(0, "isc-grant"), (1, "isc-grant"), (None, "isc-grant"), (6, "two"), (7, "isc-grant")}
        (r,) = by[0, "isc-grant"]
        assert (r.coverage, texts[0][r.start_char : r.end_char]) == (1.0, grant.rstrip("."))
        assert len(by[None, "isc-grant"]) == 2 and all(x.coverage == 1.0 for x in by[None, "isc-grant"])
        n = r.matched
        assert by[1, "isc-grant"][0].matched == by[7, "isc-grant"][0].matched == n - 2
    assert L.scan(docs.limit(0), table).count() == 0 and L.scan(docs, table.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_short_templates(n):
    t = " ".join(f"w{i}" for i in range(n)).encode()
    assert [r[:5] for r in L.scan_text(b"a b " + t + b" c", L.Index([("t", t)]))] == [("t", n, 1.0, 2, 2 + n)]


def plain_scan(doc, template):
    """Best local alignment of the whole text, then of what is before and after it, without band or index."""
    score, matched, start, end = plain_align(doc, template)
    if not score:
        return set()
    here = {(matched, start, end)} if matched >= L.MIN_COVERAGE * len(template) else set()
    before, after = plain_scan(doc[:start], template), plain_scan(doc[end:], template)
    return here | before | {(m, s + end, e + end) for m, s, e in after}


def test_scan_against_all_places():
    """Copies next to each other, repeated, and with words changed, against a scan without an index."""
    rng = random.Random(3)
    word = lambda k: f"w{rng.randrange(k)}"
    for _ in range(40):
        templates = [[f"t{t}x{rng.randrange(400)}" for _ in range(n)] for t, n in enumerate((2, 5, 11, 40))]
        text = []
        for _ in range(rng.randint(1, 6)):
            t = list(rng.choice(templates))
            for _ in range(len(t) // 12):
                t[rng.randrange(len(t))] = word(9)
            text += t * rng.choice([1, 1, 2, 4]) + [word(9) for _ in range(rng.choice([0, 0, 3, 20]))]
        names = [(f"t{i}", " ".join(t).encode()) for i, t in enumerate(templates)]
        got = {(r[0], r[1], r[3], r[4]) for r in L.scan_text(" ".join(text).encode(), L.Index(names))}
        want = {(f"t{i}", *m) for i, t in enumerate(templates) for m in plain_scan(text, t)}
        assert got == want


def test_adjacent_lines_and_whole_texts():
    index = L.Index([(n, t.encode()) for n, t in L.license_texts()])
    line = b"Released under the MIT License. "
    for k in (1, 2, 3, 40):
        assert [r[:5] for r in L.scan_text(b"x " + line * k, index)] == [("mit-line", 5, 1.0, 1 + 5 * i, 6 + 5 * i) for i in range(k)]
    for name, text in L.license_texts():
        found = {r[0]: r[2] for r in L.scan_text(f"Some words before. {text} And after.".encode(), index)}
        assert found[name] == 1.0, name


def test_slashes_headings_and_references():
    """Probes: a slash in an attribute, ids of headings, prose under the name of a list of links, references cut by tags."""
    x = H.extract
    assert x("<body><nav>menu</nav><article data-url=/a/b/><h1>Title</h1><p>Text</article>") == "Title\n\nText"
    assert x("<main data-u=/x/><p>One</p></main><footer>end</footer>") == "One"
    assert x("<article><div/><p>In a div</p></article><aside>no</aside>") == "In a div"
    assert x('<article><p>a</p><svg><path d="m"/><use href=/a/b/></use><text>t</text></svg><p>b</p></article>') == "a\n\nb"
    assert x('<article><h2 id="copyright">Copyright</h2><p>Law</p><h2 id="comments">Comments on style</h2><p id="footer">Feet</p></article>') == "Copyright\n\nLaw\n\nComments on style\n\nFeet"
    assert x('<article><div class="related-items"><p>Related items of the museum collection</p></div><p>End</p></article>') == "Related items of the museum collection\n\nEnd"
    assert x('<article><p>Text</p><div class="related-items"><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></div></article>') == "Text"
    assert x('<article><p>Text</p><section id="comments"><h2>2 comments</h2><p>Nice</p></section><div class="ad">Buy</div></article>') == "Text"
    assert x("<article><p>&<b>lt;</b> &lt;b&gt; &amp;amp; R&amp;D</p></article>") == "&lt; <b> &amp; R&D"


def test_stray_end_tags_cost_nothing():
    page = "<article>" + "<div>" * 20_000 + "text" + "</b>" * 20_000
    began = time.process_time()
    assert H.extract(page) == "text"
    assert time.process_time() - began < 10
