"""Operator 2, HTML extraction by removal of site templates.

First pass: every page is parsed to elements, and each subtree that holds text is hashed (tag, class,
words and children) together with its slot (its own and its parent's tag and class).  Spark counts per
host on how many pages each hash recurs.  Second pass: subtrees whose hash recurs across many pages of
their host are deleted, inside the article as outside of it; so are elements that say by tag, role or
a whole class name that they are no article.  What text is left of the article is cut into blocks.

What recurs is told from what was copied: pages are counted by what they are about (title, heading and
the beginnings of the three longest blocks), and a subtree that is mostly found on pages of one such kind is part of an
article with near copies.  Short texts recur by chance; they must also make up a share of their slot.
Running text (paragraphs, headings, list items) is quoted and repeated from article to article, at their
ends too, so it is only deleted with a container around it.
No threshold depends on how many pages a host has.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written
from .url_filter import host_and_path

#: A template is on pages of so many kinds, of which none has more than this share of those pages.
MIN_PAGES, MAX_OF_ONE = 4, 0.5
#: Texts of fewer words must also be this share of all that stands in their slot.
LONG_WORDS, MIN_OF_SLOT = 8, 0.04
#: So many templates of all hosts are broadcast at most, at eight bytes each; more are joined to their pages.
MAX_BROADCAST = 1_000_000

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)[^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
#: A slash that ends a tag, not the value of an attribute; it closes elements of drawings and formulas alone.
_EMPTY = re.compile(r"""(?:^|[\s"']|(?:^|\s)[a-zA-Z:-]+)/$""")
#: Numbers in class names tell pages apart, not kinds of elements.
_DIGITS = re.compile(r"\d+")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup.
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split()
)
_SPACED = frozenset("br td th option wbr img input".split())
#: Elements that a start tag of the key closes, up to the nearest of the second set.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
_NO_ARTICLE = frozenset("head script style noscript template nav footer aside form button select textarea iframe svg math canvas object audio video dialog menu search title map datalist".split())
#: Elements without any text of their own to read.
_UNSEEN = frozenset("head script style noscript template svg math canvas object audio video iframe title map datalist select".split())
_NEVER = frozenset("nav footer aside menu button textarea search".split())
_NO_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: A class or id says that an element is furniture if all its parts are of these two lists, and one of the first.
_FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disqus footer gdpr login masthead menu menubar modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted promotion recommended related replies respond share sharing sidebar signup sidenav skip skiplink skiplinks sponsor sponsored subscribe subscription subnav teaser teasers toolbar topbar topnav widget widgets".split()
)
_AFFIX = frozenset(
    "site page main top bottom left right post article entry global primary secondary header box bar block blocks button buttons container wrapper wrap inner outer section area list lists item items link links panel slot unit group row col form icon icons text title body content thread reader user social media email mobile desktop sticky fixed small large posts articles stories legal privacy policy bar".split()
)

#: Of those, what names lists of links; running text under such a name is text.
_OF_LINKS = frozenset("breadcrumb breadcrumbs pager pagination recommended related share sharing skip skiplink skiplinks teaser teasers".split())

#: Headings and running text, which no name deletes: theirs are anchors.
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dt dd tr figcaption summary".split())


class Element:
    __slots__ = ("tag", "parts", "hard", "named", "name", "inside", "foreign", "hash", "key", "size", "words", "linked", "running", "gone", "whole")

    def __init__(self, tag: str, hard: bool = False, named: str = "", name: str = "", inside: bool = False, foreign: bool = False):
        self.tag, self.hard, self.named, self.name, self.inside, self.foreign = tag, hard, named, name, inside, foreign
        self.parts: list = []  # texts and elements, in order
        self.hash = self.key = self.size = self.words = self.linked = self.running = 0
        self.gone = False
        self.whole = False  # it holds the article


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(raw)} if raw.strip(" /") else {}


def furniture_name(token: str) -> str:
    """Whether one class or id names furniture as a whole (``cookie-notice`` does, ``notice-period`` does not): ``any``, ``links`` or empty."""
    parts = {x.lower() for x in _NAME.findall(token)}
    if not parts & _FURNITURE or not parts <= _FURNITURE | _AFFIX:
        return ""
    return "links" if parts & _FURNITURE <= _OF_LINKS else "any"


def _unwanted(tag: str, a: dict[str, str], in_article: bool) -> tuple[bool, str]:
    """Whether an element says by tag, role or state that it is no article, and how it does by name."""
    hard = tag in _NO_ARTICLE or (tag == "header" and not in_article)
    if not a:
        return hard, ""
    hard = hard or "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "") or a.get("role") in _NO_ROLE
    tokens = f"{a.get('class', '')} {a.get('id', '')}".split()
    if tag in _PROSE:
        return hard, ""
    named = {"any" if not in_article and x.lower() in ("header", "site-header", "page-header") else furniture_name(x) for x in tokens}
    return hard, "any" if "any" in named else "links" if "links" in named else ""


def parse(html: str) -> Element:
    """The element tree of a page, end tags implied where they are missing."""
    root = Element("#")
    stack, open_tags = [root], Counter()
    at, n = 0, len(html)

    def cut(k: int) -> None:
        open_tags.subtract(x.tag for x in stack[k:])
        del stack[k:]

    while at < n:
        m = _TOKEN.search(html, at)
        if m is None:
            stack[-1].parts.append(html[at:])
            break
        if m.start() > at:
            stack[-1].parts.append(html[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1) if open_tags[tag] > 0 else ():
                if stack[k].tag == tag:
                    cut(k)
                    break
            continue
        if tag in _CLOSES:
            closed, bounds = _CLOSES[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in bounds:
                    break
                if stack[k].tag in closed:
                    cut(k)
                    break
        elif tag in _BLOCK:
            # A block ends an open paragraph.
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    cut(k)
                    break
                if stack[k].tag in _BLOCK:
                    break
        a = _attributes(m[3])
        up = stack[-1]
        inside = up.inside or tag in ("article", "main")
        foreign = up.foreign or tag in ("svg", "math")
        e = Element(tag, *_unwanted(tag, a, up.inside), a.get("class", ""), inside, foreign)
        up.parts.append(e)
        if tag in _RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])|\Z", re.I).search(html, at)
            if tag == "textarea" or tag == "title":
                e.parts.append(html[at : end.start()])
            close = html.find(">", end.start())
            at = n if close < 0 else close + 1
        elif tag not in _VOID and not (foreign and _EMPTY.search(m[3])):
            stack.append(e)
            open_tags[tag] += 1
    return root


def _walk(root: Element):
    """Elements, children before parents, without recursion."""
    order, todo = [], [root]
    while todo:
        e = todo.pop()
        order.append(e)
        todo += [p for p in e.parts if isinstance(p, Element)]
    return reversed(order)


def _by_name(e: Element) -> bool:
    """Whether an element's name deletes it: inside an article a name for links does not if most of it is running text."""
    return e.named == "any" or (e.named == "links" and not (e.inside and 2 * e.running > e.words))


def resolve(root: Element) -> Element:
    """Fills in hashes, text sizes, and which elements are gone; gives the page's article.

    An element that holds the article is not gone whatever its tag or name, nor is one that holds
    nearly all text, but for a few tags.  The article is the largest ``article`` or ``main`` that is
    not within furniture.
    """
    order = list(_walk(root))
    for e in order:
        parts, e.size, e.words, e.linked, e.running = [e.tag, _DIGITS.sub("", e.name)], 0, 0, 0, 0
        for p in e.parts:
            if isinstance(p, Element):
                parts.append(f"\0{p.hash:x}")
                if p.tag not in _UNSEEN:
                    e.size += p.size
                    e.words += p.words
                    e.linked += p.words if p.tag == "a" else p.linked
                    e.running += p.words - p.linked if p.tag in ("p", "blockquote", "pre") else p.running
            else:
                words = p.split()
                parts.append(" ".join(words))
                e.size += sum(map(len, words))
                e.words += len(words)
        e.hash = _hash("\1".join(parts))
    best, most = None, 0.9 * root.size
    todo = [(root, False)]
    while todo:
        e, within = todo.pop()
        within = within or ((e.hard or _by_name(e)) and (e.size < most or e.tag in _NEVER))
        if e.tag in ("article", "main") and not within and (best is None or e.size > best.size):
            best = e
        for p in reversed(e.parts):
            if isinstance(p, Element):
                todo.append((p, within))
    if best is not None:
        best.whole = True
    for e in order:  # children first
        e.whole = e.whole or any(p.whole for p in e.parts if isinstance(p, Element))
        slot_of = f"{e.tag}\1{_DIGITS.sub('', e.name)}"
        for p in e.parts:
            if isinstance(p, Element):
                p.key = _hash(f"{slot_of}\1{p.tag}\1{_DIGITS.sub('', p.name)}")  # the slot, until the next line
                p.gone = p.tag in _UNSEEN or ((p.hard or _by_name(p)) and not p.whole and (p.size < most or p.tag in _NEVER))
    return root


def _hash(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def template_key(e: Element, host: int) -> int:
    """What recurs: the subtree in its slot on its host."""
    return _signed(((e.hash * 0x9E3779B97F4A7C15 + e.key) * 0x9E3779B97F4A7C15 + host) & 0xFFFFFFFFFFFFFFFF)


def _candidate(e: Element) -> bool:
    """A block that may be deleted as a template."""
    return bool(e.words) and e.tag in _BLOCK and e.tag not in _PROSE and not e.whole and e.tag not in ("html", "body", "head", "#")


def candidates(html: str | None, host: str = "") -> tuple[int, list[tuple[int, int, int]]]:
    """What a page is about, and (key, slot, words) of each different subtree that may be a template."""
    root = resolve(parse(html or ""))
    found, titles, site = {}, {}, _hash(host)
    for e in _walk(root):
        if _candidate(e):
            found[template_key(e, site)] = (_signed(e.key), e.words)
        if e.tag in ("title", "h1"):
            titles[e.tag] = e  # the first one, as the walk goes backwards
    longest = sorted(_blocks(root, frozenset()), key=lambda b: (-len(b), b))[:3]
    about = [f"{e.hash:x}" for _, e in sorted(titles.items())] + [" ".join(b.split()[:6]) for b in longest]
    about = _hash("\1".join(about)) if about else root.hash
    return _signed(about), [(k, *v) for k, v in sorted(found.items())]


def main_root(root: Element) -> list[Element]:
    """Outermost ``main`` and ``article`` elements that are not gone; else the page."""
    found, todo = [], [root]
    while todo:
        e = todo.pop()
        if e.gone:
            continue
        if e.tag in ("article", "main"):
            found.append(e)
        else:
            todo += [p for p in reversed(e.parts) if isinstance(p, Element)]
    return found or [root]


def _blocks(root: Element, templates, host: int = 0) -> list[str]:
    """The blocks of a resolved page's article without what is gone and without templates."""
    blocks, now = [], []

    def close():
        text = " ".join("".join(now).split())
        if text:
            blocks.append(text)
        now.clear()

    for top in main_root(root):
        todo: list = [top]
        while todo:
            e = todo.pop()
            if e is None:
                close()
            elif isinstance(e, str):
                now.append(_html.unescape(e))  # a reference does not reach across a tag
            elif e is not top and (e.gone or (templates and _candidate(e) and template_key(e, host) in templates)):
                close() if e.tag in _BLOCK else now.append(" " if e.tag in _SPACED else "")
            else:
                if e.tag in _BLOCK or e is top:
                    close()
                    todo.append(None)
                elif e.tag in _SPACED:
                    now.append(" ")
                todo += reversed(e.parts)
        close()
    return blocks


def extract(html: str | None, templates=frozenset(), host: str = "") -> str:
    """The main text: blocks in page order, joined by two line feeds."""
    return "\n\n".join(_blocks(resolve(parse(html)), templates, _hash(host))) if html else ""


# Spark


_KEY = ("_host", "_a", "_b")


def _page_key(url: Column, html: Column) -> list[Column]:
    """Host and two hashes of the page, by which its templates find it again; equal pages share them."""
    return [host_and_path(url)[0].alias("_host"), F.xxhash64(html).alias("_a"), F.xxhash64(html, F.lit(1)).alias("_b")]


def page_subtrees(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(_host, _a, _b, about, key, slot, words)``: a row for each different subtree of each row of ``pages``."""

    names = ("key", "slot", "words")

    def run(texts: pa.Array, hosts: pa.Array) -> pa.Array:
        rows = [candidates(h, u) for h, u in zip(texts.to_pylist(), hosts.to_pylist())]
        each = [dict(zip(names, x)) for _, found in rows for x in found]
        edge = np.cumsum([0, *(len(found) for _, found in rows)]).astype(np.int32)
        kind = pa.struct([("key", pa.int64()), ("slot", pa.int64()), ("words", pa.int32())])
        return pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.ListArray.from_arrays(pa.array(edge), pa.array(each, kind))], names=["about", "found"])

    kind = "struct<about:long,found:array<struct<key:long,slot:long,words:int>>>"
    rows = pages.where(F.col(html_col).isNotNull()).select(*_page_key(F.col(url_col), F.col(html_col)), F.arrow_udf(run, kind)(F.col(html_col), host_and_path(F.col(url_col))[0]).alias("c"))
    return written(rows.select(*_KEY, "c.about", F.explode("c.found").alias("f")).select(*_KEY, "about", "f.*"), "subtrees")


def site_templates(subtrees: DataFrame, min_pages: int = MIN_PAGES, max_of_one: float = MAX_OF_ONE, long_words: int = LONG_WORDS, min_of_slot: float = MIN_OF_SLOT) -> DataFrame:
    """``(_host, key)`` of the templates among ``page_subtrees``.

    Counted over different pages, first per kind of page and then per host, so that a host with very
    many pages is summed in parts.
    """
    of = ["_host", "key", "slot", "words"]
    per = subtrees.distinct().groupBy(*of, "about").agg(F.count("*").alias("n"))
    counts = per.groupBy(*of).agg(F.count("*").alias("kinds"), F.sum("n").alias("n"), F.max("n").alias("most"))
    slots = counts.groupBy("_host", "slot").agg(F.sum("n").alias("all"))
    often = counts.where((F.col("kinds") >= min_pages) & (F.col("most") <= F.lit(max_of_one) * F.col("n")))
    judged = often.join(slots, ["_host", "slot"]).where((F.col("words") >= long_words) | (F.col("n") >= F.lit(min_of_slot) * F.col("all")))
    return judged.select("_host", "key")


def _extract(all_templates=None):
    """Text and number of templates of a page: of those that are broadcast, or of the keys in its row."""

    def run(texts: pa.Array, hosts: pa.Array, keys: pa.Array) -> pa.Array:
        known = all_templates.value if all_templates else None
        out, n = [], []
        for html, host, own in zip(texts.to_pylist(), hosts.to_pylist(), keys.to_pylist()):
            root = resolve(parse(html or ""))
            site = _hash(host)
            mine = own or ()
            if known is not None:
                asked = np.array([template_key(e, site) for e in _walk(root) if _candidate(e)], np.int64)
                at = np.minimum(np.searchsorted(known, asked), max(len(known) - 1, 0))
                mine = asked[known[at] == asked].tolist() if len(known) else ()
            mine = frozenset(mine)
            out.append("\n\n".join(_blocks(root, mine, site)))
            n.append(len(mine))
        return pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(n, pa.int32())], names=["text", "n"])

    return F.arrow_udf(run, "struct<text:string,n:int>")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", max_broadcast: int = MAX_BROADCAST, **options) -> DataFrame:
    """``(id_col, url_col, text, n_chars, n_templates)``, one row per row of ``pages``.

    ``n_templates`` is how many recurring subtrees of its host a page has.  A null or empty page has an
    empty text; a page with a null URL, or one without ``://``, belongs to the host with the empty
    name; null and repeated ids keep a row each, and repeated rows count once as pages; further columns
    are not read; an empty table gives none.  Pages are parsed whole, one at a time.  Broken markup is
    read as browsers do, roughly: missing end tags are implied, stray ones ignored.
    """
    subtrees = page_subtrees(pages, url_col, html_col)
    templates = written(site_templates(subtrees, **options).select("key").distinct(), "templates")
    rows = pages.select(F.col(id_col), F.col(url_col), F.col(html_col).alias("_html"), *_page_key(F.col(url_col), F.col(html_col)))
    if templates.count() <= max_broadcast:
        known = np.sort(np.array([r[0] for r in templates.collect()], np.int64))
        made = rows.select(id_col, url_col, _extract(pages.sparkSession.sparkContext.broadcast(known))(F.col("_html"), F.col("_host"), F.lit(None).cast("array<long>")).alias("_t"))
    else:
        hits = written(subtrees.distinct().join(templates, "key").groupBy(*_KEY).agg(F.collect_set("key").alias("_keys")), "template-hits")
        made = rows.join(hits, list(_KEY), "left").select(id_col, url_col, _extract()(F.col("_html"), F.col("_host"), F.col("_keys")).alias("_t"))
    return made.select(id_col, url_col, "_t.text", F.length("_t.text").cast("long").alias("n_chars"), F.col("_t.n").alias("n_templates"))
