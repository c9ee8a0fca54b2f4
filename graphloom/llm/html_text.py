"""Main-text extraction: flat text blocks, classified by a decision tree.

A page is cut at block-level tags into flat blocks. Each has its word count and link density and those of two
neighbours on either side, and what its enclosing elements say (a menu, a footer, an article ...). A small decision tree,
trained on the labelled table below when the module is loaded, keeps or drops the block. On pages that mark neither the
article nor what isn't, word counts and link densities alone decide; where they can't tell, as with a paragraph of two
words and a menu entry without a link, the marks do.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import batch, map_batches, table

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)",
    re.S,
)
_CUE = re.compile(r"""(?:^|\s)(class|id|role|style|aria-hidden|hidden|itemprop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)

SKIPPED = frozenset("script style noscript template title textarea iframe object svg canvas select option button audio video head".split())
RAW = frozenset("script style noscript template title textarea iframe svg".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Elements, roles and words of class or id that mark what isn't the article, and those that mark the article.
ASIDE = frozenset("nav footer aside form menu dialog fieldset search".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog status menu menubar toolbar".split())
ASIDE_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising advertorial sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification
    alert popup modal overlay sidebar sidebars rail widget widgets related recommended recommendations trending popular share sharing social comment comments commentlist
    reply replies respond disqus discussion menu nav navbar navigation topnav subnav breadcrumb breadcrumbs crumbs footer foot colophon header masthead topbar toolbar
    newsletter subscribe subscription signup signin login register form search searchbox pager pagination paging copyright legal disclaimer tags tagcloud hidden skip
    feedback responses paywall survey""".split()
)
MAIN_WORDS = frozenset("article post entry story main content body text maincontent postbody articlebody prose".split())

#: Of the block, its neighbours and theirs; 0 beyond the page's ends. Then its marks; place: 2 in an article, 0 outside one
#: on a page that has one, 1 on a page without.
FEATURES = (
    "words", "links", "words_before", "links_before", "words_after", "links_after", "words_2_before", "links_2_before", "words_2_after", "links_2_after",
    "aside", "place", "heading",
)
#: Beyond so many words a block is long, however long.
LONG = 60


@dataclass
class Element:
    name: str
    aside: bool
    main: bool


@dataclass
class TextBlock:
    parts: list[str] = field(default_factory=list)
    linked: list[str] = field(default_factory=list)
    aside: bool = False
    main: bool = False
    heading: bool = False
    text: str = ""
    words: int = 0
    links: float = 0.0


def _cues(name: str, attrs: str, in_main: bool) -> tuple[bool, bool]:
    """Whether an element is aside from, or holds, the article."""
    aside, main = name in ASIDE or (name == "header" and not in_main), name in ("article", "main")
    if not attrs:
        return aside, main
    for m in _CUE.finditer(attrs):
        key, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            aside = True
        elif key == "role":
            aside, main = aside or value in ASIDE_ROLES, main or value in ("main", "article")
        elif key == "itemprop":
            main = main or value == "articlebody"
        elif key in ("class", "id") and name not in ("html", "body"):
            for word in value.split():
                bits = set(re.split(r"[^a-z0-9]+", word))
                if bits & ASIDE_WORDS and not (in_main and bits & {"header", "tags", "text"} and bits & MAIN_WORDS):
                    aside = True
                elif bits & MAIN_WORDS:
                    main = True
    return aside, main and not aside


def blocks(page: str) -> list[TextBlock]:
    """Flat text blocks in page order; those without a visible character are left out."""
    out: list[TextBlock] = []
    stack: list[Element] = []
    now, at, in_link = TextBlock(), 0, 0
    depth_aside = depth_main = 0

    def put(text: str) -> None:
        if text and not any(e.name in SKIPPED for e in stack):
            if not now.parts:
                now.aside, now.main = depth_aside > 0, depth_main > 0
                now.heading = any(re.fullmatch("h[1-6]", e.name) for e in stack)
            now.parts.append(text)
            if in_link:
                now.linked.append(text)

    def flush() -> None:
        nonlocal now
        now.text = " ".join(html.unescape("".join(now.parts)).split())
        if now.text:
            now.words = len(now.text.split(" "))
            now.links = min(1.0, len(html.unescape(" ".join(now.linked)).split()) / now.words)
            out.append(now)
        now = TextBlock()

    def pop(to: int) -> None:
        nonlocal depth_aside, depth_main, in_link
        for e in stack[to:]:
            depth_aside -= e.aside
            depth_main -= e.main
            in_link -= e.name == "a"
        del stack[to:]

    while m := _TAG.search(page, at):
        name = (m["name"] or m["name2"] or "").lower()
        put(page[at : m.start()])
        at = m.end()
        if m[0].startswith("<![CDATA["):
            put(html.escape(m[0][9:].removesuffix("]]>")))
        if not name:
            continue
        end, attrs = bool(m["end"] or m["end2"]), m["attrs"] or m["attrs2"] or ""
        if name not in INLINE:
            flush()
        if end:
            to = next((k for k in range(len(stack) - 1, -1, -1) if stack[k].name == name), None)
            if to is not None:
                pop(to)
        elif name in RAW:  # only its own end tag counts inside
            stop = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = stop.end() if stop else len(page)
        elif name not in VOID:
            closes = {name} if name in ("li", "dt", "dd", "tr", "td", "th", "option", "a") else {"p"} if name not in INLINE else set()
            if closes and (to := next((k for k in range(len(stack) - 1, -1, -1) if stack[k].name in closes), None)) is not None:
                if not any(e.name in ("ul", "ol", "dl", "table", "article", "section", "div", "td", "aside", "nav") for e in stack[to + 1 :]):
                    pop(to)
            aside, main = _cues(name, attrs, depth_main > 0)
            stack.append(Element(name, aside, main))
            depth_aside += aside
            depth_main += main
            in_link += name == "a"
    put(page[at:])
    flush()
    return out


def features(page: list[TextBlock]) -> np.ndarray:
    """A row of FEATURES for each block."""
    n = len(page)
    own = np.zeros((n + 4, 2))  # two blocks without words on either side
    own[2 : n + 2] = [(min(b.words, LONG), b.links) for b in page] if page else np.zeros((0, 2))
    without = not any(b.main and not b.aside for b in page)
    marks = np.array([(b.aside, 1 if without else 2 * b.main, b.heading) for b in page], float).reshape(n, 3)
    return np.hstack([own[2 : n + 2], own[1 : n + 1], own[3 : n + 3], own[:n], own[4:], marks])


#: Labelled pages, a block a word: + article text or - not; its marks (. none, a aside, m main, b both, h heading, H heading
#: in main); words; after a colon the share of them in links, in per cent, if there is any.
LABELLED = """
-.1:100 -.1:100 -.1:100 -.2:100 -.1:100 -.10 +h9 +.70 +.45 +.3 +.90 +.60 +.8 +.120 -.9
-.2:100 -.1:100 -.1:100 -.6 +h6 +.150 +.2 +.25 +.200 +.1 +.80 -.12
-.3:100 -.2:100 -.4:100 -.1:100 +h11 +.5 +.64 +.180 +.12 +.33 -.3:100 -.2:100 -.2:100 -.14
-.1:100 -.1:100 -.12 +h8 +.28 +.19 +.75 +.22 -.2:100 -.1:100
-.4 -.1:100 -.2:100 -.1:100 +h7 +.40:8 +.55:5 +.6:30 +.90:3 -.5:60 -.4:100 -.3:100 -.8:25
-.1:100 -.1:100 -.1:100 -.7 +h10 +.95 +.4 +.52 -.h4 -.6:100 -.7:100 -.5:100 -.6:100 -.11:20
-.2:100 -.2:100 +h5 +.31 +.17 +.26:4 +.21 +.140 -.13 -.3:100 -.2:100
-.5:80 -.6:70 +.210 +.180 +.95 -.7
-.1:100 -.3 -.2:100 -.8 +h12 +.36 +.7 +.48 +.2 +.39 -.6 -.4
-.9:90 -.12:85 -.20:80 -.15:90 -.30:70 -.8:100
-.2 -.1:100 -.4 -.1:100 -.3:100 -.2
-.1:100 -.2:100 -.11 +h8 +.20 +.24 +.16:10 +.30 -.35:70 -.28:80 -.9
+.300
+h4 +.44 +.3 +.66
-a1:100 -a1:100 -a2:100 -a9 +H9 +m80 +m45 +m2 +m120 +m1 +m8 -a9
-a1:100 -a1:100 -a1:100 -a12 +H7 +m1 +m3 +m6 +m2 -a10
-a1:100 -a2:100 -a8 +H11 +m15 +m4 +m9 +m60 +m1 -a7
-a1:100 -.3 -a14 +H6 +m30:10 +m5:40 +m90 +m3:100 +m50 -b4:100 -b3:100 -b40 -a18 -a55 -a70 -.9
-.1:100 -.2:100 -.20 +H8 +m200 +m12 +m3 -b2 -b25 -b60 -.35 -.80 -.5:50
-a1:100 -a1:100 +m300 -a40 -a30 -a9
-a2:100 -.1:100 -.4 +H10 +m40 +m22 +m18 +m75 -m2:100 -m4:100 -m3:100 -m5:100 -a6
-a1:100 -.90 -.12 +H9 +m1 +m70 -m3:100 -m4:100 -m4:100 -a30 -.60
-a1:100 -a1:100 -a2:100 +h8 +.50 +.3 +.70 +.16 +.4 +.33 -a25 -a80 -a9
-a9 -a2:100 -a30 +h12 +.90 +.60 +.2 +.45 -ah3 -a40 -a70 -a12 -a6:50
-a60 -a75 +h5 +.28 +.37 +.5 +.41 -a8
-a1:100 -a10 +H8 +m2 -a9
-a1:100 -a11 +H3 +m25 +m1 -a14
-a1:100 -a2:100 -a10 +H9 +m44 +m2 +m60 +m8 +m1 +m31 +m4 +m17 +m2 +m57 +m60 +m3 -a8
-a1:100 -a1:100 -a9 +H12 +m1 +m60 +m60 +m18 +m2 +m8 +m31 +m42 +m11 +m4 +m3 -a13
-.1:100 -.2:100 -.12 +H9 +m2 +m60 +m60 +m2 +m12 +m41 +m8 +m1 +m6 -.11
+H3 +m4 +m1 +m9 +m1
+m6 +m1 +m2
+m60 +m9 -m2:100 -m3:100 -m2:100 -a9
-a1:100 +H7 +m40 +m13 +m3:100 +m40 +m16 -m4:100 -m3:100
-.2:100 +m12 +m5 +m2:100 +m60 +m4 -.9
+.30
+.22
-.1:100 -.3:100 +h8 +.60 +.30 -.9
-.2:100 -.1:100 -.9 +h9 +.70 +.18 -.12
-.1:100 -.1:100 +h6 +.50 +.8 -.14
-.1:100 -.2:100 -.10 +h9 +.60 +.2 -.8
-.3:100 -.1:100 -.8 +h5 +.44 +.33 +.40 -.11
+h5 +.25
+H9 +m60 +m30 +m14
-.1:100 -.2:100 -.9 +H7 +m80 +m12
-a1:100 -a1:100 +m45 +m28 +m8
-.2:100 -.1:100 +H6 +m20 +m9 +m3
-.1:100 -.1:100 -.11 +m6 +m35 +m5
-a1:100 -.2:100 +m9 +m4 +m70 +m10 +m12
-.2:100 -.7 +m11 +m8 -.30 -.25 -.10
-.1:100 +m16 +m7 +m11 -.6 -.50
-a1:100 -a2:100 +H4 +m8 +m5 +m3 -.6 -.3
-.1:100 -.2 +m12 +m1 -m2:100 -m3:100 -.7
-.1:100 -.2 -.3:100 -.8 +H10 +m60 +m1 +m9 +m29 +m2 +m60 +m16 +m1 -.40 -.35 -.9:30
"""


def labelled() -> tuple[np.ndarray, np.ndarray]:
    x, y = [], []
    for line in LABELLED.split("\n"):
        page = []
        for keep, marks, words, links in re.findall(r"([+-])([.amhHb]+)(\d+)(?::(\d+))?", line):
            page.append(TextBlock(words=int(words), links=int(links or 0) / 100, aside=bool(set(marks) & set("ab")), main=bool(set(marks) & set("mbH")), heading=bool(set(marks) & set("hH"))))
            y.append(keep == "+")
        x.append(features(page))
    return np.concatenate(x), np.array(y, float)


class Tree:
    """Binary decision tree by Gini impurity; node: (feature, threshold, left, right) or a class."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 8):
        self.root = self._grow(x, y, depth)

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int):
        if depth == 0 or y.min() == y.max():
            return bool(y.mean() >= 0.5)
        best = None
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for cut in (values[:-1] + values[1:]) / 2:
                left = y[x[:, f] <= cut]
                right = y[x[:, f] > cut]
                impurity = sum(len(s) * s.mean() * (1 - s.mean()) for s in (left, right))
                if best is None or impurity < best[0] - 1e-12:
                    best = impurity, f, cut
        if best is None:
            return bool(y.mean() >= 0.5)
        _, f, cut = best
        go = x[:, f] <= cut
        return f, cut, self._grow(x[go], y[go], depth - 1), self._grow(x[~go], y[~go], depth - 1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), bool)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if isinstance(node, bool):
                out[rows] = node
            elif len(rows):
                f, cut, left, right = node
                go = x[rows, f] <= cut
                todo += [(left, rows[go]), (right, rows[~go])]
        return out


TREE = Tree(*labelled())


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    return " ".join(b.text for b, keep in zip(found, TREE.predict(features(found)), strict=True) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages, row by row without shuffle. A null or empty page, and a page
    without an article, has an empty text; repeated rows stay, page_id and url may be null."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        text = [main_text(p) for p in b.column(2).to_pylist()]
        return batch(page_id=b.column(0), url=b.column(1), text=pa.array(text, pa.string()), n_chars=pa.array(list(map(len, text)), pa.int64()))

    return map_batches(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")), run, "page_id long, url string, text string, n_chars long")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
