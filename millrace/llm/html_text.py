"""Main text of HTML pages from flat text blocks.

A page becomes a flat list of text blocks (block-level tags separate them, inline tags do not).
Each block is described by its own, its predecessor's and its successor's word count and link
density, and by whether it is a heading, stands in a part meant for the main text, in a part whose tag
or class names something else, or in one with a class name that says little. A decision tree (Gini,
trained in numpy) on those numbers decides which blocks are main text; it learns from the small
labelled table below, hand-labelled pages with and without such parts and with misleading names.

A name is evidence about an element's own blocks only: it counts for nothing on html, body, main and
article, on elements around a main or article element, and, where a page has neither, on elements that
hold most of the page's words.

Scripts, styles, titles, comments and form controls never give blocks. Character references are
decoded, white space inside a block becomes one space, blocks are joined by a line feed.

Defined results: pages of any length are read whole; ids and other columns are not looked at; NULL or empty html, or a page without main text: empty text; broken markup is read
as far as it goes (unclosed tags end with the block or the page); repeated rows give equal results.
"""

from __future__ import annotations

import html as _html
import re
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import read_table, register

_PIECES = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<svg\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+(?<=/)>"
    r"|<(script|style|title|noscript|template|svg|select|textarea|button|iframe|object)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[!?/][^>]*>?"
    r"|[^<]+|<", re.S | re.I)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")

# Tags and class words of HTML pages.
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure "
                       "footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td "
                       "tfoot th thead tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
OTHER_TAGS = frozenset("nav aside footer form menu dialog fieldset".split())
MAIN_TAGS = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
OTHER_WORDS = frozenset("ad ads advert advertisement advertising breadcrumb breadcrumbs comment comments consent cookie cookies "
                        "disclaimer disqus footer gdpr login menu modal nav navbar navigation newsletter notice "
                        "pagination popup promo promoted promotion related reply replies respond share sharing sidebar signup social "
                        "sponsor sponsored subscribe".split())
LAYOUT_WORDS = frozenset("banner header masthead toolbar widget widgets".split())
MAIN_WORDS = frozenset("article content entry main post story text".split())
WHOLE_TAGS = frozenset("html body main article".split())

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "heading", "main", "other", "layout")
#: share of a page's words beyond which an element's names say nothing
MOST_WORDS = 0.8


class Block(NamedTuple):
    text: str
    words: int
    links: float
    heading: bool
    main: bool
    other: bool
    layout: bool


class _Element(NamedTuple):
    tag: str
    heading: bool = False
    main: bool = False
    marks: tuple[int, ...] = ()      # of this element and those around it


def blocks(page: str) -> list[Block]:
    """The text blocks of a page, in order."""
    found: list[tuple[str, int, float, _Element]] = []
    text: list[str] = []
    linked: list[str] = []
    stack: list[_Element] = []
    kinds: list[str] = []            # of each mark: tag, other or layout
    whole: set[int] = set()          # marks of elements around a main part
    in_link, has_main = False, False

    def close() -> None:
        words = "".join(text).split()
        if words:
            density = min(1.0, sum(len(x.split()) for x in linked) / len(words))
            found.append((" ".join(words), len(words), density, stack[-1] if stack else _Element("")))
        text.clear()
        linked.clear()

    for m in _PIECES.finditer(page):
        tag = m.group(3)
        if tag is None:
            piece = m.group(0)
            if piece[0] != "<" or piece == "<":
                piece = _html.unescape(piece)
                text.append(piece)
                if in_link:
                    linked.append(piece)
            continue
        tag = tag.lower()
        if tag == "a":
            in_link = not m.group(2)
        elif tag == "br":
            text.append(" ")
        elif tag in BLOCK_TAGS:
            close()
            if m.group(2):
                in_link = False
                if any(t.tag == tag for t in stack):
                    while stack.pop().tag != tag:
                        pass
            elif tag not in VOID_TAGS:
                while stack and (stack[-1].tag == "p" or stack[-1].tag == tag in ("li", "dt", "dd", "tr", "td", "th")):
                    stack.pop()
                above = stack[-1] if stack else _Element("")
                attributes = m.group(4).lower()
                names = {w for x in _NAMES.findall(attributes) for w in _SPLIT.split("".join(x))} if "=" in attributes else set()
                if tag in MAIN_TAGS:
                    has_main = True
                    whole.update(above.marks)
                marks = above.marks
                if tag not in WHOLE_TAGS:
                    new = ["tag"] * (tag in OTHER_TAGS - {"form"} or tag == "header" and not above.main)
                    new += ["other"] * (tag == "form" or bool(names & OTHER_WORDS)) + ["layout"] * bool(names & LAYOUT_WORDS)
                    marks += tuple(range(len(kinds), len(kinds) + len(new)))
                    kinds += new
                stack.append(_Element(tag, above.heading or tag in HEADINGS, above.main or tag in MAIN_TAGS or bool(names & MAIN_WORDS), marks))
    close()
    if not has_main:
        held = [0] * len(kinds)
        for _, n, _, e in found:
            for k in e.marks:
                held[k] += n
        most = MOST_WORDS * sum(f[1] for f in found)
        whole = {k for k, n in enumerate(held) if kinds[k] != "tag" and n > most}
    out = []
    for words, n, density, e in found:
        left = {kinds[k] for k in e.marks if k not in whole}
        out.append(Block(words, n, density, e.heading, e.main, bool(left & {"tag", "other"}), "layout" in left))
    return out


def features(page_blocks: list[Block]) -> np.ndarray:
    """A row of FEATURES per block."""
    if not page_blocks:
        return np.zeros((0, len(FEATURES)))
    own = np.array([b[1:3] for b in page_blocks], float)
    none = np.zeros((1, 2))
    return np.hstack([own, np.vstack([none, own[:-1]]), np.vstack([own[1:], none]),
                      np.array([b[3:] for b in page_blocks], float)])


class Tree:
    """A binary decision tree for 0/1 labels, split by Gini impurity."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 12):
        self.root = self._grow(x, y, depth)

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int):
        if depth == 0 or len(set(y.tolist())) < 2:
            return int(2 * y.sum() > len(y))
        best = None
        for k in range(x.shape[1]):
            order = np.argsort(x[:, k], kind="stable")
            v, ones = x[order, k], np.cumsum(y[order])
            at = np.flatnonzero(v[1:] > v[:-1])
            if len(at):
                left = at + 1
                p, q = ones[at] / left, (ones[-1] - ones[at]) / (len(y) - left)
                cost = left * p * (1 - p) + (len(y) - left) * q * (1 - q)
                i = int(cost.argmin())
                if best is None or cost[i] < best[0] - 1e-12:
                    best = (cost[i], k, (v[at[i]] + v[at[i] + 1]) / 2)
        if best is None:
            return int(2 * y.sum() > len(y))
        _, k, t = best
        low = x[:, k] <= t
        return k, float(t), self._grow(x[low], y[low], depth - 1), self._grow(x[~low], y[~low], depth - 1)

    def used(self) -> set[str]:
        """Names of the features that the tree asks for."""
        out, todo = set(), [self.root]
        while todo:
            node = todo.pop()
            if not isinstance(node, int):
                out.add(FEATURES[node[0]])
                todo += node[2:]
        return out

    def predict(self, x: np.ndarray) -> list[int]:
        out = []
        for row in x.tolist():
            node = self.root
            while not isinstance(node, int):
                k, t, low, high = node
                node = low if row[k] <= t else high
            out.append(node)
        return out


# The labelled table, as pages and a label per block in page order (1: main text).
_LONG = ("It was late in the year when the first boats came back, and most of the town had gone down to the water to see "
         "them, though nobody could say who had sent for them or why they had stayed away. ")
_MID = "The council met twice that week and put the matter off both times. "
_MENU = "<ul><li><a href=/>Home</a><li><a href=/n>News</a><li><a href=/s>Sport</a><li><a href=/c>Contact us</a></ul>"
_HEADLINES = ("<ul><li><a href=/1>Council puts the harbour plan off for a second time this week</a>"
              "<li><a href=/2>Why the ferry to the islands will not run before the end of May</a>"
              "<li><a href=/3>Three boats found empty on the north shore after the storm</a></ul>")


def _article(tag: str, lengths: tuple[int, ...], below: str) -> tuple[str, str]:
    """A page whose article has paragraphs of so many words, after a menu and an advert; what is below is one block."""
    some = (_LONG * 9).split()
    paragraphs = "".join(f"<p>{' '.join(some[k:k + n])}</p>" for k, n in enumerate(lengths))
    page = f"<nav>{_MENU}</nav><div class=ad>{_MID}</div><{tag}><h1>{' '.join(some[5:5 + lengths[0]])}</h1>{paragraphs}</{tag}>{below}"
    return page, "00000" + "1" * (1 + len(lengths)) + "0"


LABELLED = (
    _article("article", (3, 7, 12, 2, 30, 5, 1), f"<footer>{_MID}</footer>"),
    _article("main", (9, 1, 28, 4, 22, 90, 8, 8, 26, 3), "<footer>Example town</footer>"),
    _article("article", (24, 24, 6, 60, 19, 27, 33, 2), f"<footer>{_LONG}</footer>"),
    _article("article", (2, 2), f"<div class=notice>{_LONG}</div>"),
    _article("article", (14, 25, 25, 1, 1, 25, 40), "<footer><a href=/t>Terms</a></footer>"),
    _article("article", (26,), f"<aside>{_MID}</aside>"),
    (f"<nav>{_MENU}</nav><div class=ad>Buy two lamps and get one for nothing at all today.</div><article><h1>Boats return</h1>"
     f"<p>{_LONG}</p><p>{_MID}</p><p>Nobody came.</p><p>{_LONG * 3}</p></article><footer>&copy; example.com</footer>", "0000011111" + "0"),
    (f"<header><h1>The Daily Page</h1>{_MENU}</header><article><header><h1>Boats return</h1></header><p>Why?</p><p>{_MID}"
     f"<a href=/x>See the list</a>.</p><aside>{_MID}</aside><p>{_LONG}</p><div class=comments><p>{_LONG}</p><p>First!</p></div>"
     f"</article><footer><p>{_LONG}</p><a href=/t>Terms</a></footer>", "00000" + "111" + "0" + "1" + "00" + "00"),
    (f"<div id=menu>{_MENU}</div><div id=content><h2>Rain</h2><p>{_MID}</p><ul><li>{_MID}<li>Two boats.</ul><table><tr><td>3"
     f"<td>{_MID}</table></div><div class=sidebar><h3>Popular</h3><p>{_MID}</p></div><div class='cookie notice'>{_LONG}</div>", "0000" + "111111" + "000"),
    (f"<p><a href=/>Home</a> | <a href=/b>Back</a></p><p>{_LONG}</p><p>{_LONG * 2}</p><p>{_MID}</p><p>Yes.</p><p>{_LONG}</p>"
     "<p><a href=/1>1</a> <a href=/2>2</a> <a href=/3>Next page</a></p>", "0111110"),
    (f"<div><a href=/>Home</a></div><div><a href=/a>About</a></div><div>{_LONG}</div><div>{_LONG}</div><div>Terms of use</div>"
     "<div>All rights reserved</div>", "001100"),
    (f"<main><h1>Notes</h1><p>{_MID}</p><form>Your name and your message to us</form><p>Ask <a href=/m>the office</a> for the list of all names.</p>"
     f"<p><a href=/more>Read the whole report on the boats</a></p></main><form><p>{_LONG}</p></form>", "11011" + "0"),
    (f"<article><p>{_LONG}</p><p>One.</p><p>{_LONG}</p><div class=share><a href=/f>Share</a></div><div class=related>{_MID}</div>"
     f"<p>{_MID}</p></article><p>{_MID}</p><p>Copyright</p>", "111" + "00" + "1" + "00"),
    (f"<article><h1>A very short one</h1><p>End.</p></article><nav><p>{_LONG}</p></nav>", "110"),
    ("<p>Page not found</p>", "0"), ("<div>Loading</div><div><a href=/>Back to the start</a></div>", "00"),
    (f"<article>{_MID}</article>", "1"), ("<article><p>No.</p></article>", "1"), (f"<p>{_LONG}</p>", "1"),
    # lists of links are no text, wherever they stand; a heading goes with what follows it
    (f"<article><h1>Boats return</h1><p>{_LONG}</p><p>{_MID}</p><h2>More on the boats from our own pages</h2>{_HEADLINES}</article>", "111" + "0000"),
    (f"<article><p>{_LONG}</p>{_MENU}<p>{_MID}</p><h3>Rain</h3><p>{_MID}</p></article>", "1" + "0000" + "111"),
    (f"<div class=post><h2>More on the boats from our own pages</h2>{_HEADLINES}</div><div><h2>Boats return</h2><p>{_LONG}</p><p>{_MID}</p>"
     f"<h3>Rain came at night</h3><p>{_MID}</p><p>{_LONG}</p></div><div><h3>What others read today on these pages</h3>{_HEADLINES}</div>", "0000" + "111111" + "0000"),
    (f"<div>{_HEADLINES}</div><div><p>Read this first of all the things on the page.</p>{_HEADLINES}</div><div><p>{_LONG}</p><p>Not yet.</p><p>{_LONG}</p></div>",
     "000" + "0000" + "111"),
    # names of layout say little; those that hold the whole text say nothing
    (f"<div class=widget><p>{_LONG}</p><p>{_MID}</p><p>So.</p><p>{_LONG}</p></div><div class=widget><h4>Pages</h4>{_MENU}</div><div class=banner>{_MENU}</div>",
     "1111" + "00000" + "0000"),
    (f"<body class='has-sidebar'><article class='post with-comments'><div class='entry-header'><h1>Boats return</h1></div><p>{_LONG}</p>"
     f"<p>{_MID}</p></article><div id=comments><p>{_LONG}</p><p>Me too.</p></div></body>", "111" + "00"),
    (f"<form><div class='page with-sidebar'><p>{_LONG}</p><p>{_MID}</p><p>{_LONG}</p></div></form>", "111"),
    (f"<div class=header><p>{_MID}</p>{_MENU}</div><div><p>{_LONG}</p><p>{_MID}</p></div>", "00000" + "11"),
)


@lru_cache(maxsize=1)
def trained() -> Tree:
    """The tree of the labelled table."""
    x, y = [], []
    for page, marks in LABELLED:
        found = blocks(page)
        if len(found) != len(marks):
            raise ValueError(f"{len(found)} blocks, {len(marks)} labels: {page[:60]}")
        x.append(features(found))
        y += map(int, marks)
    return Tree(np.vstack(x), np.array(y))


def page_text(page: str | None, tree: Tree) -> str:
    found = blocks(page) if page else []
    return "\n".join(b[0] for b, main in zip(found, tree.predict(features(found))) if main)


def main_text(page: Column, tree: Tree | None = None) -> Column:
    """The main text of a column of HTML pages."""
    model = tree or trained()

    @F.arrow_udf("string")
    def extract(col: pa.Array) -> pa.Array:
        return pa.array([page_text(x.as_py(), model) for x in col], pa.string())
    return extract(page.cast("string"))


@register("op6_block_text")
def op6_block_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", main_text(F.col("html")).alias("text"))
    return pages.withColumn("n_chars", F.char_length("text").cast("long"))
