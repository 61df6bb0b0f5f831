"""Main text of web pages: flat text blocks, judged with their neighbours by a decision tree.

A page becomes a flat list of blocks (text between block-level tags) with word counts, link
densities and the containers they stand in. A tree trained on a small labelled table
decides block by block; what it keeps is the article.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .tables import carried

_TOKEN = re.compile(
    # possessive: a quote that is never closed fails at once instead of trying every split before it
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""",
    re.S,
)
_NAMES = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
#: Elements whose content is never text.
SKIPPED = {"script", "style", "noscript", "template", "svg", "iframe", "object", "canvas", "head", "title", "select", "textarea", "button", "audio", "video"}
RAW = {"script", "style", "title", "textarea", "noscript", "iframe"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "input", "meta", "link", "br"}
#: Formulas stand inside their sentence.
INLINE |= {"math", "semantics", "mi", "mn", "mo", "ms", "mtext", "mspace", "mrow", "mfrac", "msqrt", "mroot", "msup", "msub", "msubsup", "mover", "munder", "munderover", "mtable", "mtr", "mtd", "mstyle", "mpadded", "mphantom", "menclose", "mfenced"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Containers that are page furniture by their element or by a word of their class, id or role.
FURNITURE = {"nav", "header", "footer", "aside", "form", "dialog", "menu", "fieldset"}
FURNITURE_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "byline", "comment", "comments",
    "consent", "cookie", "cookies", "copyright", "disclaimer", "footer", "form", "gdpr", "header", "login", "masthead", "menu", "modal", "nav",
    "navbar", "navigation", "newsletter", "notice", "notices", "pagination", "popup", "promo", "promotion", "recommended", "related", "reply",
    "replies", "respond", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "tags", "teaser",
    "toolbar", "topbar", "widget", "alert", "disqus", "complementary", "contentinfo", "skip", "toc",
}
#: Words that make even an article element furniture.
NO_ARTICLE_WORDS = {"ad", "ads", "advert", "comment", "comments", "promo", "related", "reply", "sponsored", "teaser"}
ARTICLE = {"article", "main"}
ARTICLE_WORDS = {"article", "content", "post", "entry", "story", "main", "body", "text", "articlebody"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

FEATURES = ["words", "links", "words_before", "links_before", "words_after", "links_after", "furniture", "article", "page_article", "heading"]
#: The labelled table: the features of a block in the order of FEATURES, then 1 for main text.
LABELLED = """
1 0 40 0 35 0 0 1 1 0 1
2 0 30 0 60 0 0 1 1 0 1
3 0.34 55 0 25 0 0 1 1 0 1
8 0 0 0 45 0 0 1 1 1 1
12 0 6 1 80 0 0 1 1 1 1
25 0 8 0 60 0 0 1 1 0 1
60 0.05 25 0 70 0 0 1 1 0 1
120 0 60 0 3 1 0 1 1 0 1
45 0.6 50 0 40 0 0 1 1 0 1
5 1 70 0 50 0 0 1 1 0 1
4 0 2 0 3 0 0 1 1 0 1
90 0.02 80 0 0 0 0 1 1 0 1
10 0 6 1 9 0 1 0 1 0 0
9 0 90 0 0 0 1 0 1 0 0
1 1 1 1 1 1 1 0 1 0 0
2 1 1 1 1 1 1 0 1 0 0
6 0.5 2 1 8 0 1 0 1 1 0
40 0 9 0 30 0 1 0 1 0 0
80 0 60 0 12 0 1 0 1 0 0
30 0.1 50 0 40 0 1 1 1 0 0
70 0 30 0 45 0 1 1 1 0 0
4 0 60 0 55 0 1 1 1 1 0
3 1 4 1 3 1 1 1 1 0 0
15 0 2 1 30 0 0 0 1 0 0
50 0 10 0 12 0 0 0 1 0 0
6 0 1 1 70 0 0 0 1 1 0
3 1 3 1 3 1 0 0 1 0 0
20 0 80 0 5 0 0 0 1 0 0
60 0 50 0 55 0 0 0 0 0 1
35 0.05 60 0 40 0 0 0 0 0 1
22 0 40 0 50 0 0 0 0 0 1
18 0 6 0 45 0 0 0 0 0 1
12 0 45 0 60 0 0 0 0 0 1
7 0 8 0 50 0 0 0 0 1 1
4 0 30 0 40 0 0 0 0 1 1
6 0 50 0 45 0 0 0 0 0 1
2 0 35 0 60 0 0 0 0 0 1
90 0.1 0 0 30 0 0 0 0 0 1
100 0 12 0 4 0.8 0 0 0 0 1
3 0 2 1 3 1 0 0 0 0 0
5 0.8 4 1 6 1 0 0 0 0 0
2 1 2 1 2 1 0 0 0 0 0
1 1 30 0 1 1 0 0 0 0 0
8 0.7 9 0.9 40 0 0 0 0 0 0
14 0.9 3 1 5 1 0 0 0 0 0
40 0.8 20 0.9 30 0.7 0 0 0 0 0
6 0 3 1 2 1 0 0 0 0 0
5 0 4 0.5 4 0.5 0 0 0 0 0
4 0 0 0 0 0 0 0 0 0 0
21 0 0 0 0 0 0 0 0 0 1
30 0 3 1 0 0 0 0 0 0 1
50 0 40 0 30 0 1 0 0 0 0
9 0 60 0 0 0 1 0 0 0 0
2 1 2 1 3 1 1 0 0 0 0
5 0 2 1 70 0 1 0 0 1 0
25 0.1 30 0 0 0 1 0 0 0 0
"""


@dataclass
class Tree:
    """A binary decision tree: a leaf has a label, a node a feature, a cut and two branches."""

    label: int = 0
    feature: int = -1
    cut: float = 0.0
    low: Tree | None = None
    high: Tree | None = None

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.feature < 0:
            return np.full(len(x), bool(self.label))
        below = x[:, self.feature] <= self.cut
        out = np.zeros(len(x), bool)
        out[below] = self.low.predict(x[below])
        out[~below] = self.high.predict(x[~below])
        return out


def grow(x: np.ndarray, y: np.ndarray, depth: int = 7) -> Tree:
    """The tree that lowers the Gini impurity most at every cut; ties take the first feature."""
    tree = Tree(int(y.mean() >= 0.5) if len(y) else 0)
    if not depth or len(set(y.tolist())) < 2:
        return tree
    best = (1e-9, -1, 0.0)
    impurity = lambda v: len(v) * v.mean() * (1 - v.mean()) if len(v) else 0.0
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            below = x[:, f] <= cut
            gain = impurity(y) - impurity(y[below]) - impurity(y[~below])
            if gain > best[0] + 1e-12:
                best = (gain, f, float(cut))
    if best[1] < 0:
        return tree
    below = x[:, best[1]] <= best[2]
    return Tree(tree.label, best[1], best[2], grow(x[below], y[below], depth - 1), grow(x[~below], y[~below], depth - 1))


#: Containers that decide whatever the block looks like: (furniture, article, page has an article), label.
CONTAINERS = [((1, 0, 0), 0), ((1, 0, 1), 0), ((1, 1, 1), 0), ((0, 1, 1), 1), ((0, 0, 1), 0)]


def labelled_rows() -> np.ndarray:
    """The labelled table, with every shape of block it knows in each of the deciding containers."""
    rows = np.array([[float(v) for v in line.split()] for line in LABELLED.split("\n") if line.strip()])
    shapes = np.unique(rows[:, :6], axis=0)
    inside = [[*shape, *container, heading, label] for shape in shapes for container, label in CONTAINERS for heading in (0, 1)]
    return np.vstack([rows, np.array(inside, float)])


def default_tree() -> Tree:
    rows = labelled_rows()
    return grow(rows[:, :-1], rows[:, -1])


def flat_blocks(page: str) -> list[tuple[str, int, int, bool, bool, bool]]:
    """(text, words, linked words, furniture, article, heading) of every block of text in page order."""
    out: list[tuple[str, int, int, bool, bool, bool]] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # element, furniture, article, hidden
    parts: list[str] = []
    linked = 0
    in_link = False
    heading = False
    at = 0

    def flush():
        nonlocal linked
        if parts:
            found = "".join(parts).split()
            if found:
                furniture, article = (stack[-1][1], stack[-1][2]) if stack else (False, False)
                out.append((" ".join(found), len(found), min(linked, len(found)), furniture, article, heading))
            parts.clear()
        linked = 0

    def text(s: str):
        nonlocal linked
        if not s or stack and stack[-1][3]:
            return
        s = html.unescape(s) if "&" in s else s
        parts.append(s)
        if in_link:
            linked += len(s.split())

    for m in _TOKEN.finditer(page):
        if m.start() < at:
            continue
        text(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing = bool(m[1] or m[4])
        attributes = m[3] or m[6] or ""
        if name == "br":
            parts.append(" ")
            continue
        if name == "a":
            in_link = not closing
            continue
        if name in ("annotation", "annotation-xml"):  # the source of a formula that stands there already
            end = None if closing else re.compile("</" + name + r"[\s/>]", re.I).search(page, at)
            at = end.start() if end else at
            continue
        if name in INLINE and not (attributes and _HIDDEN.search(attributes)):
            continue
        flush()
        if closing:
            in_link = False
            if name in HEADINGS:
                heading = False
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
            continue
        if name in VOID or name in INLINE:
            continue
        if name in RAW:
            end = re.compile("</" + name + r"[\s/>]", re.I).search(page, at)
            at = end.start() if end else len(page)
            continue
        if name in HEADINGS:
            heading = True
        if stack and stack[-1][0] == "p":  # holds no blocks, so the next one ends it
            stack.pop()
        if name == "p" and not attributes:
            continue
        if name == "body" and stack and stack[-1][0] == "head":
            stack.pop()
        if name in ("li", "dd", "dt", "tr", "td", "th", "option") and stack and stack[-1][0] == name:
            stack.pop()
        above = stack[-1] if stack else ("", False, False, False)
        names: set[str] = set()
        if attributes:
            for n in _NAMES.finditer(attributes):
                names |= set(re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", n[1] or n[2] or n[3] or "").lower()))
        article = name in ARTICLE or (above[2] or bool(names & ARTICLE_WORDS) and name in ("div", "section", "td"))
        marked = names & FURNITURE_WORDS
        if name in ("body", "html"):
            furniture = False
        elif name in ARTICLE:
            furniture = bool(names & NO_ARTICLE_WORDS)
        elif above[2] and (name == "header" or marked == {"header"}):
            furniture = bool(marked - {"header"})
        else:
            furniture = name in FURNITURE or bool(marked)
        hidden = above[3] or name in SKIPPED or bool(attributes and _HIDDEN.search(attributes))
        stack.append((name, above[1] or furniture, article, hidden))
    text(page[at:])
    flush()
    return out


def block_features(found: list[tuple[str, int, int, bool, bool, bool]]) -> np.ndarray:
    own = np.array([(w, k / w) for _, w, k, *_ in found], float)
    edge = np.zeros((1, 2))
    flags = np.array([(furniture, article) for *_, furniture, article, _ in found], float)
    heading = np.array([[h] for *_, h in found], float)
    whole = np.full((len(found), 1), float(any(a and not f for f, a in flags)))
    return np.hstack([own, np.vstack([edge, own[:-1]]), np.vstack([own[1:], edge]), flags, whole, heading])


def main_text(page: str, tree: Tree) -> str:
    found = flat_blocks(page)
    if not found:
        return ""
    keep = tree.predict(block_features(found))
    return "\n".join(b[0] for b, k in zip(found, keep) if k)


def _extract(batches, tree: Tree):
    for batch in batches:
        pages = batch.column(1)
        texts = pa.array([main_text(p.as_py() or "", tree) for p in pages], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), texts], ["row", "main"])


def extract(pages: DataFrame, tree: Tree | None = None, column: str = "html") -> DataFrame:
    """``pages`` (html, ...) to (row, main): the main text, its blocks joined by line feeds.

    Character references are decoded and white space inside a block is one blank. Null
    and empty pages, and pages without article, give an empty text; broken or cut markup
    is read as far as it goes; other columns are carried in ``row`` without the html; an
    empty table gives no rows.
    """
    keep = [c for c in pages.columns if c != column]
    return carried(pages, partial(_extract, tree=tree or default_tree()), "main string", text=column, keep=keep)
