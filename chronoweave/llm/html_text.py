"""Main text of web pages: flat text blocks, classified by a decision tree over their own and their neighbours' features.

A page becomes a row of blocks (text between block-level tags). Each block has a word count and a link density, those
of the blocks before and after it, whether its containers name it page furniture or article, and the length of the page's
longest plain block (a page of short sentences is judged by another measure). The tree is trained on the small labelled
table below.

A container that is named furniture but wraps the page's only article (most of its words, every heading and everything
marked as article) is no furniture: a form around a whole page, a wrapper with a telling class.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.llm.common import bounded_batches, query, table, whole_text

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "furniture", "article", "longest")
#: Labelled blocks: the nine features, then 1 for main text. Counts in words, densities as the share of words in links.
LABELLED = """
220 .00  95 .02 180 .00 0 1 220 1
 64 .03 120 .00  40 .05 0 1 120 1
  9 .00   0 .00  80 .00 0 1  80 1
  1 .00  60 .00  90 .00 0 1  90 1
  2 .00   3 .00   1 .00 0 1  60 1
 14 .50  70 .00  66 .00 0 1  70 1
  4 1.0  50 .00  48 .00 0 1  60 1
 31 .06   6 1.0  22 .00 0 1  60 1
 12 .00   8 .00   7 1.0 0 1  60 1
  6 .00  40 .00   0 .00 0 1  60 1
150 .01   0 .00   0 .00 0 1 150 1
  3 .00   1 1.0   4 .00 0 1  60 1
  1 .00   1 1.0   1 1.0 0 1  60 1
  6 .00   4 1.0   3 1.0 0 1  60 1
  2 1.0   1 1.0   1 1.0 0 1  60 1
  5 .00   0 .00   2 .00 0 1  60 1
  3 .30   2 1.0   9 .90 0 1  60 1
  8 .80   5 1.0   2 .00 0 1  60 1
 10 .00   3 .50   1 1.0 0 1  60 1
  4 .00   6 .80   5 .60 0 1  60 1
  7 .00   1 .00   0 .00 0 1  60 1
 24 .00   9 .90   3 .00 0 1  60 1
  2 .00   0 .00   6 1.0 0 1  60 1
 17 .60   3 .00   2 .00 0 1  60 1
 85 .02  60 .00  70 .01 0 0  85 1
 40 .00  55 .00  62 .00 0 0  62 1
 27 .00  33 .00  20 .10 0 0  60 1
 18 .00  90 .00  75 .00 0 0  90 1
120 .10   5 .00   4 1.0 0 0 120 1
 70 .00   2 1.0   3 1.0 0 0  70 1
  8 .00  60 .00  85 .00 0 0  85 1
 11 .00  45 .00  50 .00 0 0  60 1
 55 .20 130 .00  90 .00 0 0 130 1
 35 .00   3 .00  64 .00 0 0  64 1
240 .00   0 .00   0 .00 0 0 240 1
 48 .05   9 .00   0 .00 0 0  60 1
  1 1.0   1 1.0   1 1.0 0 0  60 0
  2 1.0   1 1.0   3 1.0 0 0  60 0
  5 .80   4 1.0   2 .50 0 0  60 0
  3 .00   2 1.0   2 1.0 0 0  60 0
  6 .00   1 1.0   5 .00 0 0  60 0
  4 .00   0 .00   3 1.0 0 0  60 0
  9 .00   3 .00   2 .00 0 0  60 0
  7 .00   5 1.0   0 .00 0 0  60 0
 30 .90   4 .50  12 .70 0 0  60 0
 60 .80   8 .00  40 .90 0 0  60 0
 12 .60  15 .70   9 .50 0 0  60 0
  8 .10   6 .30   4 .00 0 0  60 0
  1 1.0   1 1.0   1 1.0 1 0  60 0
  2 .00   9 1.0   7 .00 1 0  60 0
  8 .00   1 1.0   9 .00 1 0  60 0
 25 .00   2 1.0  60 .00 1 0  60 0
 45 .00  40 .00  30 .00 1 0  60 0
140 .02  70 .00  90 .00 1 0 140 0
 90 .00 110 .00   6 .00 1 0 110 0
 33 .15  80 .00   0 .00 1 0  80 0
 12 .40 200 .00   5 .00 1 0 200 0
  4 .00   2 .00   3 .00 1 0  60 0
 75 .00  95 .00  62 .00 1 1  95 0
  5 .00  80 .00  70 .00 1 1  80 0
 18 .00  64 .00  18 .00 1 1  64 0
  2 1.0   2 1.0   2 1.0 1 1  60 0
 38 .00   3 .00  41 .00 1 1  60 0
160 .00 120 .00  10 .00 1 1 160 0
  2 .00   0 .00   6 .00 0 0   6 1
  6 .00   2 .00   0 .00 0 0   6 1
  3 .00   0 .00   0 .00 0 0   3 1
  9 .00   4 .00   7 .00 0 0  11 1
 12 .00   3 .00   9 .00 0 0  12 1
  7 .00   9 .00   5 .00 0 0  10 1
  4 .00   3 1.0   8 .00 0 0   9 1
  8 .00   5 .00   4 1.0 0 0   9 1
  1 1.0   1 1.0   6 .00 0 0   8 0
  2 1.0   6 .00   0 .00 0 0   8 0
  5 .80   4 .00   2 1.0 0 0   9 0
  4 .00   6 .00   0 .00 1 0   7 0
  6 .00   0 .00   3 .00 1 0   9 0
  1 .00   5 1.0  45 .00 0 0  60 1
  6 .00   5 1.0  40 .00 0 0  60 1
  4 .00   0 .00  70 .00 0 0  90 1
  3 .00   0 .00  12 1.0 0 0  80 0
  5 .00   6 1.0  14 .90 0 0 120 0
  2 .00   0 .00   7 1.0 0 0  90 0
  6 .00   0 .00   9 .80 0 0 150 0
"""

INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())  # their content is no markup: without a closing tag it runs to the end of the page
DROPPED = "script style noscript template svg math iframe object canvas select button textarea option title audio video map"
WHOLE_PAGE = frozenset("html body main article".split())  # what furniture such a container names is beside the text or absent
CONTAINERS = frozenset("div section nav header footer aside form fieldset dialog menu article main ul ol dl table figure details body td center".split())
FURNITURE_TAGS = frozenset("nav footer aside form fieldset dialog menu".split())
FURNITURE_NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted cookie cookies consent gdpr notice notices
    alert newsletter subscribe subscription signup signin login register popup modal overlay toast menu menus nav navbar navigation breadcrumb breadcrumbs sidebar
    rail widget widgets related recommended recommendations trending popular share sharing social follow comment comments disqus discussion respond reply replies
    reviews footer masthead topbar toolbar pagination pager search searchbox toc copyright legal disclaimer hidden skip""".split()
)
#: Beginnings of longer names (cookiebar, commentlist), but not of these words.
FURNITURE_STEMS = tuple("cookie comment advert sidebar banner navig navbar breadcrumb newsletter subscri sponsor promo popup footer masthead recommend paywall notif".split())
FURNITURE_NOT = frozenset("commentary commentaries".split())
ARTICLE_NAMES = frozenset("article articlebody story post entry content main prose".split())
_DROP = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<({'|'.join(DROPPED.split())})(?=[\s/>])((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.I | re.S)
_CLOSE = {name: re.compile(rf"</{name}\s*+>", re.I) for name in DROPPED.split()}
_OPTION = re.compile(r"<(?:(/option)\s*+>|/?(?:option|optgroup|select|datalist)(?=[\s/>]))", re.I)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)(?:>|\Z)")
_ATTRIBUTE = re.compile(r"[\s/]*+([^\s/>=\"']++|[=\"'])(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?")
#: A name with one of these parts tells of a state or a subject of the page, not what the container is.
QUALIFIERS = frozenset("has no not non with without hide category cat tag topic term status format open opened closed enabled disabled layout type single page site body wrap wrapper".split())
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Block:
    text: str
    words: int
    linked: int
    furniture: bool
    article: bool
    container: int = 0


def _names(value: str) -> tuple[set[str], set[str]]:
    """(parts of all names, parts of the names without a qualifier) of a class or id."""
    every, plain = set(), set()
    for name in value.split():
        parts = {t.lower() for t in _TOKEN.findall(name)}
        every |= parts
        if not parts & QUALIFIERS:
            plain |= parts
    return every, plain


def _role(name: str, attributes: str, inside_article: bool) -> tuple[bool, bool]:
    """Whether a container is (page furniture, article)."""
    furniture, article = name in FURNITURE_TAGS or (name == "header" and not inside_article), name in ("article", "main")
    if attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id"):
                every, plain = _names(value)
                if name not in WHOLE_PAGE:
                    furniture = furniture or bool(plain & FURNITURE_NAMES) or any(t.startswith(FURNITURE_STEMS) for t in plain - FURNITURE_NOT)
                article = article or bool(every & ARTICLE_NAMES)
            elif key == "role":
                furniture = furniture or value.lower() in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form")
                article = article or value.lower() in ("main", "article")
            elif key == "itemprop":
                article = article or value.lower() == "articlebody"
            elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and "display:none" in value.lower().replace(" ", "")):
                furniture = True
    return furniture, article


def _without_dropped(page: str) -> str:
    """The page without comments and dropped elements.

    An element that closes itself is empty. One that is never closed loses its tag only, an option the text up to the
    next tag; raw text runs to the end of the page.
    """
    out, at, unclosed = [], 0, set()
    while m := _DROP.search(page, at):
        out.append(page[at : m.start()])
        at = m.end()
        if not m[1]:
            continue
        out.append(" ")
        name = m[1].lower()
        if name not in RAW and m[2].endswith("/"):
            continue
        close = None if name in unclosed else (_OPTION if name == "option" else _CLOSE[name]).search(page, at)
        if not close:
            unclosed.add(name)  # nor is any later one
        if close and (name != "option" or close[1]):
            at = close.end()
        elif name in RAW:
            at = len(page)
        elif name == "option":
            following = page.find("<", at)
            at = following if following >= 0 else len(page)
    return "".join(out) + page[at:]


def blocks(page: str) -> list[Block]:
    """Text blocks in page order; markup that is never closed ends with the page."""
    page = _without_dropped(page) if "<" in page else page
    out: list[Block] = []
    # containers in the order they open: parent, furniture by itself, article (inherited), headings directly inside
    parent, named, inside, heads = [0], [False], [False], [0]
    stack: list[tuple[str, int]] = []  # open containers: tag, number
    parts: list[str] = []
    here = 0
    own: tuple[bool, bool] | None = None  # of a paragraph-like tag with a telling name
    anchors, linked, at = 0, 0, 0

    def close() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            f, a = own or (False, False)
            out.append(Block(text, len(text.split()), linked, f, inside[here] or a, here))
        parts.clear()
        linked = 0

    for m in _TAG.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            parts.append(piece)
            if anchors:
                linked += len(piece.split())
        at = m.end()
        end, name, attributes = (m[1], m[2].lower(), m[3]) if m[2] else (m[4], m[5].lower(), m[6])
        if name in INLINE:
            if name == "a":
                anchors = 0 if end else 1
            elif name == "br":
                parts.append(" ")
            continue
        close()
        own = None
        if name in CONTAINERS:
            if not end:
                f, a = _role(name, attributes, inside[here])
                parent.append(here)
                named.append(f)
                inside.append(inside[here] or a)
                heads.append(0)
                here = len(parent) - 1
                stack.append((name, here))
            elif any(x[0] == name for x in stack):
                while stack.pop()[0] != name:
                    pass
                here = stack[-1][1] if stack else 0
        elif not end:
            heads[here] += name == "h1"
            if attributes:
                own = _role(name, attributes, inside[here])
    if at < len(page):
        parts.append(page[at:])
    close()
    _mark_furniture(out, parent, named, heads)
    return out


def _mark_furniture(found: list[Block], parent: list[int], named: list[bool], heads: list[int]) -> None:
    """Blocks inside a furniture container become furniture, unless that container wraps the page's only article."""
    n = len(parent)
    words, articles = [0] * n, [0] * n  # unlinked words in and below each container; those marked as article
    for b in found:
        plain = max(b.words - b.linked, 0)
        words[b.container] += plain
        articles[b.container] += plain if b.article else 0
    for c in range(n - 1, 0, -1):  # a container opens after its parent
        for total in (words, articles, heads):
            total[parent[c]] += total[c]
    inside = [False] * n
    for c in range(1, n):
        whole = articles[c] == articles[0] and heads[c] == heads[0]
        wraps = whole and (2 * words[c] >= words[0] and (heads[c] > 0 or articles[c] > 0) or 10 * words[c] >= 9 * words[0] and words[c] >= 40)
        inside[c] = inside[parent[c]] or named[c] and not wraps
    for b in found:
        b.furniture = b.furniture or inside[b.container]


def features(found: list[Block]) -> np.ndarray:
    n = len(found)
    words = np.array([b.words for b in found], dtype=float)
    links = np.array([min(1.0, b.linked / b.words) for b in found], dtype=float)
    shifted = lambda v, k: np.concatenate([np.zeros(1), v[:-1]]) if k < 0 else np.concatenate([v[1:], np.zeros(1)])
    flags = np.array([[b.furniture, b.article] for b in found], dtype=float).reshape(n, 2)
    longest = max((b.words for b in found if not b.furniture and 3 * b.linked <= b.words), default=0)
    return np.column_stack([words, links, shifted(words, -1), shifted(links, -1), shifted(words, 1), shifted(links, 1), flags, np.full(n, longest)])


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6):
    """A tree as nested (feature, threshold, low side, high side), a leaf as the majority label; splits by Gini gain."""
    if depth == 0 or y.min() == y.max():
        return bool(y.mean() >= 0.5)
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[:-1] + values[1:]) / 2:
            low = x[:, f] <= cut
            impurity = sum(s.sum() * y[s].mean() * (1 - y[s].mean()) for s in (low, ~low))
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, cut, low)
    if best is None:
        return bool(y.mean() >= 0.5)
    _, f, cut, low = best
    return (f, float(cut), grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1))


def train(labelled: str = LABELLED):
    rows = np.array([[float(v) for v in line.split()] for line in labelled.strip().splitlines()])
    return grow(rows[:, :-1], rows[:, -1])


def is_main(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, bool):
        return np.full(len(x), tree)
    f, cut, low, high = tree
    side = x[:, f] <= cut
    return np.where(side, is_main(low, x), is_main(high, x))


def main_text(page: str, tree) -> str:
    found = blocks(page)
    if not found:
        return ""
    return "\n\n".join(b.text for b, keep in zip(found, is_main(tree, features(found))) if keep)


def extract(df: DataFrame, page: str = "html", into: str = "text", tree=None) -> DataFrame:
    """`df` with `into`: main text of the whole page, blocks joined by an empty line.

    A null or empty page, and one without main text, gives the empty text. Pages are independent rows; a column named
    `into` is replaced, others pass through.
    """
    tree = tree or train()

    @F.pandas_udf(T.StringType())
    def extracted(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(p, tree) for p in pages])

    bounded_batches(df.sparkSession)
    return df.withColumn(into, extracted.asNondeterministic()(whole_text(page)))


@query()
def op10_html_extraction(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
