"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut into text blocks at its block-level tags. A block is described by its number of
words and its link density (the share of its words inside links), by the same of the blocks
before and after it, and by weak hints of the markup: how many enclosing elements name something
beside the text (navigation, footers, sidebars, notices, adverts, forms, comments; counted from the
innermost article on, two at most), whether an article or main element holds it, whether it is a
heading, and which share of the page's words has no hint of being beside the text: where a wrapper
marks the whole page, the hint says nothing and length and links decide. A decision tree, trained by
Spark ML on the labelled pages below, keeps or drops each block.

The page is read in one pass over its whole text, page by page inside a task; nothing is shuffled.

Defined results: a null or empty page, or one without main text, gives the empty text; a silent element
(script, button and the like) ends at its end tag, and where that is missing, or another of its kind or a
paragraph-like block begins first, there; a very long page is read whole; broken character references
stay as they are; repeated rows are extracted each; an empty table gives an empty table; columns called
text or n_chars are replaced, and all others pass through, whatever their names.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticktide.llm.common import col, groups, others

INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Elements whose content is never text of the page.
SILENT = frozenset("script style noscript template textarea title iframe object svg math select button canvas audio video head".split())
#: Of these the content is raw: only their own end tag ends them.
RAW = frozenset("script style textarea title iframe noscript".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
ASIDE_TAGS = frozenset("nav footer aside form dialog menu".split())
ASIDE_WORDS = frozenset(
    "ad ads adbox advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer form gdpr legal "
    "login masthead menu modal nav navbar navigation newsletter notice pager pagination popup promo recommended related replies reply search share sharing "
    "sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
MAIN_WORDS = frozenset("article content entry main post story".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>|<[a-zA-Z/!?][^>]*(?:>|\Z)""", re.S)
_NAMES = re.compile(r"""(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Labelled pages. A block is (words, linked words, hints, in an article, heading, kept).
LABELLED: list[list[tuple[int, int, int, int, int, int]]] = [
    # menu, advert, article with headings and short paragraphs, footer
    [(1, 1, 1, 0, 0, 0)] * 6 + [(8, 0, 1, 0, 0, 0), (9, 0, 0, 1, 1, 1), (9, 0, 0, 1, 0, 1), (60, 0, 0, 1, 0, 1), (1, 0, 0, 1, 0, 1), (44, 3, 0, 1, 0, 1), (3, 0, 0, 1, 0, 1), (7, 0, 1, 0, 0, 0)],
    [(1, 1, 1, 0, 0, 0)] * 4 + [(14, 0, 1, 0, 0, 0), (2, 0, 0, 1, 1, 1), (2, 0, 0, 1, 0, 1), (10, 0, 0, 1, 0, 1), (120, 0, 0, 1, 0, 1), (5, 0, 1, 0, 0, 0)],
    [(1, 1, 1, 0, 0, 0)] * 5 + [(9, 0, 1, 0, 0, 0), (1, 0, 0, 1, 1, 1), (1, 0, 0, 1, 0, 1), (9, 0, 1, 0, 0, 0)],
    # the same with a list, a link list in the article, comments behind it
    [(2, 2, 1, 0, 0, 0), (2, 2, 1, 0, 0, 0), (6, 0, 0, 1, 1, 1), (80, 4, 0, 1, 0, 1), (4, 0, 0, 1, 0, 1), (6, 1, 0, 1, 0, 1), (5, 0, 0, 1, 0, 1), (35, 10, 0, 1, 0, 1), (3, 3, 0, 1, 0, 0), (4, 4, 0, 1, 0, 0), (3, 3, 0, 1, 0, 0),
     (2, 0, 1, 0, 1, 0), (3, 0, 2, 0, 0, 0), (45, 0, 2, 0, 0, 0), (3, 0, 2, 0, 0, 0), (60, 2, 2, 0, 0, 0), (12, 0, 1, 0, 0, 0)],
    # comments and a notice inside the article element
    [(5, 0, 1, 0, 0, 0), (30, 2, 1, 0, 0, 0), (7, 0, 0, 1, 1, 1), (90, 2, 0, 1, 0, 1), (20, 0, 1, 1, 0, 0), (70, 0, 0, 1, 0, 1), (2, 0, 1, 1, 1, 0), (40, 0, 1, 1, 0, 0), (55, 0, 1, 1, 0, 0), (8, 0, 1, 0, 0, 0)],
    # no hints at all: menu, title, prose with a caption, links, imprint
    [(1, 1, 0, 0, 0, 0), (1, 1, 0, 0, 0, 0), (2, 2, 0, 0, 0, 0), (7, 0, 0, 0, 1, 1), (45, 0, 0, 0, 0, 1), (70, 5, 0, 0, 0, 1), (8, 0, 0, 0, 0, 1), (52, 0, 0, 0, 0, 1), (3, 3, 0, 0, 0, 0), (4, 4, 0, 0, 0, 0), (6, 0, 0, 0, 0, 0)],
    [(12, 12, 0, 0, 0, 0), (3, 0, 0, 0, 0, 0), (5, 0, 0, 0, 1, 1), (30, 0, 0, 0, 0, 1), (4, 0, 0, 0, 1, 1), (95, 8, 0, 0, 0, 1), (18, 0, 0, 0, 0, 1), (25, 2, 0, 0, 0, 1), (2, 0, 0, 0, 1, 0), (5, 5, 0, 0, 0, 0), (6, 6, 0, 0, 0, 0), (9, 2, 0, 0, 0, 0)],
    [(4, 4, 0, 0, 0, 0), (3, 3, 0, 0, 0, 0), (150, 0, 0, 0, 0, 1), (35, 30, 0, 0, 0, 0), (7, 1, 0, 0, 0, 0)],
    [(2, 0, 0, 0, 0, 0), (6, 6, 0, 0, 0, 0), (22, 1, 0, 0, 0, 1), (40, 0, 0, 0, 0, 1), (3, 0, 0, 0, 0, 1), (28, 0, 0, 0, 0, 1), (60, 45, 0, 0, 0, 0), (4, 0, 0, 0, 0, 0)],
    # short lines of n words: an advert and an imprint with a hint go, a heading and lines of the article stay
    *[[(1, 1, 1, 0, 0, 0)] * 4 + [(n, 0, 1, 0, 0, 0), (n, 0, 0, 1, 1, 1), (n, 0, 0, 1, 0, 1), (60, 0, 0, 1, 0, 1), (n, 0, 0, 1, 0, 1), (n, 0, 0, 1, 0, 1), (n, 0, 1, 0, 0, 0)] for n in (2, 4, 5, 6, 8, 11, 15)],
    *[[(1, 1, 1, 0, 0, 0)] * 2 + [(n, 0, 1, 0, 0, 0), (n + 1, 0, 0, 1, 1, 1), (30, 2, 0, 1, 0, 1), (n, 0, 0, 1, 0, 1), (12, 0, 1, 1, 0, 0), (25, 0, 0, 1, 0, 1), (n, 0, 0, 1, 0, 1), (n + 3, 0, 1, 0, 0, 0)] for n in (3, 5, 7, 9, 13)],
    *[[(1, 1, 1, 0, 0, 0), (n, 0, 0, 1, 1, 1), (4, 0, 0, 1, 0, 1), (24, 0, 0, 1, 0, 1), (n + 20, 0, 1, 0, 0, 0)] for n in (1, 2, 3, 5)], [(1, 0, 0, 1, 1, 1), (8, 0, 0, 1, 0, 1), (1, 0, 0, 1, 1, 1), (40, 0, 0, 1, 0, 1)],
    # linked lines in an article: one that stands before, between or behind prose belongs to it, a list of short ones doesn't
    *[[(n, n, 0, 1, 0, 1), (140, 0, 0, 1, 0, 1)] for n in (6, 7, 8)], *[[(n, n, 0, 1, 0, 1), (26, 0, 0, 1, 0, 1), (n, n, 0, 1, 0, 1), (50, 3, 0, 1, 0, 1)] for n in (6, 9)], [(9, 9, 0, 1, 0, 1), (60, 2, 0, 1, 0, 1), (45, 0, 0, 1, 0, 1)], [(6, 0, 0, 1, 1, 1), (90, 0, 0, 1, 0, 1), (8, 8, 0, 1, 0, 1), (70, 0, 0, 1, 0, 1)],
    [(80, 0, 0, 1, 0, 1), (11, 11, 0, 1, 0, 1)], [(1, 1, 1, 0, 0, 0), (12, 12, 0, 1, 0, 1), (33, 0, 0, 1, 0, 1), (7, 7, 0, 1, 0, 1), (25, 0, 0, 1, 0, 1), (6, 0, 1, 0, 0, 0)],
    [(120, 0, 0, 1, 0, 1), (2, 2, 0, 1, 0, 0), (3, 3, 0, 1, 0, 0), (2, 2, 0, 1, 0, 0)], [(50, 0, 0, 1, 0, 1), (3, 3, 0, 1, 0, 0), (3, 3, 0, 1, 0, 0), (64, 0, 0, 1, 0, 1)],
    # the same without hints
    [(140, 0, 0, 0, 0, 1), (7, 7, 0, 0, 0, 1), (140, 0, 0, 0, 0, 1)], [(55, 0, 0, 0, 0, 1), (9, 9, 0, 0, 0, 1), (38, 3, 0, 0, 0, 1)], [(1, 1, 0, 0, 0, 0), (2, 2, 0, 0, 0, 0), (95, 0, 0, 0, 0, 1), (8, 8, 0, 0, 0, 1), (60, 0, 0, 0, 0, 1), (3, 3, 0, 0, 0, 0)],
    [(3, 3, 0, 0, 0, 0), (6, 0, 0, 0, 1, 1), (48, 0, 0, 0, 0, 1), (70, 0, 0, 0, 0, 1)], [(2, 2, 0, 0, 0, 0), (85, 0, 0, 0, 0, 1), (33, 0, 0, 0, 0, 1)], [(2, 2, 0, 0, 0, 0), (4, 4, 0, 0, 0, 0), (64, 5, 0, 0, 0, 1)],
    [(90, 0, 0, 0, 0, 1), (5, 5, 0, 0, 0, 0), (4, 4, 0, 0, 0, 0), (6, 6, 0, 0, 0, 0)], [(28, 0, 0, 0, 0, 1), (3, 3, 0, 0, 0, 0), (5, 0, 0, 0, 0, 0)],
    # articles that end the page, or are all of it
    [(60, 0, 0, 1, 0, 1)], [(3, 0, 0, 1, 0, 1)], [(1, 0, 0, 1, 0, 1), (4, 0, 0, 1, 0, 1)], [(30, 0, 0, 0, 0, 1)], [(70, 3, 0, 0, 0, 1), (40, 0, 0, 0, 0, 1)],
    [(1, 1, 1, 0, 0, 0), (6, 0, 0, 1, 1, 1), (2, 0, 0, 1, 0, 1)], [(3, 3, 0, 0, 0, 0), (20, 0, 0, 1, 0, 1), (1, 0, 0, 1, 0, 1)], [(24, 0, 0, 1, 0, 1), (30, 0, 1, 1, 0, 0), (2, 0, 0, 1, 0, 1)],
    [(6, 0, 0, 0, 1, 1), (28, 0, 0, 0, 0, 1), (90, 4, 0, 0, 0, 1)], [(25, 0, 0, 0, 0, 1), (24, 0, 1, 0, 0, 0)],
    # a wrapper that hints all over the page: length and links decide
    [(1, 1, 1, 0, 0, 0), (2, 2, 1, 0, 0, 0), (6, 0, 1, 0, 1, 1), (60, 0, 1, 0, 0, 1), (45, 3, 1, 0, 0, 1), (80, 0, 1, 0, 0, 1), (5, 5, 1, 0, 0, 0), (6, 0, 1, 0, 0, 0)],
    [(3, 3, 1, 0, 0, 0), (3, 3, 1, 0, 0, 0), (75, 4, 1, 0, 0, 1), (5, 0, 1, 0, 0, 1), (33, 0, 1, 0, 0, 1), (4, 4, 1, 0, 0, 0), (30, 26, 1, 0, 0, 0), (5, 0, 1, 0, 0, 0)],
    [(2, 2, 1, 0, 0, 0), (60, 0, 1, 0, 0, 1), (5, 0, 1, 0, 0, 0)],
    [(1, 1, 2, 0, 0, 0), (5, 0, 2, 0, 1, 1), (55, 0, 2, 0, 0, 1), (42, 0, 2, 0, 0, 1), (3, 3, 2, 0, 0, 0)],
    # a page inside one form: menu at the start, text up to the end, or a line of the imprint behind it
    [(2, 0, 1, 0, 0, 0), (1, 1, 1, 0, 0, 0), (1, 1, 1, 0, 0, 0), (5, 0, 1, 0, 1, 1), (90, 0, 1, 0, 0, 1), (60, 4, 1, 0, 0, 1), (75, 0, 1, 0, 0, 1)],
    [(2, 2, 1, 0, 0, 0), (3, 3, 1, 0, 0, 0), (50, 0, 1, 0, 0, 1), (42, 0, 1, 0, 0, 1)], [(140, 0, 1, 0, 0, 1)], [(6, 0, 1, 0, 1, 1), (85, 3, 1, 0, 0, 1)], [(1, 1, 1, 0, 0, 0), (33, 0, 1, 0, 0, 1)],
    [(1, 0, 1, 0, 0, 0), (2, 2, 1, 0, 0, 0), (65, 0, 1, 0, 0, 1), (38, 0, 1, 0, 0, 1), (5, 0, 1, 0, 0, 0)], [(2, 0, 1, 0, 0, 0), (70, 0, 1, 0, 0, 1), (8, 8, 1, 0, 0, 1), (44, 0, 1, 0, 0, 1)],
    [(3, 0, 1, 0, 0, 0), (1, 1, 1, 0, 0, 0), (7, 0, 1, 0, 1, 1), (28, 0, 1, 0, 0, 1), (110, 0, 1, 0, 0, 1), (4, 4, 1, 0, 0, 0), (6, 0, 1, 0, 0, 0)],
    # prose without hints beside hinted prose: the latter is a sidebar or comments
    [(2, 2, 1, 0, 0, 0), (6, 0, 0, 0, 1, 1), (66, 2, 0, 0, 0, 1), (48, 0, 0, 0, 0, 1), (3, 0, 1, 0, 1, 0), (50, 0, 1, 0, 0, 0), (41, 0, 1, 0, 0, 0), (7, 0, 1, 0, 0, 0)],
    [(90, 0, 0, 0, 0, 1), (10, 0, 0, 0, 0, 1), (30, 0, 0, 0, 0, 1), (62, 3, 1, 0, 0, 0), (2, 0, 2, 0, 0, 0), (38, 0, 2, 0, 0, 0)],
]

#: What makes an article element a comment, a teaser or an advert; other words may name its subject.
REPLY_WORDS = frozenset("ad ads advert advertisement comment comments promo recommended related replies reply sponsor sponsored teaser".split())
#: A word behind one of these in a class or id is what the element has, not what it is; a name that ends in one of those is a page's frame.
BEFORE, BEHIND = frozenset("has with no is without".split()), frozenset("layout page template grid theme".split())
#: Blocks whose begin ends an unclosed button or menu.
OPENING = frozenset("p article main section h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre nav header footer aside form".split())


def blocks(page: str) -> list[tuple[str, int, int, int, int, int]]:
    """(text, words, linked words, hints, in an article, heading) of each block with text, in page order."""
    out: list[tuple[str, int, int, int, int, int]] = []
    open_: list[tuple[str, tuple[int, int]]] = []  # tag, (hints, in an article) outside it
    places: dict[str, list[int]] = {}  # of each tag, where it stands in the list
    asides = 0  # how many of the list's tags are asides
    state, heading, links, articles = (0, 0), 0, 0, 0
    parts: list[str] = []
    linked: list[bool] = []
    endless: set[str] = set()  # silent tags without a further end tag

    def close() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                inside = sum(len(html.unescape(p).split()) for p, a in zip(parts, linked, strict=True) if a)
                words = text.count(" ") + 1
                out.append((text, words, min(inside, words), min(state[0], 2), state[1], heading))
            parts.clear()
            linked.clear()

    def add(text: str) -> None:
        if text:
            parts.append(text)
            linked.append(links > 0)

    at = 0
    while (m := _TOKEN.search(page, at)) is not None:
        add(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag in SILENT:
            if not m[1]:
                if tag not in ("button", "select"):
                    close()
                at = _behind(page, at, tag, endless)
            continue
        if tag == "a":
            links = max(0, links + (-1 if m[1] else 1))
        if tag in INLINE:
            if tag == "br":
                add(" ")
            continue
        close()
        links = 0
        if m[1]:
            if places.get(tag):
                state = open_[places[tag][-1]][1]
                while open_ and places[tag]:
                    gone, _ = open_.pop()
                    places[gone].pop()
                    asides -= gone in ASIDE_TAGS
                    if gone == tag:
                        break
            heading = 0
        elif tag not in VOID:
            if tag not in ("p", "li", "td", "th", "tr", "dt", "dd", "html", "body", "option") or _NAMES.search(m[3]):
                places.setdefault(tag, []).append(len(open_))
                open_.append((tag, state))
                asides += tag in ASIDE_TAGS
            state = _hinted(tag, m[3], state, not articles and not asides)
            articles += tag == "article"
            heading = int(tag in HEADINGS)
    add(page[at:])
    close()
    return out


def _behind(page: str, at: int, tag: str, endless: set[str]) -> int:
    """The place behind a silent element that begins before `at`.

    It ends at its end tag; where that is missing, or for a button or menu where another one or a
    paragraph-like block begins first, it ends there.
    """
    loose = tag in ("button", "select") or tag in endless
    while (m := _TOKEN.search(page, at)) is not None:
        own = (m[2] or "").lower()
        if own == tag and m[1]:
            return m.end()
        if loose and not m[1] and (own in OPENING or own == tag or tag in endless and own and own not in INLINE and own not in SILENT):
            return m.start()
        if tag == "head" and not m[1] and (own in OPENING or own in ("body", "div")):
            return m.start()
        if not loose:  # straight to the end tag
            end = re.compile(f"</{tag}(?=[\\s/>])[^>]*>", re.I).search(page, at) if tag != "head" else None
            if end:
                return end.end()
            if tag != "head":
                endless.add(tag)
                loose = True
                continue
        at = m.end() if not (tag == "head" and own in RAW and not m[1]) else _behind(page, m.end(), own, endless)
    return len(page)


def _hinted(tag: str, attributes: str, state: tuple[int, int], first: bool) -> tuple[int, int]:
    """(hints, in an article) inside an element, from those outside it; the page's first article shakes off those of its frame."""
    words: set[str] = set()
    for value in _NAMES.findall(attributes) if attributes else ():
        for name in value.strip("\"'").split():
            own = [w.lower() for w in _PARTS.findall(name)]
            if own and own[-1] not in BEHIND:
                words.update(w for w, before in zip(own, ["", *own], strict=False) if before not in BEFORE and w not in BEFORE)
    aside = bool(words & ASIDE_WORDS)
    if tag == "main" or tag == "article" and not words & REPLY_WORDS:
        return (0 if tag == "main" or first else state[0]), 1
    if tag in ("html", "body"):
        return state
    if tag in ASIDE_TAGS or tag == "header" and not state[1] or aside:
        return state[0] + 1, state[1]
    return state[0], int(bool(state[1] or state[0] == 0 and words & MAIN_WORDS))


def features(found: list[tuple[int, int, int, int, int]]) -> list[tuple[float, ...]]:
    """Of each block (words, linked words, hints, in an article, heading) of a page: its own and its neighbours' size, and hints."""
    size = [(float(w), k / w) for w, k, *_ in found]
    edge = [(0.0, 0.0)]
    clear = sum(b[0] - b[1] for b in found if not b[2]) / max(1, sum(b[0] - b[1] for b in found))
    return [(*now, *before, *after, float(b[2]), float(b[3]), float(b[4]), clear) for now, before, after, b in zip(size, edge + size, size[1:] + edge, found, strict=False)]


def stretched(page: list[tuple[int, int, int, int, int, int]], factor: float) -> list[tuple[int, int, int, int, int, int]]:
    """The page with its prose longer or shorter; a block of up to 20 words stays as it is."""
    return [(round(w * factor), round(k * factor), *rest) if w > 20 else (w, k, *rest) for w, k, *rest in page]


def train(spark: SparkSession, labelled: list[list[tuple[int, int, int, int, int, int]]] = LABELLED) -> Any:
    """The tree as nested (feature, threshold, at most, above) with 0 or 1 at the leaves.

    Each labelled page counts with its prose as given, shorter, longer and much longer, and a leaf needs three blocks.
    """
    pages = [stretched(page, factor) for factor in (1.0, 0.67, 1.6, 4.0) for page in labelled]
    rows = [(Vectors.dense(x), float(b[5])) for page in pages for x, b in zip(features([b[:5] for b in page]), page, strict=True)]
    frame = spark.createDataFrame(rows, ["features", "label"]).coalesce(1)
    model = DecisionTreeClassifier(maxDepth=10, maxBins=256, minInstancesPerNode=3, seed=5).fit(frame)

    def export(node: Any) -> Any:
        if node.getClass().getSimpleName() == "LeafNode":
            return int(node.prediction())
        split = node.split()
        return split.featureIndex(), split.threshold(), export(node.leftChild()), export(node.rightChild())

    return export(model._call_java("rootNode"))


def keeps(tree: Any, x: tuple[float, ...]) -> bool:
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return bool(tree)


def main_text(page: str | None, tree: Any) -> str:
    found = blocks(page or "")
    return "\n".join(b[0] for b, x in zip(found, features([b[1:] for b in found]), strict=True) if keeps(tree, x))


def extract(pages: DataFrame, html_col: str = "html", tree: Any = None) -> DataFrame:
    """All columns of `pages` but the html, with text and n_chars (replacing columns of these names)."""
    tree = train(pages.sparkSession) if tree is None else tree
    kept = others(pages, [html_col, "text", "n_chars"])
    heads = [f"c{i}" for i in range(len(kept))]
    schema = T.StructType([T.StructField(h, pages.schema[c].dataType) for h, c in zip(heads, kept, strict=True)] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in groups(batch):
                texts = [main_text(p, tree) for p in part.column(len(kept)).to_pylist()]
                own = [part.column(i) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*own, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema.names)

    out = pages.select(*[col(c).alias(h) for c, h in zip(kept, heads, strict=True)], col(html_col).alias("html")).mapInArrow(run, schema)
    return out.select(*[F.col(h).alias(c) for c, h in zip(kept, heads, strict=True)], "text", "n_chars")
