"""Main text of web pages: flat text blocks, classified by a small decision tree.

A page is cut into the text blocks between block-level tags. A block is described by
its own word count and link density, those of the blocks before and after it, and
facts on where it stands: under an element or a name of boilerplate, in an article, in
a heading, how much running text the named element around it holds, and how much the
page has apart from such elements. No name decides: a decision tree trained on the
labelled table below keeps or drops a block, and keeps what stands under a name of
boilerplate if the page has no other running text. Pages are independent, so
extraction is one pass without a shuffle.
"""

from __future__ import annotations

import functools
import html
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_batches

# HTML element kinds and names that sites give to page parts.
CONTAINERS = frozenset("article aside blockquote body center dd details dialog div dl dt fieldset figure footer "
                       "form header li main menu nav ol search section table tbody td th tr ul button".split())
BLOCKS = CONTAINERS | frozenset("address caption figcaption h1 h2 h3 h4 h5 h6 hr html legend optgroup option p "
                                "pre summary tfoot thead".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
DROPPED_TAGS = frozenset("aside button dialog footer form menu nav search".split())
ARTICLE_TAGS = frozenset("article main".split())
ARTICLE_NAMES = frozenset("article articlebody content entry main post story".split())
# Names of boilerplate wherever they stand in a compound ("comment-list").
ANYWHERE_NAMES = frozenset("adsense advert advertisement advertisements adverts comment comments cookie cookies "
                           "disqus gdpr".split())
# Names of boilerplate alone or as the last part of a compound ("main-nav"); as another part, a hint.
LAST_NAMES = frozenset(
    "ad ads breadcrumb breadcrumbs complementary contentinfo footer menu modal nav navbar navigation pager "
    "pagination popup promo promotion sidebar sponsor sponsored subscribe subscription teaser".split())
# Hints, alone or as a part: what such an element holds decides.
HINT_NAMES = LAST_NAMES | frozenset(
    "alert author banner bio consent copyright dialog discussion login newsletter notice notification recommended "
    "related replies reply respond search share sharing social tags toc toolbar".split())
TAXONOMY = frozenset("category tag".split())  # "category-ads" says what a text is about, not what it is
PAGE_NAMES = frozenset("banner header masthead topbar".split())  # of a header outside articles
STATES = frozenset("has with no not without is hide show open opened closed on off enabled disabled".split())
ARTICLE_KINDS = frozenset("ad advert advertisement comment comments".split())  # article elements that are no article

UNHINTED = 10_000  # stands for words of running text where no name hints at boilerplate

_QUOTED = r"""[^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*"""
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<svg(?![\w:-]){_QUOTED}(?<=/)>"
    r"|<(?P<raw>script|style|template|noscript|svg|annotation|annotation-xml|iframe|object|textarea|title|select|canvas|audio|"
    rf"video)(?![\w:-]){_QUOTED}>"
    r".*?(?:</(?P=raw)\s*>|\Z)"
    rf"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>{_QUOTED})>"
    r"|</?(?P<loose>[a-zA-Z][a-zA-Z0-9:-]*)[^>]*>"
    r"|<[!?/][^>]*>"
    r"|<[a-zA-Z!?/][^>]*\Z", re.S | re.I)
_NAMED = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_HIDDEN = re.compile(r"(?:\s|^)hidden(?=[\s=/]|$)|display\s*:\s*none", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass
class Block:
    text: str
    words: int
    link_words: int
    dropped: int    # 2 under an element of boilerplate, 1 under a name of it
    article: bool
    heading: bool
    running: int = UNHINTED  # under a name of, or a hint at boilerplate: most words outside links of a block there
    rest: int = 0   # most words outside links of a block of the page that no boilerplate kind or name is over

    @property
    def link_density(self) -> float:
        return self.link_words / self.words if self.words else 0.0


@functools.lru_cache(1 << 12)
def _parts(token: str) -> tuple[str, ...]:
    return tuple(part.lower() for part in _PARTS.findall(token))


def _kind(tag: str, attrs: str, article: bool) -> tuple[int, bool, bool]:
    """Kind of an element (2: of boilerplate by itself, 1: has such a name, 0), whether it has a
    name that hints at boilerplate, and whether it is an article.

    A compound that names a state ("has-sidebar") or a subject ("tag-cookies") says nothing
    of what the element is.
    """
    names, hint = set(), False
    own_article = tag in ARTICLE_TAGS
    whole = set()
    for m in _NAMED.finditer(attrs):
        for token in (m[1] or m[2] or m[3] or "").split():
            found = _parts(token)
            own_article = own_article or not ARTICLE_NAMES.isdisjoint(found)
            if len(found) == 1:
                whole.update(found)
            if not found or not STATES.isdisjoint(found) or len(found) > 1 and found[0] in TAXONOMY:
                continue
            names.update(ANYWHERE_NAMES.intersection(found), LAST_NAMES.intersection(found[-1:]))
            hint = hint or not HINT_NAMES.isdisjoint(found) or not article and not PAGE_NAMES.isdisjoint(found)
    hidden = bool(attrs and _HIDDEN.search(attrs))
    if tag in ARTICLE_TAGS:
        return 2 if hidden or tag == "article" and whole & ARTICLE_KINDS else 0, False, True
    if hidden or tag in DROPPED_TAGS or tag == "header" and not article:
        return 2, False, own_article
    if names or not article and whole & (PAGE_NAMES | {"widget", "widgets"}):
        return 1, True, own_article
    return 0, hint and not whole & ARTICLE_NAMES, own_article


def blocks(page: str | None) -> list[Block]:
    """The text blocks of a whole page in order, with character references decoded."""
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, int, bool, int]] = []  # open containers: tag, dropped, article, hinted element or 0
    outer, most = [0], [0]  # of each hinted element: the one around it, most words outside links in a block
    own: list[int] = []     # hinted element of each block
    words: list[str] = []
    links: list[str] = []
    rest = 0
    state = {"link": False, "heading": False, "dropped": 0, "hint": 0}

    def flush() -> None:
        nonlocal rest
        text = "".join(words).split()
        if text:
            _, dropped, article, hint = stack[-1] if stack else ("", 0, False, 0)
            block = Block(" ".join(text), len(text), len("".join(links).split()),
                          max(dropped, state["dropped"]), article, state["heading"])
            out.append(block)
            own.append(state["hint"] or hint)
            if block.dropped < 2:
                most[own[-1]] = max(most[own[-1]], block.words - block.link_words)
            if block.dropped == 0:
                rest = max(rest, block.words - block.link_words)
        words.clear()
        links.clear()
        state["heading"], state["dropped"], state["hint"] = False, 0, 0

    def hinted(around: int) -> int:
        outer.append(around)
        most.append(0)
        return len(outer) - 1

    def say(segment: str) -> None:
        if segment:
            segment = html.unescape(segment) if "&" in segment else segment
            words.append(segment)
            if state["link"]:
                links.append(segment)

    at = 0
    for m in _TOKEN.finditer(page):
        say(page[at:m.start()])
        at = m.end()
        tag = (m["tag"] or m["loose"] or "").lower()
        if not tag:
            continue
        end, attrs = page[m.start() + 1] == "/", m["attrs"] or ""
        if tag == "a":
            state["link"] = not end
            if links:
                links.append(" ")
        elif tag == "br":
            words.append("\n")
        elif tag in BLOCKS:
            flush()
            if tag in CONTAINERS:
                state["link"] = False
                if end:
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i][0] == tag:
                            del stack[i:]
                            break
                else:
                    _, dropped, article, hint = stack[-1] if stack else ("", 0, False, 0)
                    own_dropped, own_hint, own_article = _kind(tag, attrs, article)
                    if tag == "body":
                        own_dropped, own_hint, own_article = 0, False, False
                    stack.append((tag, max(dropped, own_dropped), article or own_article,
                                  hinted(hint) if own_hint else hint))
            elif not end:
                state["heading"] = tag in HEADINGS
                if attrs:
                    state["dropped"], own_hint, _ = _kind(tag, attrs, bool(stack and stack[-1][2]))
                    state["hint"] = hinted(stack[-1][3] if stack else 0) if own_hint else 0
    say(page[at:])
    flush()
    for i in range(len(outer) - 1, 0, -1):  # an element comes after the one around it
        most[outer[i]] = max(most[outer[i]], most[i])
    for block, i in zip(out, own):
        block.rest = rest
        if i:
            block.running = most[i]
    return out


#: Labelled blocks. Words and link density of the block, of the one before and
#: of the one after (0, 0 at an end of the page); kind, article, heading; most words outside
#: links of a block under the same name or hint (UNHINTED if none) and of a block of the
#: page that no boilerplate kind or name is over; main text.
FEATURES = ("words", "link", "words_before", "link_before", "words_after", "link_after",
            "dropped", "article", "heading", "running", "rest")
LABELLED: list[tuple[float, ...]] = [
    # Menus, footers, sidebars, adverts, notices, forms and comments in containers of their kind.
    (1, 1.0, 0, 0.0, 1, 1.0, 2, 0, 0, UNHINTED, 45, 0),
    (1, 1.0, 1, 1.0, 1, 1.0, 2, 0, 0, UNHINTED, 45, 0),
    (2, 1.0, 1, 1.0, 9, 0.0, 2, 0, 0, UNHINTED, 45, 0),
    (9, 0.0, 2, 1.0, 11, 0.0, 2, 0, 0, UNHINTED, 45, 0),
    (8, 0.0, 120, 0.0, 0, 0.0, 2, 0, 0, UNHINTED, 120, 0),
    (14, 0.0, 60, 0.0, 0, 0.0, 2, 0, 0, UNHINTED, 60, 0),
    (40, 0.0, 35, 0.0, 28, 0.0, 2, 0, 0, UNHINTED, 45, 0),
    (55, 0.1, 3, 0.0, 61, 0.0, 2, 1, 0, UNHINTED, 61, 0),
    (24, 0.0, 4, 0.0, 30, 0.0, 2, 1, 0, UNHINTED, 45, 0),
    (3, 0.0, 24, 0.0, 80, 0.0, 2, 1, 1, UNHINTED, 80, 0),
    (2, 0.0, 70, 0.0, 12, 1.0, 2, 0, 1, UNHINTED, 70, 0),
    (90, 0.0, 80, 0.0, 75, 0.0, 2, 1, 0, UNHINTED, 80, 0),
    (16, 0.2, 45, 0.0, 5, 1.0, 2, 0, 0, UNHINTED, 45, 0),
    (6, 0.5, 1, 1.0, 44, 0.0, 2, 0, 0, UNHINTED, 45, 0),
    # Article text: long and short paragraphs, headings, list items, a few links.
    (10, 0.0, 9, 0.0, 40, 0.0, 0, 1, 1, UNHINTED, 40, 1),
    (10, 0.0, 11, 0.0, 1, 0.0, 0, 1, 0, UNHINTED, 11, 1),
    (1, 0.0, 34, 0.0, 50, 0.0, 0, 1, 0, UNHINTED, 50, 1),
    (1, 0.0, 1, 0.0, 2, 0.0, 0, 1, 0, UNHINTED, 2, 1),
    (1, 0.0, 60, 0.0, 12, 0.0, 0, 1, 0, UNHINTED, 60, 1),
    (2, 0.0, 8, 0.0, 14, 0.0, 0, 1, 0, UNHINTED, 14, 1),
    (3, 0.0, 90, 0.0, 45, 0.0, 0, 1, 1, UNHINTED, 90, 1),
    (25, 0.04, 30, 0.0, 28, 0.1, 0, 1, 0, UNHINTED, 30, 1),
    (64, 0.0, 10, 0.0, 71, 0.0, 0, 1, 0, UNHINTED, 71, 1),
    (130, 0.02, 64, 0.0, 9, 0.0, 0, 1, 0, UNHINTED, 127, 1),
    (300, 0.0, 12, 0.0, 8, 0.0, 0, 1, 0, UNHINTED, 300, 1),
    (18, 0.28, 70, 0.0, 52, 0.05, 0, 1, 0, UNHINTED, 70, 1),
    (6, 0.0, 5, 0.0, 0, 0.0, 0, 1, 0, UNHINTED, 6, 1),
    (45, 0.0, 0, 0.0, 0, 0.0, 0, 1, 0, UNHINTED, 45, 1),
    (7, 0.3, 40, 0.0, 33, 0.0, 0, 1, 0, UNHINTED, 40, 1),
    # Link lists inside an article.
    (4, 1.0, 50, 0.0, 5, 1.0, 0, 1, 0, UNHINTED, 50, 0),
    (5, 1.0, 4, 1.0, 6, 1.0, 0, 1, 0, UNHINTED, 0, 0),
    (6, 1.0, 5, 1.0, 12, 0.0, 0, 1, 0, UNHINTED, 12, 0),
    (8, 0.9, 80, 0.0, 30, 0.0, 0, 1, 0, UNHINTED, 80, 0),
    (3, 0.67, 22, 0.0, 4, 1.0, 0, 1, 0, UNHINTED, 22, 0),
    # Pages without an article element: text.
    (60, 0.0, 8, 0.0, 45, 0.0, 0, 0, 0, UNHINTED, 60, 1),
    (45, 0.05, 60, 0.0, 38, 0.0, 0, 0, 0, UNHINTED, 60, 1),
    (38, 0.0, 45, 0.05, 3, 1.0, 0, 0, 0, UNHINTED, 42, 1),
    (110, 0.1, 2, 1.0, 95, 0.0, 0, 0, 0, UNHINTED, 99, 1),
    (22, 0.0, 40, 0.0, 50, 0.0, 0, 0, 0, UNHINTED, 50, 1),
    (5, 0.0, 48, 0.0, 52, 0.0, 0, 0, 0, UNHINTED, 52, 1),
    (2, 0.0, 36, 0.0, 41, 0.0, 0, 0, 0, UNHINTED, 41, 1),
    (4, 0.0, 3, 1.0, 66, 0.0, 0, 0, 1, UNHINTED, 66, 1),
    (9, 0.0, 2, 1.0, 58, 0.0, 0, 0, 1, UNHINTED, 58, 1),
    (20, 0.15, 55, 0.0, 47, 0.1, 0, 0, 0, UNHINTED, 55, 1),
    (33, 0.0, 9, 0.0, 6, 0.5, 0, 0, 0, UNHINTED, 33, 1),
    (28, 0.0, 4, 1.0, 31, 0.0, 0, 0, 0, UNHINTED, 31, 1),
    (80, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, UNHINTED, 80, 1),
    (17, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, UNHINTED, 17, 1),
    # Pages without an article element: menus, footers, teasers, labels.
    (1, 1.0, 0, 0.0, 1, 1.0, 0, 0, 0, UNHINTED, 0, 0),
    (1, 1.0, 1, 1.0, 2, 1.0, 0, 0, 0, UNHINTED, 0, 0),
    (3, 1.0, 2, 1.0, 70, 0.0, 0, 0, 0, UNHINTED, 70, 0),
    (12, 0.8, 90, 0.0, 10, 0.9, 0, 0, 0, UNHINTED, 90, 0),
    (10, 0.9, 12, 0.8, 6, 0.0, 0, 0, 0, UNHINTED, 6, 0),
    (6, 0.0, 10, 0.9, 0, 0.0, 0, 0, 0, UNHINTED, 6, 0),
    (7, 0.0, 62, 0.0, 0, 0.0, 0, 0, 0, UNHINTED, 62, 0),
    (4, 0.0, 2, 1.0, 3, 1.0, 0, 0, 1, UNHINTED, 4, 0),
    (3, 0.0, 1, 1.0, 1, 1.0, 0, 0, 0, UNHINTED, 3, 0),
    (2, 0.5, 50, 0.0, 5, 1.0, 0, 0, 0, UNHINTED, 50, 0),
    (5, 0.0, 4, 1.0, 2, 1.0, 0, 0, 0, UNHINTED, 5, 0),
    (30, 0.6, 8, 1.0, 9, 1.0, 0, 0, 0, UNHINTED, 12, 0),
    (26, 0.55, 70, 0.0, 64, 0.0, 0, 0, 0, UNHINTED, 70, 0),
    (8, 0.0, 5, 1.0, 4, 1.0, 0, 0, 0, UNHINTED, 8, 0),
    (2, 0.0, 1, 0.0, 0, 0.0, 0, 0, 0, UNHINTED, 2, 0),
    (3, 0.0, 6, 0.0, 5, 0.0, 0, 0, 0, UNHINTED, 6, 0),
    (2, 0.0, 3, 0.0, 2, 0.0, 0, 0, 1, UNHINTED, 3, 0),
    # Under a name that hints at boilerplate, no running text: share lines, author lines, notices, tags.
    (4, 0.0, 60, 0.0, 45, 0.0, 0, 1, 0, 4, 60, 0),
    (3, 0.0, 90, 0.0, 50, 0.0, 0, 1, 1, 3, 90, 0),
    (12, 0.0, 40, 0.0, 33, 0.0, 0, 1, 0, 12, 40, 0),
    (16, 0.05, 3, 0.0, 70, 0.0, 0, 1, 0, 16, 70, 0),
    (3, 0.0, 9, 0.0, 60, 0.0, 0, 1, 0, 3, 60, 0),
    (2, 1.0, 60, 0.0, 3, 1.0, 0, 1, 0, 0, 60, 0),
    (9, 0.1, 8, 1.0, 50, 0.0, 0, 0, 0, 9, 50, 0),
    (16, 0.0, 44, 0.0, 0, 0.0, 0, 0, 0, 16, 44, 0),
    (4, 0.0, 70, 0.0, 55, 0.0, 0, 0, 1, 4, 70, 0),
    (14, 0.0, 50, 0.0, 30, 0.0, 0, 0, 0, 14, 50, 0),
    (4, 0.0, 11, 0.0, 2, 0.0, 0, 1, 0, 4, 11, 0),
    (2, 0.0, 9, 0.0, 30, 0.0, 0, 1, 0, 2, 30, 0),
    (1, 0.0, 4, 0.0, 5, 0.0, 0, 1, 1, 5, 5, 0),
    (5, 0.0, 1, 0.0, 0, 0.0, 0, 1, 0, 5, 5, 0),
    (15, 0.0, 22, 0.0, 9, 0.0, 0, 0, 0, 15, 22, 0),
    (7, 0.0, 14, 0.0, 6, 0.0, 0, 1, 0, 14, 14, 0),
    (16, 0.0, 0, 0.0, 64, 0.0, 0, 0, 0, 16, 64, 0),
    # Under such a name, running text, with its headings and short lines, but not its link lists.
    (60, 0.0, 12, 0.0, 45, 0.0, 0, 1, 0, 70, 70, 1),
    (36, 0.05, 40, 0.0, 0, 0.0, 0, 1, 0, 36, 40, 1),
    (3, 0.0, 0, 0.0, 60, 0.0, 0, 1, 1, 90, 90, 1),
    (10, 0.0, 31, 0.0, 8, 0.0, 0, 1, 0, 31, 31, 1),
    (2, 0.0, 12, 0.0, 2, 0.0, 0, 1, 0, 48, 48, 1),
    (14, 0.0, 6, 0.0, 12, 0.0, 0, 1, 0, 25, 25, 1),
    (7, 0.0, 26, 0.0, 0, 0.0, 0, 1, 0, 26, 26, 1),
    (9, 0.1, 44, 0.0, 60, 0.0, 0, 0, 0, 60, 60, 1),
    (12, 0.0, 22, 0.0, 90, 0.0, 0, 0, 0, 90, 90, 1),
    (6, 0.0, 70, 0.0, 45, 0.0, 0, 1, 0, 70, 70, 1),
    (5, 0.0, 48, 0.0, 52, 0.0, 0, 0, 0, 52, 52, 1),
    (22, 0.0, 3, 0.0, 23, 0.0, 0, 1, 0, 22, 23, 1),
    (22, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 22, 22, 1),
    (80, 0.1, 5, 1.0, 75, 0.0, 0, 0, 0, 120, 120, 1),
    (4, 0.0, 3, 1.0, 66, 0.0, 0, 0, 1, 66, 66, 1),
    (5, 0.9, 60, 0.0, 4, 1.0, 0, 1, 0, 60, 60, 0),
    (3, 1.0, 4, 1.0, 3, 1.0, 0, 0, 0, 60, 60, 0),
    # Under a name of boilerplate, on a page that has running text elsewhere: menus, comments, adverts.
    (24, 0.0, 4, 0.0, 30, 0.0, 1, 1, 0, 30, 60, 0),
    (3, 0.0, 24, 0.0, 80, 0.0, 1, 1, 1, 24, 80, 0),
    (9, 0.0, 2, 1.0, 11, 0.0, 1, 0, 0, 9, 40, 0),
    (90, 0.0, 80, 0.0, 75, 0.0, 1, 1, 0, 90, 75, 0),
    (1, 1.0, 1, 1.0, 1, 1.0, 1, 0, 0, 0, 35, 0),
    (22, 0.0, 26, 0.0, 26, 0.0, 1, 0, 0, 22, 26, 0),
    (35, 0.1, 3, 0.0, 0, 0.0, 1, 0, 0, 60, 22, 0),
    (3, 0.0, 10, 0.0, 2, 0.0, 1, 1, 0, 3, 10, 0),
    (8, 0.0, 6, 0.0, 0, 0.0, 1, 0, 0, 8, 6, 0),
    (16, 0.0, 12, 0.0, 3, 0.0, 1, 0, 0, 16, 12, 0),
    (2, 1.0, 8, 0.0, 2, 1.0, 1, 0, 0, 8, 0, 0),
    (7, 0.0, 1, 1.0, 0, 0.0, 1, 0, 0, 7, 2, 0),
    # Under such a name, where the page has no other running text: its text, not its links.
    (60, 0.0, 12, 0.0, 45, 0.0, 1, 0, 0, 70, 4, 1),
    (26, 0.0, 1, 1.0, 4, 0.0, 1, 0, 0, 26, 4, 1),
    (26, 0.0, 0, 0.0, 0, 0.0, 1, 0, 0, 26, 0, 1),
    (22, 0.05, 9, 0.0, 23, 0.0, 1, 0, 0, 23, 9, 1),
    (3, 0.0, 1, 1.0, 60, 0.0, 1, 0, 1, 60, 6, 1),
    (10, 0.0, 31, 0.0, 8, 0.0, 1, 1, 0, 31, 0, 1),
    (40, 0.0, 38, 0.0, 52, 0.1, 1, 1, 0, 90, 0, 1),
    (5, 1.0, 60, 0.0, 4, 1.0, 1, 0, 0, 60, 3, 0),
    (1, 1.0, 1, 1.0, 26, 0.0, 1, 0, 0, 26, 0, 0),
    # Text before links, and after and between long blocks, is text.
    (22, 0.0, 22, 0.0, 2, 1.0, 0, 1, 0, UNHINTED, 22, 1),
    (26, 0.0, 26, 0.0, 1, 1.0, 0, 0, 0, UNHINTED, 26, 1),
    (10, 0.0, 8, 0.0, 3, 1.0, 0, 1, 0, UNHINTED, 40, 1),
    (60, 0.0, 40, 0.0, 4, 1.0, 0, 0, 0, UNHINTED, 60, 1),
    (24, 0.0, 0, 0.0, 5, 1.0, 0, 1, 0, UNHINTED, 24, 1),
    (5, 0.0, 30, 0.0, 2, 1.0, 0, 1, 0, UNHINTED, 40, 1),
    (28, 0.1, 35, 0.0, 6, 1.0, 0, 0, 0, UNHINTED, 35, 1),
    (40, 0.0, 62, 0.0, 35, 0.0, 0, 1, 0, UNHINTED, 62, 1),
    (12, 0.0, 62, 0.0, 0, 0.0, 0, 1, 0, UNHINTED, 62, 1),
    (2, 0.0, 62, 0.0, 3, 0.0, 0, 1, 0, UNHINTED, 90, 1),
    (30, 0.0, 62, 0.0, 12, 0.0, 0, 0, 0, UNHINTED, 62, 1),
    (30, 0.0, 63, 0.0, 0, 0.0, 0, 0, 0, UNHINTED, 63, 1),
    (48, 0.0, 150, 0.0, 200, 0.0, 0, 1, 0, UNHINTED, 200, 1),
    # Pages that hold no more than some words.
    (5, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, UNHINTED, 5, 1),
    (9, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, UNHINTED, 9, 1),
    (3, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, UNHINTED, 3, 1),
    (1, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, UNHINTED, 1, 1),
    # Linked paragraphs and reference lists of an article.
    (26, 1.0, 30, 0.0, 28, 0.0, 0, 1, 0, UNHINTED, 30, 1),
    (18, 0.9, 44, 0.0, 60, 0.0, 0, 1, 0, UNHINTED, 60, 1),
    (16, 1.0, 40, 0.0, 15, 1.0, 0, 1, 0, UNHINTED, 40, 1),
    (14, 1.0, 13, 1.0, 16, 1.0, 0, 1, 0, UNHINTED, 40, 1),
    (15, 0.85, 16, 1.0, 0, 0.0, 0, 1, 0, UNHINTED, 32, 1),
    (7, 1.0, 8, 1.0, 6, 1.0, 0, 1, 0, UNHINTED, 50, 0),
    (9, 1.0, 60, 0.0, 7, 1.0, 0, 1, 0, UNHINTED, 60, 0),
]


@dataclass(frozen=True)
class Tree:
    """A split (feature, cut, low, high) or a leaf (answer)."""

    feature: int = -1
    cut: float = 0.0
    low: Tree | None = None
    high: Tree | None = None
    answer: bool = False

    def keeps(self, row) -> bool:
        node = self
        while node.feature >= 0:
            node = node.low if row[node.feature] <= node.cut else node.high
        return node.answer


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8) -> Tree:
    """Classification tree by Gini impurity; a cut lies halfway between neighbouring values."""
    if depth == 0 or y.all() or not y.any():
        return Tree(answer=bool(2 * y.sum() >= len(y)))
    best = (np.inf, -1, 0.0)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= cut
            cost = sum(part.sum() * (1 - part.mean()) for part in (y[low], y[~low]))
            if cost < best[0] - 1e-12:
                best = (cost, f, float(cut))
    _, f, cut = best
    if f < 0:
        return Tree(answer=bool(2 * y.sum() >= len(y)))
    low = x[:, f] <= cut
    return Tree(f, cut, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1))


def train(labelled: list[tuple[float, ...]] = LABELLED) -> Tree:
    table = np.array(labelled, float)
    return grow(table[:, :-1], table[:, -1].astype(bool))


def features(page: list[Block]) -> list[tuple[float, ...]]:
    own = [(b.words, b.link_density) for b in page]
    around = [(0, 0.0), *own, (0, 0.0)]
    return [(*own[i], *around[i], *around[i + 2], b.dropped, b.article, b.heading,
             b.running, b.rest) for i, b in enumerate(page)]


def main_text(page: str | None, tree: Tree) -> str:
    found = blocks(page)
    return " ".join(b.text for b, row in zip(found, features(found)) if tree.keeps(row))


def extract(pages: DataFrame, tree: Tree | None = None) -> DataFrame:
    """Add text (main text of the whole html) and n_chars (its code points) to every page.

    Kept blocks are joined in page order by one blank; white space inside a block is one
    blank. A null or empty page, or one without main text, gives the empty string. Broken
    markup, unclosed elements and truncated pages are read as far as they go. Repeated
    rows give repeated results. Other columns pass through; ``text`` and ``n_chars`` are
    replaced. An empty table gives an empty result.
    """
    text_batches(pages.sparkSession)
    tree = tree or train()
    pages = pages.drop("text", "n_chars")

    def run(batches):
        for batch in batches:
            texts = [main_text(h.as_py(), tree) for h in batch["html"]]
            yield (batch.append_column("text", pa.array(texts, pa.string()))
                   .append_column("n_chars", pa.array([len(t) for t in texts], pa.int64())))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema)
    return pages.mapInArrow(run, schema + ", text string, n_chars long")
