"""Main text of web pages by composite text density.

A page becomes a tree. Elements that are something else than the article (menus,
headers, footers, sidebars, adverts; by tag or role) leave it, with scripts, styles
and markup. Forms, and elements that a class or id names as such or as notices or
reader comments, leave it unless they hold more than two thirds of the page's text
(and 250 characters), most of it outside of links; then they are wrappers, stay, and their text counts a
quarter. Where nothing but such elements has text, they stay too. A name counts by
its last word (not ``related-work``) and not after has, with, no and the like. Every
other node gets its link-adjusted density of characters per
tag, and the sum of its children's densities. The node with the largest sum is
the core of the article; the smallest density on the path from it up to the body
is the threshold for taking in its surroundings: while a neighbour of the subtree
reaches it and holds blocks of its own, the subtree grows to the parent. It also
does for a heading before it, its title, but not up to the body.

Where a page marks articles (else a main part) and they hold half of its text or
more, the search stays in the mark, or in what several marks have in common. Up to
there a heading, or a neighbour that reaches half the threshold, lets the subtree
grow. Marks with less text than that, such as teasers, bound nothing.

Inside the subtree nothing is dropped. White space within a block becomes one
space; blocks are joined by one space in page order.

Defined results: a NULL or empty page, or one without text, gives an empty text;
broken, cut off or deeply nested markup is read as far as it goes; rows are judged
one by one, other columns pass through, ``text`` and ``n_chars`` are replaced; an
empty table gives an empty result.
"""
from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr math menclose mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot "
    "mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
#: Tags whose content is never main text.
OUTSIDE = frozenset(
    "annotation annotation-xml aside audio button canvas dialog footer head header iframe input menu nav noscript object option script "
    "select style svg template textarea title video".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words of a class or id that name something beside the article.
NAMES = frozenset(
    "ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "copyright disclaimer disqus footer gdpr header legal login masthead menu modal nav navbar navigation newsletter notice "
    "notices pager pagination popup promo promotion recommended related replies respond share sharing sidebar signup skip "
    "social sponsor sponsored subscribe subscription toolbar topbar widget".split())
#: Last words of a class or id that say nothing about what it holds, and words that say a page has (or lacks) it.
GENERIC = frozenset(
    "area articles bar block body box button buttons card cards col column container content grid group icon icons inner item items "
    "left link links list outer panel posts right row section slot stories text top unit wrap wrapper".split())
RELATIVE = frozenset("has have hide is no not on show with without".split())
#: A named element with a larger share of the page's text, and more characters, is a wrapper, whose text has this weight.
WRAPPER, SMALL, WEIGHT = 2 / 3, 250, 0.25
LANDMARKS = ("article", "main")
#: What a head may hold; anything else ends a head whose end tag is left out.
HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
_KEPT = frozenset(("html", "body", "article", "main"))
#: A start tag that closes an open element of the same kind, up to these borders.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
           "th": ("td", "th"), "option": ("option",)}
_BORDERS = frozenset("html body article main section div table ul ol dl blockquote aside nav header footer form td th".split())
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Page(HTMLParser):
    """Nodes of a page in page order, and its text in pieces; a node's pieces follow each other."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.outside, self.named, self.first, self.end = ["#page"], [-1], [False], [False], [0], [0]
        self.pieces: list[str | None] = []  # None: a border between blocks
        self.owner: list[int] = []
        self.open = [0]
        self.feed(re.sub(r"<!\[[^>]*>", "", html))
        self.close()
        self._shut(1)
        self.end[0] = len(self.pieces)
        # a wrapper named after a part of it (say, after its sidebar) is not that part
        self.holds = [False] * len(self.tag)
        for i in range(len(self.tag) - 1, 0, -1):
            self.holds[self.parent[i]] |= self.holds[i] or self.tag[i] in LANDMARKS

    def _add(self, piece: str | None) -> None:
        self.pieces.append(piece)
        self.owner.append(self.open[-1])

    def _shut(self, depth: int) -> None:
        while len(self.open) > depth:
            node = self.open.pop()
            if self.tag[node] not in INLINE:
                self._add(None)
            self.end[node] = len(self.pieces)

    def _close_open(self, tags: tuple[str, ...], borders: frozenset[str]) -> None:
        for depth in range(len(self.open) - 1, 0, -1):
            tag = self.tag[self.open[depth]]
            if tag in tags:
                self._shut(depth)
                return
            if tag in borders:
                return

    def _leave_head(self) -> None:
        if self.tag[self.open[-1]] == "head":
            self._shut(len(self.open) - 1)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in HEAD:
            self._leave_head()
        if tag in _CLOSES:
            self._close_open(_CLOSES[tag], _BORDERS - {"td", "th"} if tag == "tr" else _BORDERS - {tag})
        elif tag not in INLINE and tag != "br":
            self._close_open(("p",), _BORDERS)
        if tag == "br" or (tag in VOID and tag not in INLINE):
            self._add(None)
        if tag in VOID:
            return
        if tag not in INLINE:
            self._add(None)
        self.parent.append(self.open[-1])
        self.open.append(len(self.tag))
        self.tag.append(tag)
        self.outside.append(tag in OUTSIDE or (tag not in _KEPT and beside(attrs)))
        self.named.append(tag == "form" or (tag not in _KEPT and named(attrs)))
        self.first.append(len(self.pieces))
        self.end.append(0)

    def handle_endtag(self, tag: str) -> None:
        borders = _BORDERS if tag in INLINE or tag == "p" else frozenset()
        self._close_open((tag,), borders)

    def handle_data(self, data: str) -> None:
        if not data.isspace():
            self._leave_head()
        self._add(data)


def beside(attrs: list[tuple[str, str | None]]) -> bool:
    for name, value in attrs:
        v = value or ""
        if name == "hidden" or (name == "aria-hidden" and v == "true") or (name == "role" and v.lower() in ROLES):
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", v, re.I):
            return True
    return False


def leaves(page: Page, i: int) -> bool:
    """Whether a node leaves the tree by its tag or role."""
    return page.outside[i] and not (page.holds[i] and page.tag[i] not in OUTSIDE)


def named(attrs: list[tuple[str, str | None]]) -> bool:
    """Whether a class or id names something beside the article."""
    for name, value in attrs:
        if name in ("class", "id"):
            for token in (value or "").split():
                words = [w.lower() for w in _WORDS.findall(token)]
                while len(words) > 1 and words[-1] in GENERIC:
                    words.pop()
                if words and words[-1] in NAMES and RELATIVE.isdisjoint(words[:-1]):
                    return True
    return False


def without_names(page: Page) -> list[bool]:
    """Which named elements leave the tree."""
    n = len(page.tag)
    shown, linked, chars, link_chars = [True] * n, [False] * n, [0] * n, [0] * n
    for i in range(1, n):
        up = page.parent[i]
        shown[i] = shown[up] and not leaves(page, i)
        linked[i] = linked[up] or page.tag[i] == "a"
    for piece, i in zip(page.pieces, page.owner, strict=True):
        if piece is not None and shown[i]:
            size = len("".join(piece.split()))
            chars[i] += size
            link_chars[i] += size * linked[i]
    own = chars[:]
    for i in range(n - 1, 0, -1):
        chars[page.parent[i]] += chars[i]
        link_chars[page.parent[i]] += link_chars[i]
    gone = [page.named[i] and (chars[i] <= max(WRAPPER * chars[0], SMALL) or 2 * link_chars[i] >= chars[i]) for i in range(n)]
    left = [True] * n
    for i in range(1, n):
        left[i] = left[page.parent[i]] and not gone[i]
    return gone if any(c for c, here in zip(own, left, strict=True) if here) else [False] * n


def density(chars: int, tags: int, link_chars: int, link_tags: int, body_ratio: float) -> float:
    """Characters per tag, damped where links hold much of the text or of the tags."""
    if not chars:
        return 0.0
    plain, linked, link_tags = max(chars - link_chars, 1), max(link_chars, 1), max(link_tags, 1)
    base = math.log(chars / plain * link_chars + body_ratio * chars + math.e)
    return chars / max(tags, 1) * math.log(max(chars / linked * max(tags, 1) / link_tags, 1 + 1e-9)) / math.log(max(base, 1 + 1e-9))


def extract(html: str | None) -> str:
    """The main text of one page."""
    if not html:
        return ""
    page = Page(html)
    n = len(page.tag)
    kept, linked = [True] * n, [False] * n
    gone = without_names(page) if any(page.named) else page.named
    weight = [1.0] * n
    for i in range(1, n):
        up = page.parent[i]
        kept[i] = kept[up] and not (leaves(page, i) or (gone[i] and not page.holds[i]))
        weight[i] = WEIGHT if page.named[i] else weight[up]
        linked[i] = linked[up] or page.tag[i] == "a"
    chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    for piece, i in zip(page.pieces, page.owner, strict=True):
        if piece is not None and kept[i]:
            size = len("".join(piece.split()))
            chars[i] += size
            link_chars[i] += size * linked[i]
    for i in range(n - 1, 0, -1):
        if kept[i]:
            up = page.parent[i]
            chars[up] += chars[i]
            link_chars[up] += link_chars[i]
            tags[up] += tags[i] + 1
            link_tags[up] += link_tags[i] + (page.tag[i] == "a")
    if not chars[0]:
        return ""
    ratio = link_chars[0] / chars[0]
    dense = [density(chars[i], tags[i], link_chars[i], link_tags[i], ratio) if kept[i] else 0.0 for i in range(n)]
    dense = [d * w for d, w in zip(dense, weight, strict=True)]
    sums = [0.0] * n
    for i in range(1, n):
        sums[page.parent[i]] += dense[i]
    body = next((i for i in range(n) if page.tag[i] == "body" and kept[i] and chars[i]), 0)
    bound, marked = bounded(page, kept, chars, body)
    inside = [False] * n
    for i in range(n):
        inside[i] = kept[i] and (i == bound or (i > bound and inside[page.parent[i]]))
    best = max((i for i in range(n) if inside[i] and chars[i]), key=lambda i: (sums[i], chars[i], -i))
    best = grown(page, dense, sums, kept, best, body, bound if marked else None)
    words, text = [], []
    for piece, i in zip(page.pieces[page.first[best]:page.end[best]], page.owner[page.first[best]:page.end[best]], strict=True):
        if piece is None:
            words += "".join(text).split()
            text = []
        elif kept[i]:
            text.append(piece)
    return " ".join(words + "".join(text).split())


def bounded(page: Page, kept: list[bool], chars: list[int], body: int) -> tuple[int, bool]:
    """The mark that holds half of the text or more, or the lowest node around several such marks; else the body (and False)."""
    for tag in LANDMARKS:
        marks, inner = [], [False] * len(kept)
        for i in range(1, len(kept)):
            inner[i] = inner[page.parent[i]] or page.tag[page.parent[i]] == tag
            if page.tag[i] == tag and kept[i] and chars[i] and not inner[i]:
                marks.append(i)
        if marks and 2 * sum(chars[i] for i in marks) >= chars[0]:
            low = marks[0]
            while any(page.end[low] < page.end[i] for i in marks):  # marks[0] is the first of them in page order
                low = page.parent[low]
            return low, True
    return body, False


def grown(page: Page, dense: list[float], sums: list[float], kept: list[bool], best: int, body: int, bound: int | None) -> int:
    """The largest subtree around ``best`` whose added neighbours reach the threshold of the path to the body.

    A bound set by marks of the page is not left; in it they speak for its parts.
    """
    parent, path = page.parent, [best]
    while path[-1] != body and parent[path[-1]] >= 0:
        path.append(parent[path[-1]])
    threshold = min(dense[i] for i in path)
    if bound is None:
        reaches = lambda i: sums[i] > 0 and dense[i] >= threshold
    else:
        path = path[:path.index(bound) + 1] if bound in path else path
        reaches = lambda i: dense[i] > 0 and (2 * dense[i] >= threshold or page.tag[i] in HEADINGS)
    beside_path = {i: [] for i in path[1:]}
    for i, up in enumerate(parent):
        if up in beside_path and i not in path and kept[i]:
            beside_path[up].append(i)
    for low, up in zip(path, path[1:], strict=False):
        title = up != body and any(i < low and page.tag[i] in HEADINGS and dense[i] > 0 for i in beside_path[up])
        if title or any(reaches(i) for i in beside_path[up]):
            best = up
        elif best != low and bound is None:
            break
    return best


def main_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` without the column of markup, with ``text`` (the main text) and ``n_chars`` (its code points)."""
    rows = pages.drop(*({"text", "n_chars"} - {html}))
    rest = [c for c in rows.columns if c != html]
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.select(*[f"`{c}`" for c in rest]).dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(h) for h in b.column(html).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in rest), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=[*rest, "text", "n_chars"])
    return rows.mapInArrow(run, f"{kinds}{', ' * bool(kinds)}text string, n_chars long")
