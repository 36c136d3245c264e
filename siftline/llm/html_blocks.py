"""Main text of web pages from flat text blocks.

A page is cut into blocks at block-level tags, in page order and without a tree. Each block is described by its own word count and
link density, those of its neighbours, and where it stands: inside an article, inside a part such as a menu or advert, and how much
of the page's text outside such parts its articles hold. A decision tree, grown from the small labelled table below, says which
blocks are content.

Parts are known by tag, role, or a word of class or id. What a word or a form says is only a hint: an element that holds an article
of its own, or most of a page's text where no article stands outside of it, is no part. Nor is one that has no end tag, but for those that need none.

Character references are decoded, runs of white space inside a block become one space, and blocks are joined by an empty line.
A null or empty html, or one without content, gives the empty string. Repeated rows each get a row; a null page_id or url stays
null. An empty table gives an empty result. Only page_id, url and html are read. Time and memory are linear in the page.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm._shared import small_batches, text_of

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "in_article", "in_part", "article_share")

#: words, link density, those of the block before and after, in an article, in a part that is not main text, share of the page's text
#: (outside such parts) that its articles hold: content.
LABELLED = (
    # Pages whose article holds their text: long and short paragraphs, titles, list entries, links, whatever stands beside them.
    (85, 0.00, 9, 0.00, 60, 0.00, 1, 0, 1.0, 1), (60, 0.03, 85, 0.00, 72, 0.00, 1, 0, 0.9, 1), (9, 0.00, 6, 1.00, 85, 0.00, 1, 0, 1.0, 1),
    (1, 0.00, 70, 0.00, 55, 0.00, 1, 0, 1.0, 1), (2, 0.00, 1, 1.00, 40, 0.00, 1, 0, 0.8, 1), (4, 1.00, 60, 0.00, 33, 0.00, 1, 0, 1.0, 1),
    (12, 0.50, 40, 0.00, 45, 0.00, 1, 0, 0.95, 1), (3, 0.00, 5, 0.00, 0, 0.00, 1, 0, 1.0, 1), (40, 0.00, 40, 0.00, 1, 1.00, 1, 0, 1.0, 1),
    (40, 0.00, 0, 0.00, 2, 1.00, 1, 0, 1.0, 1), (5, 0.00, 30, 0.00, 1, 1.00, 1, 0, 0.7, 1), (14, 0.00, 1, 1.00, 1, 1.00, 1, 0, 0.9, 1),
    (22, 0.00, 2, 1.00, 3, 1.00, 1, 0, 1.0, 1), (1, 1.00, 2, 1.00, 2, 1.00, 1, 0, 0.9, 1), (6, 0.00, 0, 0.00, 0, 0.00, 1, 0, 1.0, 1),
    # Menus, footers, adverts, notices, forms, comments: in or out of the article, with few or many words.
    (1, 1.00, 1, 1.00, 1, 1.00, 0, 1, 1.0, 0), (3, 1.00, 2, 1.00, 9, 0.00, 0, 1, 1.0, 0), (12, 0.00, 3, 1.00, 10, 0.00, 0, 1, 0.9, 0),
    (16, 0.00, 40, 0.00, 0, 0.00, 0, 1, 1.0, 0), (45, 0.00, 30, 0.00, 50, 0.00, 0, 1, 0.8, 0), (38, 0.00, 60, 0.00, 44, 0.00, 1, 1, 1.0, 0),
    (5, 1.00, 80, 0.00, 4, 1.00, 1, 1, 1.0, 0), (90, 0.00, 25, 0.00, 70, 0.00, 1, 1, 0.9, 0), (8, 0.00, 66, 0.00, 61, 0.00, 1, 1, 1.0, 0),
    (2, 0.00, 30, 0.00, 3, 0.00, 1, 1, 0.2, 0), (70, 0.00, 0, 0.00, 65, 0.00, 0, 1, 0.0, 0), (25, 0.10, 12, 0.20, 8, 0.50, 0, 1, 0.0, 0),
    (2, 1.00, 2, 1.00, 2, 1.00, 0, 1, 0.0, 0), (14, 0.00, 55, 0.00, 0, 0.00, 0, 1, 0.0, 0), (120, 0.00, 90, 0.00, 85, 0.00, 0, 1, 0.1, 0),
    (33, 0.00, 41, 0.00, 1, 1.00, 1, 1, 1.0, 0), (18, 0.00, 9, 0.00, 12, 0.00, 1, 1, 0.9, 0), (60, 0.05, 70, 0.00, 45, 0.00, 1, 1, 0.95, 0),
    # What stands beside an article that holds the page's text.
    (4, 0.00, 3, 1.00, 9, 0.00, 0, 0, 0.95, 0), (2, 1.00, 2, 1.00, 3, 1.00, 0, 0, 0.9, 0), (18, 0.00, 50, 0.00, 6, 1.00, 0, 0, 0.9, 0),
    (30, 0.00, 12, 0.00, 40, 0.00, 0, 0, 0.8, 0), (60, 0.00, 0, 0.00, 9, 0.00, 0, 0, 0.7, 0), (22, 0.60, 30, 0.00, 0, 0.00, 0, 0, 0.85, 0),
    (9, 0.00, 0, 0.00, 8, 0.00, 0, 0, 0.6, 0), (45, 0.00, 60, 0.00, 44, 0.00, 0, 0, 0.75, 0),
    # Pages without an article, or with short ones beside the text. Whatever has few links is text, if it is long or stands by text,
    (70, 0.00, 8, 0.00, 55, 0.00, 0, 0, 0.0, 1), (40, 0.10, 70, 0.00, 30, 0.05, 0, 0, 0.0, 1), (17, 0.00, 45, 0.00, 50, 0.00, 0, 0, 0.0, 1),
    (18, 0.00, 3, 0.00, 9, 0.00, 0, 0, 0.0, 1), (25, 0.30, 28, 0.00, 0, 0.00, 0, 0, 0.0, 1), (60, 0.00, 0, 0.00, 0, 0.00, 0, 0, 0.0, 1),
    (40, 0.00, 0, 0.00, 0, 0.00, 0, 0, 0.0, 1), (14, 0.00, 0, 0.00, 0, 0.00, 0, 0, 0.0, 1), (2, 0.00, 0, 0.00, 0, 0.00, 0, 0, 0.0, 1),
    (48, 0.00, 2, 1.00, 3, 1.00, 0, 0, 0.0, 1), (44, 0.00, 1, 1.00, 40, 0.00, 0, 0, 0.1, 1), (80, 0.00, 5, 0.60, 2, 1.00, 0, 0, 0.2, 1),
    (16, 0.00, 2, 1.00, 3, 1.00, 0, 0, 0.0, 1), (14, 0.00, 1, 1.00, 0, 0.00, 0, 0, 0.0, 1), (13, 0.10, 2, 0.90, 2, 1.00, 0, 0, 0.0, 1),
    (90, 0.00, 30, 0.00, 4, 1.00, 0, 0, 0.3, 1), (35, 0.00, 20, 0.00, 60, 0.00, 0, 0, 0.3, 1), (6, 0.00, 60, 0.00, 48, 0.00, 0, 0, 0.0, 1),
    (3, 0.00, 52, 0.00, 35, 0.00, 0, 0, 0.2, 1), (8, 0.00, 2, 1.00, 64, 0.00, 0, 0, 0.0, 1), (5, 0.00, 0, 0.00, 20, 0.00, 0, 0, 0.0, 1),
    (1, 0.00, 60, 0.00, 40, 0.00, 0, 0, 0.0, 1), (2, 0.00, 30, 0.00, 25, 0.00, 0, 0, 0.1, 1), (2, 0.00, 0, 0.00, 30, 0.00, 0, 0, 0.0, 1),
    (60, 0.00, 0, 0.00, 3, 1.00, 0, 0, 0.0, 1), (14, 0.00, 0, 0.00, 2, 1.00, 0, 0, 0.0, 1), (30, 0.10, 1, 0.00, 2, 1.00, 0, 0, 0.2, 1),
    (1, 0.00, 60, 0.00, 0, 0.00, 0, 0, 0.0, 1), (7, 0.00, 12, 0.00, 4, 0.00, 0, 0, 0.0, 1), (10, 0.20, 6, 0.00, 3, 0.00, 0, 0, 0.0, 1),
    (12, 0.00, 1, 1.00, 18, 0.00, 0, 0, 0.0, 1), (4, 0.00, 1, 1.00, 9, 0.00, 0, 0, 0.0, 1), (5, 0.00, 30, 0.00, 2, 1.00, 0, 0, 0.0, 1),
    (3, 0.00, 2, 0.00, 12, 0.00, 0, 0, 0.0, 1), (5, 0.00, 4, 0.00, 3, 1.00, 0, 0, 0.0, 1), (1, 0.00, 60, 0.00, 2, 1.00, 0, 0, 0.0, 1),
    (50, 0.00, 9, 0.00, 30, 0.00, 1, 0, 0.3, 1), (24, 0.00, 30, 0.00, 1, 1.00, 1, 0, 0.2, 1), (4, 0.00, 20, 0.00, 60, 0.00, 1, 0, 0.1, 1),
    # and no text where links are many, or a few words stand between links or at their end.
    (2, 1.00, 2, 1.00, 2, 1.00, 0, 0, 0.0, 0), (3, 1.00, 40, 0.00, 3, 1.00, 0, 0, 0.0, 0), (12, 0.90, 15, 1.00, 9, 1.00, 0, 0, 0.0, 0),
    (7, 0.80, 50, 0.00, 45, 0.00, 0, 0, 0.0, 0), (30, 0.75, 20, 0.80, 25, 0.70, 0, 0, 0.0, 0), (16, 0.40, 40, 0.00, 30, 0.00, 0, 0, 0.0, 0),
    (50, 0.60, 60, 0.00, 2, 1.00, 0, 0, 0.1, 0), (6, 0.90, 5, 1.00, 60, 0.00, 0, 0, 0.0, 0), (4, 1.00, 2, 1.00, 3, 1.00, 1, 0, 0.1, 0),
    (4, 0.00, 3, 1.00, 2, 1.00, 0, 0, 0.0, 0), (3, 0.00, 2, 0.90, 4, 0.80, 0, 0, 0.0, 0), (2, 0.00, 0, 0.00, 2, 1.00, 0, 0, 0.0, 0),
    (1, 0.00, 1, 1.00, 1, 1.00, 0, 0, 0.0, 0), (6, 0.00, 5, 0.70, 3, 1.00, 0, 0, 0.3, 0), (5, 0.00, 2, 1.00, 0, 0.00, 0, 0, 0.0, 0),
    (8, 0.00, 2, 1.00, 1, 1.00, 0, 0, 0.0, 0), (3, 0.00, 1, 1.00, 0, 0.00, 0, 0, 0.2, 0), (10, 0.10, 4, 0.90, 0, 0.00, 0, 0, 0.0, 0),
)

_BLOCK = set("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frame h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
_NO_TEXT = ("script", "style", "noscript", "template", "iframe", "object", "svg", "canvas", "textarea", "title", "audio", "video", "datalist", "noembed", "noframes")
_PARTS = set("nav footer aside dialog menu select button fieldset search".split())
_HOLD = set("div section article main ul ol dl table header figure details center body form".split()) | _PARTS
#: Elements that end where another such one, or the element around them, does.
_ENDED_BY = {"p": _BLOCK, "li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar tablist".split())
_TALK = set("comment comments commentlist respond replies reply disqus discussion".split())
_HINTS = _TALK | set("ad ads adv advert advertisement adverts advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notification alert sidebar sidebars rail menu nav navbar navigation breadcrumb breadcrumbs pagination pager toc footer masthead share sharing social related recommended recommendations newsletter subscribe subscription signup login popup modal overlay toolbar widgets skip".split())
#: Words that say of an element only how it goes with such a part.
_MODIFIERS = set("has no not with without is open opened closed close on off enabled disabled free active allowed hidden visible".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_TELLING = re.compile(r"class|id|hidden|role|style", re.I)
_NAMES = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")
NO, HINT, TALK, SURE = 0, 1, 2, 3


@dataclass
class Block:
    text: str
    words: int
    links: float
    in_article: bool
    in_part: bool = False


@dataclass
class Element:
    """An open element that can hold blocks, then the run of blocks that it held."""

    tag: str
    article: bool
    part: int
    first: int
    last: int = 0
    holds_article: bool = False
    closed: bool = False


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    parts: list[Element] = field(default_factory=list)


def part_of(tag: str, attributes: str, in_article: bool) -> int:
    """Whether an element opens a part that is never main text: NO, HINT, TALK (a hint at comments) or SURE."""
    if tag in _PARTS or tag == "header" and not in_article:
        return SURE
    found = {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)} if _TELLING.search(attributes) else {}
    if found:
        if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or found.get("role", "").lower() in _ROLES:
            return SURE
        if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I):
            return SURE
    hint = HINT if tag == "form" else NO
    if tag in ("body", "html", "main"):
        return NO
    for name in f"{found.get('class', '')} {found.get('id', '')}".split():
        words = _NAMES.findall(_CAMEL.sub(r"\1 \2", name).lower())
        if words and not _MODIFIERS.intersection(words):
            if words[0] in _TALK or words[-1] in _TALK:
                return TALK
            if words[0] in _HINTS or words[-1] in _HINTS:
                hint = HINT
    return hint


def parse(page: str) -> Page:
    """The text blocks of a page, in order, and the parts among its elements."""
    out = Page()
    stack: list[Element] = []
    open_tags: Counter[str] = Counter()
    articles = 0
    held: list[str] = []
    linked = 0
    in_link, inside = False, 0  # an open link with an address, and how many blocks have begun in it
    block, around = "", ""  # the block that began last, and that which the link stands in

    inline: Element | None = None  # an open part inside a line, and where what the block has before it ends
    mark = linked_before = 0

    def emit(said: list[str], links: int) -> None:
        text = " ".join("".join(said).split())
        if text:
            words = text.count(" ") + 1
            out.blocks.append(Block(text, words, min(1.0, links / words), articles > 0))

    def flush() -> None:
        nonlocal linked, mark
        if inline is not None and mark >= 0:  # a block begins inside it
            emit(held[:mark], linked_before)
            inline.first = len(out.blocks)
            del held[:mark]
            linked, mark = linked - linked_before, -1
        if held:
            emit(held, linked)
            held.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw:
            text = entities.unescape(raw) if "&" in raw else raw
            held.append(text)
            if in_link:
                linked += len(text.split())

    def shut(closed: bool) -> str:
        nonlocal articles, inline, linked
        one = stack.pop()
        if one is inline:
            if mark >= 0 and not closed:
                pass
            elif mark >= 0:  # it stands in one block, which goes on without it
                del held[mark:]
                held.append(" ")
                linked = linked_before
            else:
                flush()
            inline = None
        open_tags[one.tag] -= 1
        articles -= one.article
        one.last, one.closed = len(out.blocks), closed or one.tag in _ENDED_BY
        if one.part:
            out.parts.append(one)
        if stack and (one.holds_article or one.article and not one.part):
            stack[-1].holds_article = True
        return one.tag

    at, end, lower = 0, len(page), None
    gone: set[str] = set()
    while at < end:
        found = _TOKEN.search(page, at)
        if found is None:
            say(page[at:])
            break
        say(page[at : found.start()])
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            if found[0].startswith("<![CDATA["):
                say(entities.unescape(found[0][9:-3]) if found[0].endswith("]]>") else found[0][9:])
            continue
        if tag in _NO_TEXT:
            if tag in ("title", "noscript", "textarea"):
                flush()
            if not found[1] and not found[3].endswith("/") and tag not in gone:
                lower = page.lower() if lower is None else lower
                close = lower.find(f"</{tag}", at) if len(lower) == end else page.find(f"</{tag}", at)
                if close < 0:
                    gone.add(tag)  # never closed: only raw text swallows the rest
                    at = end if tag in ("script", "style") else at
                else:
                    at = page.find(">", close) + 1 or end
            continue
        if tag == "a":
            in_link, inside, around = not found[1] and "href" in found[3].lower(), 0, block
            if not found[1] and part_of(tag, found[3], articles > 0) == NO:
                continue
        if tag in ("br", "wbr"):
            held.append(" " if tag == "br" else "")
            continue
        if tag in _BLOCK:
            flush()
            if in_link:  # a link ends with the block that it stands in
                in_link = not (inside == 0 and not found[1] and tag in _ENDED_BY.get(around, ()))
                inside += -1 if found[1] else 1
                in_link &= inside >= 0
            block = "" if found[1] else tag
        if found[1]:
            if open_tags[tag]:
                while tag in _BLOCK or stack[-1].tag == tag or stack[-1].tag not in _BLOCK:
                    if shut(stack[-1].tag == tag) == tag or not stack:
                        break
        elif tag not in _VOID and not found[3].rstrip().endswith("/"):
            if stack and tag in _ENDED_BY.get(stack[-1].tag, ()):
                shut(True)
            part = part_of(tag, found[3], articles > 0)
            if part or tag in _HOLD:
                article = tag in ("article", "main") and part == NO
                stack.append(Element(tag, article, part, len(out.blocks)))
                open_tags[tag] += 1
                articles += article
                if tag not in _BLOCK and inline is None:
                    inline, mark, linked_before = stack[-1], len(held), linked
    flush()
    while stack:
        shut(False)
    flush()
    return out


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page, in order, with in_part set."""
    found = parse(page)
    blocks = found.blocks
    size = np.array([b.words for b in blocks], np.int64)

    def cover(parts: list[Element]) -> np.ndarray:
        deep = np.zeros(len(blocks) + 1, np.int64)
        for x in parts:
            deep[x.first] += 1
            deep[x.last] -= 1
        return np.cumsum(deep)[:-1] > 0

    sure = cover([x for x in found.parts if x.part == SURE and x.closed])
    free = np.where(sure, 0, size)
    hinted = [x for x in found.parts if not (x.part == SURE and x.closed)]
    hidden = cover(hinted)
    own = np.array([b.in_article for b in blocks], bool)
    outside = int(free[own & ~hidden].sum())
    upto = np.concatenate([[0], np.cumsum(free)])
    total = int(upto[-1])

    def holds(x: Element) -> bool:
        """Whether a hinted part is none."""
        if x.holds_article and (x.part != TALK or not x.closed):
            return True
        inside = int(upto[x.last] - upto[x.first])
        if not x.closed:
            return x.part != SURE or 2 * inside > total
        return not outside and (inside == total if x.part == TALK else 2 * inside > total)

    out = sure | cover([x for x in hinted if not holds(x)])
    for b, part in zip(blocks, out.tolist()):
        b.in_part = part
    return blocks


def features(blocks: list[Block]) -> np.ndarray:
    """A row of FEATURES for each block."""
    free = sum(b.words for b in blocks if not b.in_part)
    share = sum(b.words for b in blocks if b.in_article and not b.in_part) / max(1, free)
    sides = [(0, 0.0), *((b.words, b.links) for b in blocks), (0, 0.0)]
    rows = [(*own, *before, *after, b.in_article, b.in_part, share) for b, before, own, after in zip(blocks, sides, sides[1:], sides[2:])]
    return np.array(rows, float).reshape(-1, len(FEATURES))


def grow(x: np.ndarray, y: np.ndarray, depth: int = 12):
    """A decision tree by Gini impurity: a float (share of content) or (feature, threshold, tree up to it, tree above it)."""
    share = float(y.mean()) if len(y) else 0.0
    if depth == 0 or share in (0.0, 1.0):
        return share
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[:-1] + values[1:]) / 2:
            low = x[:, f] <= cut
            impurity = sum(len(p) * p.mean() * (1 - p.mean()) for p in (y[low], y[~low]))
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, float(cut))
    if best is None:
        return share
    _, f, cut = best
    low = x[:, f] <= cut
    return f, cut, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)


@cache
def tree():
    table = np.array(LABELLED, float)
    return grow(table[:, :-1], table[:, -1])


def is_content(node, row: np.ndarray) -> bool:
    while not isinstance(node, float):
        node = node[2] if row[node[0]] <= node[1] else node[3]
    return node >= 0.5


def main_text(page: str | None) -> str:
    blocks = blocks_of(page or "")
    return "\n\n".join(b.text for b, row in zip(blocks, features(blocks)) if is_content(tree(), row))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x.as_py()) for x in batch.column(2)]
        columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text (the main text) and n_chars (its code points) for every row."""
    small_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_of("html").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
