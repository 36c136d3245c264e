"""Pages to documents: titles, bodies, dates, authors, media, links, and what keeps a page out of the index."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.dates import parse_date

MOST_BYTES, MOST_TAGS, MOST_DEPTH, LEAST_CHARS, MOST_LINKS = 8 << 20, 100_000, 512, 120, 200
_VOID = set("area base br col embed hr img input link meta source track wbr".split())
_SILENT = set("script style noscript template svg iframe object".split())
_BOXES = set("main div section td body".split())


class Node:
    """An element: its attributes, its text with that of descendants, and how much of it is linked."""

    __slots__ = ("tag", "attributes", "parts", "linked", "hidden")

    def __init__(self, tag: str, attributes: dict[str, str], hidden: bool) -> None:
        self.tag, self.attributes, self.hidden = tag, attributes, hidden
        self.parts: list[str] = []
        self.linked = 0

    @property
    def text(self) -> str:
        return " ".join("".join(self.parts).split())


class Page(HTMLParser):
    """One pass over a page that keeps what extraction asks for."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[Node] = []
        self.closed: list[Node] = []
        self.meta: dict[str, str] = {}
        self.scripts: list[str] = []
        self.links: list[tuple[str, str]] = []
        self.images: list[dict[str, str]] = []
        self.canonical: str | None = None
        self.tags = 0
        self.too_complex = False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if self.tags > MOST_TAGS or len(self.open) > MOST_DEPTH:
            self.too_complex = True
            return
        a = {k: v or "" for k, v in attrs}
        if tag == "meta":
            key = (a.get("property") or a.get("name") or a.get("itemprop") or "").lower()
            if key and key not in self.meta:
                self.meta[key] = a.get("content", "").strip()
        elif tag == "link" and "canonical" in a.get("rel", "").lower():
            self.canonical = self.canonical or a.get("href")
        elif tag == "img":
            self.images.append(a)
        elif tag == "a" and a.get("href"):
            self.links.append((a["href"], a.get("rel", "")))
        if tag in _VOID:
            if tag == "br" and self.open:
                self.open[-1].parts.append(" ")
            return
        if tag == "p" and self.open and self.open[-1].tag == "p":
            self._close()
        hidden = bool(self.open and self.open[-1].hidden) or tag in _SILENT or "hidden" in a or a.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", "")))
        self.open.append(Node(tag, a, hidden))

    def handle_data(self, data: str) -> None:
        if not self.open:
            return
        top = self.open[-1]
        if top.tag == "script" and "json" in top.attributes.get("type", ""):
            self.scripts.append(data)
        elif not top.hidden:
            top.parts.append(data)
            if any(n.tag == "a" for n in self.open[-4:]):
                top.linked += len(data.strip())

    def handle_endtag(self, tag: str) -> None:
        if any(n.tag == tag for n in self.open):
            while self._close().tag != tag:
                pass

    def _close(self) -> Node:
        node = self.open.pop()
        self.closed.append(node)
        if self.open and not node.hidden:
            self.open[-1].parts += [" ", *node.parts, " "]
            self.open[-1].linked += node.linked
        return node

    def finish(self) -> None:
        self.close()
        while self.open:
            self._close()

    def first(self, tag: str) -> str:
        return next((n.text for n in self.closed if n.tag == tag and not n.hidden), "")


def _articles(scripts: list[str]) -> Iterator[dict]:
    for raw in scripts:
        try:
            found = json.loads(raw)
        except ValueError:
            continue
        for one in found if isinstance(found, list) else found.get("@graph", [found]) if isinstance(found, dict) else []:
            kinds = one.get("@type", "") if isinstance(one, dict) else ""
            if re.search("article|blogposting", " ".join(kinds) if isinstance(kinds, list) else str(kinds), re.I):
                yield one


def _body(page: Page, article: dict) -> tuple[str, str]:
    """The body and where it was found."""
    if isinstance(article.get("articleBody"), str) and article["articleBody"].strip():
        return " ".join(article["articleBody"].split()), "jsonld"
    for tags in ({"article"}, _BOXES):
        best, most = "", 0.0
        for n in page.closed:
            if n.tag in tags and not n.hidden and len(t := n.text) >= 200:
                density = min(1.0, n.linked / len(t))
                if density <= 0.5 and len(t) * (1 - density) > most:
                    best, most = t, len(t) * (1 - density)
        if best:
            return best, "block"
    if page.meta.get("og:description"):
        return page.meta["og:description"], "og"
    return " ".join(n.text for n in page.closed if n.tag == "p" and not n.hidden).strip(), "paragraphs"


def _date(page: Page, article: dict, body: str, now: int, selector: str | None) -> tuple[int, str]:
    tries = [n.text for n in page.closed if selector and selector in n.attributes.get("class", "").split()]
    tries += [str(article.get("datePublished") or "")]
    tries += [page.meta.get(k, "") for k in ("article:published_time", "og:published_time", "date", "pubdate", "datepublished", "dc.date")]
    tries += [n.attributes.get("datetime") or n.text for n in page.closed if n.tag == "time"]
    tries += [n.text for n in page.closed if "date" in n.attributes.get("class", "").lower()]
    words = body[:400].split()
    tries += [" ".join(words[k : k + 4]) for k in range(max(0, len(words) - 3))]
    return next((d for t in tries if t and (d := parse_date(t, now))), (now, "unknown"))


def parse_page(html: str | None, url: str, now: int, date_class: str | None = None) -> dict:
    """A page's document fields, links, and an error: too_complex, no_index or too_little_content (links are kept)."""
    out = {"url": url, "title": "", "body": "", "method": None, "published_at": None, "precision": "unknown", "author": None, "canonical_url": None, "media": [], "outlinks": [], "error": None}
    html = html or ""
    if len(html.encode()) > MOST_BYTES:
        return out | {"error": "too_complex"}
    page = Page()
    page.feed(html)
    page.finish()
    if page.too_complex:
        return out | {"error": "too_complex"}
    links = dict.fromkeys(u for href, _ in page.links if not href.strip().lower().startswith(("#", "javascript:", "mailto:", "tel:")) and (u := _join(url, href)).startswith(("http://", "https://")))
    out["outlinks"] = list(links)[:MOST_LINKS]
    if "noindex" in page.meta.get("robots", "").lower():
        return out | {"error": "no_index"}
    article = next(_articles(page.scripts), {})
    out["title"] = next((t for t in (str(article.get("headline") or ""), page.meta.get("og:title", ""), page.meta.get("twitter:title", ""), page.first("h1"), page.first("title")) if t.strip()), "").strip()
    out["body"], out["method"] = _body(page, article)
    out["published_at"], out["precision"] = _date(page, article, out["body"], now, date_class)
    author = article.get("author")
    author = author[0] if isinstance(author, list) and author else author
    out["author"] = (author.get("name") if isinstance(author, dict) else author) or page.meta.get("author") or None
    out["canonical_url"] = _join(url, page.canonical) if page.canonical else None
    pictures = [page.meta["og:image"]] if page.meta.get("og:image") else []
    pictures += [_join(url, i["src"]) for i in page.images if i.get("src") and int(re.sub(r"\D.*", "", i.get("width", "")) or 0) >= 200][:4]
    out["media"] = list(dict.fromkeys(pictures))
    return out | ({"error": "too_little_content"} if len(out["body"]) < LEAST_CHARS else {})


def _join(base: str, href: str) -> str:
    try:
        return urljoin(base, href.strip())
    except ValueError:
        return ""


SCHEMA = "page_id long, url string, title string, body string, method string, published_at long, precision string, author string, canonical_url string, media array<string>, outlinks array<string>, error string"


def parse_pages(pages: DataFrame, now: int) -> DataFrame:
    """One Arrow pass that computes all fields of every page."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [{"page_id": i} | parse_page(h, u or "", now) for i, u, h in zip(batch["page_id"], batch["url"], batch["html"])]
            yield pd.DataFrame(rows, columns=names)

    return pages.select("page_id", "url", "html").mapInPandas(run, SCHEMA)


def outlinks(parsed: DataFrame) -> DataFrame:
    return parsed.select("page_id", "url", F.posexplode("outlinks").alias("position", "link"))


def robots_header(c: Column) -> Column:
    """(noindex, nofollow) of an X-Robots-Tag; rules that name another agent don't count."""
    own = F.regexp_replace(F.lower(c), r"(?:^|,)\s*(?!none|noindex|nofollow|all|index|follow|noarchive|nosnippet|unavailable_after|max-)[\w-]+bot\s*:[^,]*", "")
    none = own.rlike(r"\bnone\b")
    return F.struct((none | own.rlike(r"\bnoindex\b")).alias("no_index"), (none | own.rlike(r"\bnofollow\b")).alias("no_follow"))
