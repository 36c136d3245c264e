"""Main text: what is kept and dropped, against a plain extractor, and in linear time."""

from __future__ import annotations

import os
import time
from html.parser import HTMLParser

import numpy as np
import pytest

from siftline.llm import html_blocks
from siftline.llm.html_blocks import main_text

LINE = " ".join(["word"] * 40)
P = f"<p>{LINE}</p>"
TWO = f"{LINE}\n\n{LINE}"

CASES = {
    "menu behind the last paragraph": (f"<article>{P}{P}</article><nav><a>Home</a></nav>", TWO),
    "menu inside the article": (f"<article>{P}{P}<nav><a href=x>Home</a></nav></article>", TWO),
    "footer behind one paragraph": (f"<article>{P}</article><footer><a href=u>About us</a></footer>", LINE),
    "a class that tells of a sidebar": (f"<div class='content has-sidebar'><article>{P}</article></div>", LINE),
    "no article in such a class": (f"<div class='content has-sidebar'>{P}{P}</div>", TWO),
    "a class that tells of comments": (f"<div class='post comments-open'>{P}</div>", LINE),
    "a part around the article": (f"<div class=nav-wrapper><div class=page><article>{P}</article></div></div>", LINE),
    "paragraphs that are parts": (f"<article>{P}<p class='advert'>buy this</p>{P}<p class=cookie-notice>we use cookies<p>tail</article>", f"{TWO}\n\ntail"),
    "a list entry that is a part": ("<article><ul><li>one thing<li class=ad>buy<li>two things</ul></article>", "one thing\n\ntwo things"),
    "a part inside a line": ("<article><p>one <span class=ad>buy <a href=x>this</a></span> two</p></article>", "one two"),
    "a block inside such a part": ("<article><p>one <span class=ad>buy<div>this</div>now</span> two</p><p>three</article>", "one\n\ntwo\n\nthree"),
    "a part without an end": ("<article><p>one <span class=ad>buy</p><p>three</article>", "one\n\nbuy\n\nthree"),
    "a formula": ("<article><p>let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be</p></article>", "let x=1 be"),
    "a block in a link": (f"<div><a href='/x'><div>a teaser with a number of words that would be enough</div></a></div>{P}", LINE),
    "a link without an end": (f"<div><p><a href=x>link<p>{LINE}</div>", LINE),
    "a teaser beside the text": (f"<div id=story>{P * 4}</div><article class=teaser><p><a href=x>more of it</a></p></article>", "\n\n".join([LINE] * 4)),
    "a form around the page": (f"<form id=page><div>{P}{P}</div></form>", TWO),
    "a form in the article": (f"<article>{P}<form><p>Your mail</p><label>Name</label></form></article>", LINE),
    "a menu without an end": (f"<body><nav><a href=x>Home</a><article>{P}</article></body>", LINE),
    "comments that are articles": (f"<article>{P}</article><section id=comments><article class=comment>{P}{P}</article></section>", LINE),
    "long comments without an article": (f"<div id=main><h1>Title of it</h1>{P}</div><div id=comments>{P}{P}{P}</div>", f"Title of it\n\n{LINE}"),
    "hidden elements": (f"<article>{P}<div hidden>{P}</div><div style='display: none'>x</div><p role=alert>y</p></article>", LINE),
    "headers": (f"<header><h1>Site</h1></header><article><header><h1>Title</h1></header>{P}</article>", f"Title\n\n{LINE}"),
    "sidebars": (f"<main>{P}<aside>{P}</aside></main><div class=sidebar><p>x y z</p></div>", LINE),
    "menus of a page without an article": ("<div>" + "".join(f"<li><a href=x>m{k}</a>" for k in range(9)) + f"</div>{P}<p>ok</p>{P}", f"{LINE}\n\nok\n\n{LINE}"),
    "a first paragraph before links": (f"<div>{P}</div><ul><li><a href=x>one</a><li><a href=y>two</a></ul>", LINE),
    "a few words": ("<p>hello world</p>", "hello world"),
    "parts alone": ("<nav><a href=x>Home</a></nav><footer>us</footer>", ""),
    "odd markup": ("<article><p>a &lt;b&gt; &amp;c; 1 < 2 <!-- no --><![CDATA[ data ]]></article>", "a <b> &c; 1 < 2 data"),
}


@pytest.mark.parametrize("name", CASES)
def test_what_is_kept(name):
    page, want = CASES[name]
    assert main_text(page) == want


def test_tree_asks_for_words_links_and_neighbours():
    table = np.array(html_blocks.LABELLED, float)
    assert len(table) < 120
    tree = html_blocks.tree()
    assert [html_blocks.is_content(tree, row) for row in table[:, :-1]] == (table[:, -1] == 1).tolist()
    asked = set()

    def walk(node):
        if not isinstance(node, float):
            asked.add(html_blocks.FEATURES[node[0]])
            walk(node[2])
            walk(node[3])

    walk(tree)
    assert {"words", "links", "links_before", "links_after", "words_after", "in_article", "in_part", "article_share"} <= asked


@pytest.mark.parametrize("one", ["<div>@</ul>", "<ul><div>@</ul>", "<span class=ad>@</div></span>", "<b class=ad><div>@</b>", "<p class=ad>x@", "<a href=x><div>@</a>"])
def test_end_tags_cost_no_more_for_open_elements(one):
    opening, closing = one.split("@")
    began = time.time()
    main_text(opening * 40_000 + closing * 40_000)
    assert time.time() - began < 8


class _Plain(HTMLParser):
    """Text by its nearest block inside an article, outside of parts; for pages that close what they open but paragraphs."""

    def __init__(self):
        super().__init__()
        self.open, self.blocks = [], [""]

    def handle_starttag(self, tag, attrs):
        if tag in html_blocks._BLOCK:
            self.blocks.append("")
            if self.open and self.open[-1][0] == "p":
                self.open.pop()
        if tag == "br":
            self.blocks[-1] += " "
        elif tag not in html_blocks._VOID:
            self.open.append((tag, dict(attrs).get("class")))

    def handle_endtag(self, tag):
        if tag in html_blocks._BLOCK:
            self.blocks.append("")
        if tag in [t for t, _ in self.open]:
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        tags = {t for t, _ in self.open}
        if "article" in tags and not tags & {"nav", "footer", "aside", "script", "style", "form"} and "ad" not in {c for _, c in self.open}:
            self.blocks[-1] += data


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001/pages.parquet"), reason="no table of pages")
def test_pages_as_a_plain_extractor(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    got = html_blocks.extract_pages(pages).collect()
    assert len(got) == len(html)
    for r in got:
        plain = _Plain()
        plain.feed(html[r.page_id] or "")
        plain.close()
        assert r.text == "\n\n".join(b for b in (" ".join(x.split()) for x in plain.blocks) if b) and r.n_chars == len(r.text)


def test_odd_pages(spark):
    rows = [(1, None, None), (None, "u", ""), (2, "u", P * 3000), (2, "u", P * 3000), (3, "u", "\x00<p>\x00a</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS text", "'y' AS n_chars")
    got = html_blocks.extract_pages(pages).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 0), (1, 0), (2, 3000 * len(LINE) + 2 * 2999), (2, 3000 * len(LINE) + 2 * 2999), (3, 5)]
