"""Main text of pages: the given pages against an independent reading, and odd pages one by one."""

from __future__ import annotations

import time
from html.parser import HTMLParser

import pytest

from postlens.llm import htmltext

PAGE = "page_id long, url string, html string, text string, n_chars string"
PROSE = "This is a sentence of an article that is long enough to be told from a menu by its length alone, and so it is kept. "


class Article(HTMLParser):
    """Blocks within <article>: text split where a heading or paragraph starts or ends."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag in ("h1", "p", "article"):
            self.blocks.append("")
        elif tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        self.inside &= tag != "article"
        if tag in ("h1", "p", "article"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def by_parser(page):
    p = Article()
    p.feed(page)
    p.close()
    return "\n".join(t for t in (" ".join(b.split()) for b in p.blocks) if t)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_given_pages(spark, size):
    pages = spark.read.parquet(f"/root/testdata/{size}/pages.parquet")
    rows = {r.page_id: r for r in htmltext.extract(pages).collect()}
    given = pages.collect()
    assert len(rows) == len(given)
    for r in given:
        got = rows[r.page_id]
        assert (got.url, got.text, got.n_chars) == (r.url, by_parser(r.html), len(by_parser(r.html)))
    assert sum(bool(r.text) for r in rows.values()) > 0.9 * len(rows)


def wrap(body):
    return f"<html><head><title>T</title><style>p{{}}</style></head><body>{body}</body></html>"


CASES = [
    ("", ""),
    (" \n ", ""),
    ("just text, no tag", "just text, no tag"),
    (wrap("<article></article><p>" + PROSE + "</p>"), PROSE.strip()),
    (wrap("<nav><a href=x>M</a></nav><article><h1>A &amp; B</h1><p>one\n two&nbsp;x<br>y</p></article><footer>F"), "A & B\none two x y"),
    (wrap("<article><p>a</p><aside>side</aside><form>f<input></form><script>var x='</p>';</script><p>b</p></article>"), "a\nb"),
    (wrap("<article><p>a</p><div class='ad-slot'>buy</div><p>b</p><section id=comments><article><p>me!</p></article></section></article>"),
     "a\nb"),
    (wrap("<article><header><h1>T</h1><p>by X</p></header><p>a</p></article>"), "T\na"),
    (wrap("<header><h1>Site</h1></header><div role=navigation>m</div><article><p>x</p></article>"), "x"),
    (wrap("<div class='with-sidebar'><article class=post><p>x</p></article></div><div class=sidebar>s</div>"), "x"),
    (wrap("<div class=ad>unclosed<article><p>x</p></article>"), "x"),
    (wrap("<article><p>x<p class=notice>n<p>y<ul><li>i<li class=promo>j<li>k</ul></article>"), "x\ny\ni\nk"),
    (wrap("<article><p>a<b>b</b>c <i>d</i></p><!-- <p>no</p> --><p>&lt;p&gt; &#8364; &bad; &am</p></article>"), "abc d\n<p> € &bad; &am"),
    (wrap("<article><h2><a href=/x>Linked title</a></h2><p>short</p></article>"), "Linked title\nshort"),
    (wrap("<main><p>m</p></main><p>out</p>"), "m"),
    (wrap("<main><p>m</p><article><p>a</p></article></main>"), "a"),
    (wrap("<article><p>1</p></article><p>between</p><article><p>2</p></article>"), "1\n2"),
    (wrap("<article><p>cut off <b title='x"), "cut off"),
    (wrap("<article><p title=it's>a</p><p data-x=\"1>2\">b</p></article><p>z</p>"), "a\nb"),
    (wrap("<article><p>x</p><div hidden>h</div><div style='display: none'>h</div><table><tr><td>c<td>d</table></article>"), "x\nc\nd"),
    (wrap("<ul>" + "<li><a href=/a>Menu entry of some length</a></li>" * 12 + "</ul><div><div><h2>Head</h2><p>" + PROSE * 2
          + "</p><p>short</p><p>" + PROSE + "</p></div></div><div><div><div>tail</div></div></div>"),
     "Head\n" + (PROSE * 2).strip() + "\nshort\n" + PROSE.strip()),
    (wrap("<p>tiny page</p>"), "tiny page"),
]


@pytest.mark.parametrize(("page", "text"), CASES)
def test_pages(page, text):
    assert htmltext.main_text(page) == text


def test_rows(spark):
    rows = [(1, "u", CASES[4][0], "t", "n"), (1, "u", CASES[4][0], "t", "n"), (None, None, CASES[4][0], None, None),
            (2, None, None, "x", None), (3, "v", "", None, None)]
    got = htmltext.extract(spark.createDataFrame(rows, PAGE))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    text = CASES[4][1]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(
        [(1, "u", text, len(text))] * 2 + [(None, None, text, len(text)), (2, None, "", 0), (3, "v", "", 0)], key=str)
    assert htmltext.extract(spark.createDataFrame([], PAGE)).collect() == []


def test_long_and_odd_pages_take_linear_time():
    start = time.time()
    for page in ("<article><p>" + "word " * 400_000, "<" * 300_000, "<a " * 200_000, '<a b="' * 100_000, "<p><b>x" * 100_000,
                 "<div class=ad>" * 50_000, "</p>" * 200_000, "<script>" * 50_000, "<!--" * 100_000, "&amp" * 100_000):
        htmltext.main_text(page)
    assert time.time() - start < 40
