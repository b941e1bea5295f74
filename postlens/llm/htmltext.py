"""HTML extraction by line-block distribution.

A page becomes lines, one per block of its layout, most of them empty where
markup stood (``lines``). Lines carry the length of their text; what markup
itself names as no article (menus, headers, footers, sidebars, notices,
adverts, forms, scripts, reader comments: ``no_article``) is stripped with the
markup and leaves empty lines, and where a page marks its article, lines
outside weigh nothing. Over windows of ``WINDOW`` lines the lengths are
summed; text starts where the sums surge above a threshold, ends where they
dive to nothing, and all text between is kept (``blocks``). On a page without
a marked article text within links weighs nothing, and the threshold keeps
short stray lines out.

Pages are read as a stream of tags, once, in each task; work and memory are
linear in the page. Nothing is shuffled.

Defined results: a null, empty or blank page, or one without any article
text, gives an empty text of length 0; repeated rows are extracted alike;
null ids and URLs are passed through; broken markup (unclosed or stray tags,
a tag cut off by the end) is read as far as it goes.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm.common import slices

WINDOW = 3  # lines of a block
SURGE = 86  # characters in a window that start a text on a page without a marked article

# Element names by their role in HTML.
RAW = {"script", "style", "title", "textarea", "iframe", "noembed", "noframes", "xmp"}
STRIPPED = {"head", "nav", "footer", "aside", "form", "menu", "dialog", "noscript", "template", "button", "select",
            "datalist", "label", "legend", "fieldset", "search", "svg", "math", "object", "audio", "video", "canvas", "map"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
BLOCK = HEADINGS | {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl",
    "dt", "fieldset", "figcaption", "figure", "footer", "form", "head", "header", "hgroup", "hr", "html", "legend", "li",
    "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "select", "summary", "table", "tbody",
    "td", "template", "tfoot", "th", "thead", "title", "tr", "ul", "noscript"}
SELF_CLOSING = {"p", "li", "dt", "dd", "tr", "td", "th", "option"}  # the next of its kind ends it
# Words in class, id or role that name parts of a page that are no article.
NAMES = {"ad", "ads", "adv", "nav", "menu", "header", "notice", "notices", "alert", "share", "sharing", "social", "related",
         "widget", "login", "signup", "subscribe", "toolbar", "reply", "replies", "respond", "dialog", "gdpr", "pager",
         "recommended", "recommendations", "search", "form", "complementary", "contentinfo", "topbar"}
STEMS = ("advert", "cookie", "comment", "sidebar", "sponsor", "newsletter", "breadcrumb", "navig", "navbar", "banner", "popup",
         "modal", "consent", "disqus", "promo", "footer", "masthead", "paginat")
ABOUT = {"with", "has", "no", "without"}  # "with-sidebar" names a layout
OWN = {"article", "post", "entry", "story", "content"}  # "post-header" belongs to the article

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)
    |<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)(?:>|\Z)""", re.S | re.X)
ATTR = re.compile(r"""(?:^|[\s"'/])(class|id|role|itemprop|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))|(?=[\s/>]|$))""",
                  re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Line(NamedTuple):
    text: str
    linked: int  # characters within links
    level: int  # 2: in an article, 1: in the main part, 0: elsewhere


@lru_cache(maxsize=4096)
def role_of(name: str, attrs: str) -> tuple[bool, int, bool]:
    """(is no article, level of what is inside, is a header) of a start tag."""
    level = {"article": 2, "main": 1}.get(name, 0)
    out, header = name in STRIPPED, name == "header"
    words: list[str] = []
    for m in ATTR.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            out = True
        elif key == "style":
            out = out or "display:none" in re.sub(r"\s", "", value.lower())
        elif key == "itemprop":
            level = max(level, 2 * (value.lower() == "articlebody"))
        elif key == "role" and value.lower() in ("main", "article"):
            level = max(level, 1 if value.lower() == "main" else 2)
        else:
            words += [w.lower() for w in PART.findall(value)]
    if name in ("html", "body", "main"):
        return False, level, False
    comments = any(w.startswith("comment") for w in words)
    if level:
        return out or comments, 0 if comments else level, False
    if not ABOUT & set(words):
        named = [w for w in words if w in NAMES or w.startswith(STEMS)]
        if named and set(named) <= {"header", "banner"} and "header" in named:
            header = True
            named = [] if OWN & set(words) else named
        out = out or bool(named)
    return out, 0, header


class _Page:
    """Lines of one page, filled tag by tag."""

    def __init__(self) -> None:
        self.lines: list[Line] = []
        self.parts: list[str] = []
        self.linked = 0
        self.open: list[tuple[str, bool, int, bool]] = []  # name, stripped, level, header
        self.count: dict[str, int] = {}
        self.stripped = self.links = self.headers = self.headings = 0
        self.levels = [0]

    def text(self, raw: str) -> None:
        """Text of the current line; of an article's header only the headings."""
        if self.stripped or (self.headers and not self.headings):
            return
        got = html.unescape(raw) if "&" in raw else raw
        self.parts.append(got)
        if self.links:
            self.linked += len("".join(got.split()))

    def end_line(self) -> None:
        self.lines.append(Line(" ".join("".join(self.parts).split()), self.linked, self.levels[-1]))
        self.parts, self.linked = [], 0

    def _count(self, name: str, out: bool, level: int, header: bool, by: int) -> None:
        self.count[name] = self.count.get(name, 0) + by
        self.stripped += by * out
        self.headers += by * header
        self.links += by * (name == "a")
        self.headings += by * (name in HEADINGS)

    def push(self, name: str, out: bool, level: int, header: bool) -> None:
        self.open.append((name, out, level, header))
        self._count(name, out, level, header, 1)
        if level:
            self.levels.append(max(level, self.levels[-1]))

    def pop(self) -> None:
        name, out, level, header = self.open.pop()
        self._count(name, out, level, header, -1)
        if level:
            self.levels.pop()

    def close(self, name: str) -> None:
        """End the innermost open element of this name, and what is open in it."""
        if self.count.get(name):
            while self.open[-1][0] != name:
                self.pop()
            self.pop()

    def close_before(self, name: str) -> None:
        """End the open element that a start tag ends: a paragraph before a block, an item before its like."""
        at = len(self.open) - 1
        while at >= 0 and self.open[at][0] == "a":
            at -= 1
        if at >= 0 and (self.open[at][0] == "p" or (name in SELF_CLOSING and self.open[at][0] == name)):
            while len(self.open) > at:
                self.pop()


def lines(page: str) -> list[Line]:
    """The page's lines: the text of each block, empty lines where only markup was."""
    tags = list(TOKEN.finditer(page))
    unclosed: dict[str, int] = {}
    for m in tags:
        if m["name"]:
            name = m["name"].lower()
            unclosed[name] = unclosed.get(name, 0) + (-1 if m["end"] else 1)
    out, at = _Page(), 0
    for m in tags:
        if m.start() < at:  # within a script or the like
            continue
        out.text(page[at:m.start()])
        at = m.end()
        if not m["name"]:
            continue
        name = m["name"].lower()
        if name in BLOCK:
            out.end_line()
        elif name == "br":
            out.text(" ")
        if m["end"]:
            out.close(name)
        elif name in RAW:
            stop = _end_of(name).search(page, at)
            at = stop.end() if stop else len(page)
        elif name not in VOID:
            strip, level, header = role_of(name, m["attrs"])
            if name in BLOCK:
                out.close_before(name)
            if level:  # a part before the article that never ends does not hold the article
                while out.stripped and unclosed.get(out.open[-1][0], 0) > 0:
                    out.pop()
            if header and not out.levels[-1]:
                strip = True  # the page's header, not an article's
            if name in BLOCK or name == "a" or strip or level or header:
                out.push(name, strip, level, header)
    out.text(page[at:])
    out.end_line()
    return out.lines


@lru_cache(maxsize=16)
def _end_of(name: str) -> re.Pattern:
    return re.compile(rf"</{name}[^>]*(?:>|\Z)", re.I)


def blocks(found: list[Line]) -> list[str]:
    """The texts between the surge and dive points of the lines' length distribution."""
    level = max((x.level for x in found if x.text), default=0)
    if level:
        weight, surge = [len(x.text) if x.level == level else 0 for x in found], 0
    else:
        weight = [len(x.text) if 2 * x.linked < len(x.text) else 0 for x in found]
        surge = SURGE
    sums = [sum(weight[i: i + WINDOW]) for i in range(len(weight))]
    if not level and max(sums, default=0) <= surge:  # a short page: its longest text
        surge = max(0, max(sums, default=0) - 1)
    out, i = [], 0
    while i < len(sums):
        if sums[i] <= surge:
            i += 1
            continue
        dive = i
        while dive < len(sums) and sums[dive]:
            dive += 1
        out += [x.text for x in found[i:dive] if x.text and x.level == level]
        i = dive
    return out


def main_text(page: str | None) -> str:
    """The main text of a page, its blocks one to a line."""
    return "\n".join(blocks(lines(page))) if page else ""


def extract(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html", 8 << 20):
            text = pa.array([main_text(x.as_py()) for x in batch.column(2)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), text], names=["page_id", "url", "text"])

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    found = rows.mapInArrow(run, f"page_id {kind['page_id']}, url {kind['url']}, text string")
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
