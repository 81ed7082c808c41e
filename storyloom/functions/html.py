"""Main-text extraction from HTML, one Arrow batch at a time."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.functions.text import clip_bytes, trim_ws
from storyloom.session import bound_batches

# What is removed, and where article text is looked for, tier by tier.
REMOVED_TAGS = ("script", "style")
REMOVED_IDS = ("ar-widget",)
REMOVED_CLASSES = ("ad-label",)
PRECISE_TAG = "article"
PRECISE_CLASSES = ("post-content", "entry-content", "article-body", "post-body", "k5a-article")
FALLBACK_CLASSES = ("content", "page-content", "main-content")
SOURCE_COPY_ID = "webkit-xml-viewer-source-xml"
FEED_STARTS = ("<?xml", "<rss", "<feed")

# HTML element categories (HTML standard).
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HEAD_ONLY = frozenset("base head link meta noscript script style template title".split())
_CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
_SCOPE_STOPS = frozenset("applet caption html table td th marquee object template".split())
_TABLE_TAGS = frozenset("table tbody thead tfoot tr td th caption html body".split())
_SAME_LEVEL = {
    "li": ("li", ("ol", "ul", "menu", "dir")),
    "dt": ("dt dd", ("dl",)),
    "dd": ("dt dd", ("dl",)),
    "option": ("option", ("select", "datalist", "optgroup")),
    "tr": ("tr td th", ("table",)),
    "td": ("td th", ("tr", "table")),
    "th": ("td th", ("tr", "table")),
}


class _TextRegions(HTMLParser):
    """Collects the text under every element of interest in one pass over a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.pieces: list[str] = []
        self.open: list[tuple[str, list[tuple[str, int]], int, bool]] = []
        self.found: dict[str, list[tuple[int, str]]] = {}
        self.muted = 0
        self.body_from: int | None = None
        self.in_title = False

    # -- tree building -------------------------------------------------
    def handle_starttag(self, tag, attrs):
        if tag in ("html", "head"):
            return
        if tag == "title" and self.body_from is None:
            self.in_title = True
            return
        if tag not in _HEAD_ONLY and self.body_from is None:
            self.body_from = len(self.pieces)
        if tag == "body":
            return
        if tag in _CLOSES_P:
            self._close_open("p", stops=("button",))
        if tag in _SAME_LEVEL:
            names, stops = _SAME_LEVEL[tag]
            for name in names.split():
                self._close_open(name, stops=stops)
        if tag in _VOID:
            return
        attr = {k: v or "" for k, v in reversed(attrs)}
        classes = set(attr.get("class", "").split())
        mute = tag in REMOVED_TAGS or attr.get("id") in REMOVED_IDS or bool(classes.intersection(REMOVED_CLASSES))
        marks = []
        if not (self.muted or mute):
            wanted = [tag] if tag in (PRECISE_TAG, "main", "pre") else []
            wanted += ["." + c for c in (*PRECISE_CLASSES, *FALLBACK_CLASSES) if c in classes]
            for name in wanted:
                self.found.setdefault(name, []).append((len(self.pieces), ""))
                marks.append((name, len(self.found[name]) - 1))
        self.muted += mute
        self.open.append((tag, marks, len(self.pieces), mute))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag == "title" and self.in_title:
            self.in_title = False
        elif tag not in ("html", "head", "body"):
            self._close_open(tag, stops=() if tag in _TABLE_TAGS else _SCOPE_STOPS)

    def handle_data(self, data):
        if self.in_title:
            return
        if self.body_from is None:
            if self.muted or not data.strip():
                return
            self.body_from = len(self.pieces)
        if not self.muted:
            self.pieces.append(data)

    def _close_open(self, tag, stops):
        for depth in range(len(self.open) - 1, -1, -1):
            name = self.open[depth][0]
            if name == tag:
                while len(self.open) > depth:
                    self._pop()
                return
            if name in stops:
                return

    def _pop(self):
        _, marks, start, mute = self.open.pop()
        self.muted -= mute
        if marks:
            text = "".join(self.pieces[start:])
            for name, slot in marks:
                self.found[name][slot] = (start, text)

    # -- results -------------------------------------------------------
    def finish(self) -> None:
        self.close()
        while self.open:
            self._pop()

    def body(self) -> str:
        return "" if self.body_from is None else "".join(self.pieces[self.body_from :])

    def first(self, name: str) -> str:
        return self.found[name][0][1] if name in self.found else ""

    def longest(self, names) -> str:
        texts = [text for name in names for _, text in self.found.get(name, [])]
        return max(texts, key=lambda t: len(t.encode("utf-8", "surrogatepass")), default="")


def _regions(html: str) -> _TextRegions:
    page = _TextRegions()
    page.feed(html)
    page.finish()
    return page


def main_text(html: str | None) -> str | None:
    """Untrimmed main text of one page; each tier is tried only if all before it gave ''."""
    if html is None:
        return None
    page = _regions(html)
    return (
        page.longest((PRECISE_TAG, *("." + c for c in PRECISE_CLASSES)))
        or page.longest("." + c for c in FALLBACK_CLASSES)
        or page.first("main")
        or page.body()
    )


@F.pandas_udf(T.StringType())
def _main_text_batch(html: pd.Series) -> pd.Series:
    return html.map(main_text)


_COPY_START = re.compile(rf"""<([A-Za-z]\w*)[^>]*\bid=["']?{SOURCE_COPY_ID}["']?[^>]*>""")


def source_copy(html: str) -> str:
    """The markup inside a viewer's source copy, up to the end tag that closes it; '' if there is none."""
    start = _COPY_START.search(html)
    if start is None:
        return ""
    # Comments and CDATA sections hold no tags.
    tags = re.compile(rf"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<(/?){start[1]}(?=[\s/>])[^>]*?(/?)>", re.DOTALL | re.IGNORECASE)
    depth = 1
    for tag in tags.finditer(html, start.end()):
        if tag[1] is not None and not tag[2]:
            depth += -1 if tag[1] else 1
        if not depth:
            return html[start.end() : tag.start()]
    return ""


_SHELL = ("pre", "body", "source")


def _shell_texts(html: str | None) -> tuple[str | None, ...]:
    """``_SHELL`` of one page; nothing else of the page is kept."""
    if html is None:
        return None, None, None
    page = _regions(html)
    return page.first("pre"), page.body(), source_copy(html)


@F.pandas_udf(T.StructType([T.StructField(c, T.StringType()) for c in _SHELL]))
def _shell_texts_batch(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_shell_texts(h) for h in html], columns=_SHELL)


def extract_main_content(html: Column, max_bytes: int | None = None) -> Column:
    """Main text of a page, trimmed; with ``max_bytes``, clipped on a character boundary."""
    bound_batches()
    text = trim_ws(_main_text_batch(html))
    return text if max_bytes is None else clip_bytes(text, max_bytes)


def unwrap_feed_xml(text: Column) -> Column:
    """Feed XML out of a browser-rendered HTML shell; returns the input trimmed if nothing fits."""
    bound_batches()
    trimmed = trim_ws(text)
    is_feed = F.lit(False)
    for start in FEED_STARTS:
        is_feed = is_feed | F.startswith(trimmed, F.lit(start))
    shell = _shell_texts_batch(F.when(~is_feed, text))

    def sliced(tag: str) -> Column:
        return F.regexp_extract(text, rf"(?s)<{tag}.*</{tag}>", 0)

    def non_empty(c: Column) -> Column:
        return F.when(c != "", c)

    return F.when(is_feed, trimmed).otherwise(
        F.coalesce(
            F.when(F.contains(shell["source"], F.lit("<")), trim_ws(shell["source"])),
            non_empty(trim_ws(shell["pre"])),
            non_empty(trim_ws(shell["body"])),
            non_empty(sliced("rss")),
            non_empty(sliced("feed")),
            trimmed,
        )
    )
