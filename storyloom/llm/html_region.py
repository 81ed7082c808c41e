"""Main text of web pages: the contiguous region whose words outweigh its tags."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from html import unescape
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import in_batches, pick

#: Pages that the weights are learned from, at most.
LABELLED = 2_000

# Element and class names as HTML and its usage have them.
RAW = frozenset({"script", "style", "template", "textarea", "title", "svg", "math", "iframe", "noscript", "object", "select"})
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike"
    " strong sub sup time tt u var wbr".split()
)
BOILERPLATE = frozenset("nav footer header aside form menu dialog button figure fieldset label".split())
MAIN = frozenset({"article", "main"})
PAGE = frozenset({"html", "body"})
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd ul ol dl blockquote pre td th tr".split())
CLOSES_PARAGRAPH = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main"
    " menu nav ol p pre section table ul".split()
)
CLOSED_BY_SAME = frozenset("li dt dd tr td th option".split())
BOILERPLATE_NAME = re.compile(
    r"(?:^|[-_ ])(?:nav|navbar|navigation|menu|breadcrumbs?|header|masthead|footer|sidebar|side|aside|ads?|advert\w*|banner"
    r"|sponsor\w*|promo\w*|cookies?|consent|notices?|alert|popup|modal|newsletter|subscribe|signup|login|search|share|sharing"
    r"|social|related|recommended|trending|comments?|respond|disqus|replies|reply|pager|pagination|toolbar|widget|copyright"
    r"|legal|skip)(?:$|[-_ ])",
    re.IGNORECASE,
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)"
    r"|<!\[CDATA\[.*?(?:\]\]>|$)"
    r"|<[!?][^>]*(?:>|$)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+(?=>|$)|[^>]*)(?:>|$)",
    re.DOTALL,
)
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?=\s|=|$|/)|aria-hidden\s*=\s*[\"']?true)", re.IGNORECASE)
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"\S+")


@dataclass
class Block:
    """Text of one block element, the kind of most of its words, and where they begin among the keys."""

    text: str
    kind: str
    first: int


@dataclass
class Page:
    """Words and tags of a page in order, as keys into the weights, and its blocks."""

    keys: list[str] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)
    #: For each element that was opened: its name and the span of keys that it holds.
    names: list[str] = field(default_factory=list)
    spans: list[list[int]] = field(default_factory=list)


def read(html: str) -> Page:
    """One scan over the page. Elements that miss their end tag end where their parent does."""
    page = Page()
    stack: list[tuple[str, int, str]] = []  # element, its number, the kind of its words
    parts: list[str] = []
    first = -1

    def flush() -> None:
        nonlocal first
        text = _SPACE.sub(" ", unescape("".join(parts))).strip()
        parts.clear()
        if text:
            kinds = [k for k in page.keys[first:] if k.startswith("word")]
            page.blocks.append(Block(text, Counter(kinds).most_common(1)[0][0] if kinds else "word", first))
        first = -1

    def leave(down_to: int) -> None:
        while len(stack) > down_to:
            name, number, _ = stack.pop()
            page.spans[number][1] = len(page.keys)

    at = 0
    size = len(html)
    while at < size:
        found = _TOKEN.search(html, at)
        text = html[at : found.start()] if found else html[at:]
        if text:
            words = len(_WORD.findall(text))
            if words:
                kind = stack[-1][2] if stack else "word"
                if first < 0:
                    first = len(page.keys)
                page.keys.extend([kind] * words)
            parts.append(text)
        if not found:
            break
        at = found.end()
        name = (found["name"] or "").lower()
        if not name:
            continue
        inline = name in INLINE
        if found["close"]:
            places = [i for i, (n, _, _) in enumerate(stack) if n == name]
            if not places or (inline and any(n not in INLINE for n, _, _ in stack[places[-1] + 1 :])):
                continue
            if not inline:
                flush()
            leave(places[-1])
            page.keys.append(f"/{name}")
            continue
        if not inline:
            flush()
            if name in CLOSES_PARAGRAPH:
                opened = [i for i, (n, _, _) in enumerate(stack) if n == "p"]
                if opened:
                    leave(opened[-1])
            if name in CLOSED_BY_SAME:
                opened = [i for i, (n, _, _) in enumerate(stack) if n == name]
                nested = [i for i, (n, _, _) in enumerate(stack) if n in ("ul", "ol", "dl", "table", "select")]
                if opened and (not nested or nested[-1] < opened[-1]):
                    leave(opened[-1])
        elif name in ("br", "wbr", "img"):
            parts.append(" " if name == "br" else "")
        page.keys.append(name)
        if name in VOID or found["rest"].rstrip().endswith("/") and name in ("svg", "math"):
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*(?:>|$)|\Z", re.IGNORECASE).search(html, at)
            at = end.end()
            continue
        kind = stack[-1][2] if stack else "word"
        labels = " ".join(a or b or c for a, b, c in _NAMES.findall(found["rest"]))
        if name in BOILERPLATE or name == "head":
            kind = f"word:{name}"
        elif name not in MAIN and name not in ("html", "body") and BOILERPLATE_NAME.search(labels):
            kind = "word:named"
        elif _HIDDEN.search(found["rest"]):
            kind = "word:hidden"
        elif name == "a" and kind == "word":
            kind = "word:link"
        stack.append((name, len(page.names), kind))
        page.names.append(name)
        page.spans.append([len(page.keys), len(page.keys)])
    flush()
    leave(0)
    return page


#: Weights before anything is learned, and of keys that the labelled pages do not have.
PRIOR = {"word": 1.0, "word:link": -0.5}
UNKNOWN_WORD, UNKNOWN_TAG = -2.0, -0.6


def weight(weights: dict[str, float], key: str) -> float:
    found = weights.get(key)
    if found is None:
        found = PRIOR.get(key, UNKNOWN_WORD if key.startswith("word:") else UNKNOWN_TAG)
    return found


def learn(inside: Counter[str], outside: Counter[str]) -> dict[str, float]:
    """Weights from how often each word kind and tag lies inside and outside of labelled regions.

    The log odds against all keys, with words held at or above a small gain and tags at or below a small
    cost, so that words stay positive and tags negative whatever the labelled pages are like. Words in
    boilerplate elements never gain.
    """
    if not inside:
        return {}
    n_in, n_out = sum(inside.values()), sum(outside.values())
    out = {}
    for key in inside.keys() | outside.keys():
        odds = log((inside[key] + 1) / (n_in + 1)) - log((outside[key] + 1) / (n_out + 1))
        if key == "word":
            out[key] = min(max(odds, 0.5), 2.0)
        elif key.startswith("word:"):
            out[key] = min(max(odds, -3.0), -0.2)
        else:
            out[key] = min(max(odds, -2.0), -0.1)
    return out


def labelled(page: Page) -> tuple[Counter[str], Counter[str]] | None:
    """Keys inside and outside of the one article or main element that a page marks, if it marks one."""
    marked = [i for i, n in enumerate(page.names) if n == "article"] or [i for i, n in enumerate(page.names) if n == "main"]
    if len(marked) != 1:
        return None
    start, stop = page.spans[marked[0]]
    return Counter(page.keys[start:stop]), Counter(page.keys[:start] + page.keys[stop:])


def best_region(scores: Iterable[float]) -> tuple[int, int]:
    """The contiguous run with the largest sum, by one scan: (0, 0) if no score is positive."""
    best, start, stop = 0.0, 0, 0
    total, since = 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, since = 0.0, i
        total += s
        if total > best:
            best, start, stop = total, since, i + 1
    return start, stop


def main_text(html: str | None, weights: dict[str, float]) -> str:
    """Blocks of the best region, joined by newlines; see ``extract``."""
    page = read(html or "")
    start, stop = best_region(weight(weights, k) for k in page.keys)
    if start == stop:
        return ""
    # What holds all of the region is taken whole: the article it is in, else the smallest element that is
    # more than a paragraph and less than the page.
    holding = [i for i, (a, b) in enumerate(page.spans) if a <= start and stop <= b and page.names[i] not in PAGE]
    mains = [i for i in holding if page.names[i] in MAIN]
    larger = [i for i in holding if page.names[i] not in INLINE and page.names[i] not in PARAGRAPHS]
    whole = mains[0] if mains else larger[-1] if larger else None
    if whole is not None:
        start, stop = page.spans[whole]
    return "\n".join(b.text for b in page.blocks if start <= b.first < stop and b.kind in ("word", "word:link"))


def fit(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", bound: int = LABELLED) -> dict[str, float]:
    """Weights from at most ``bound`` pages that mark their article themselves, those first by a hash of their id.

    Counts of keys come to the driver: as many as there are element names in these pages.
    """
    marked = pick(pages, id_col, html_col).toDF("id", "html").filter(F.col("html").rlike("(?i)<(article|main)[\\s>]"))
    marked = marked.withColumn("key", F.xxhash64("id", "html"))
    # At most ``bound`` keys of 8 bytes: pages themselves are never gathered. Copies of one page count once.
    chosen = marked.select("key").distinct().orderBy(F.xxhash64("key"), "key").limit(bound)
    chosen = marked.join(F.broadcast(chosen), "key")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        inside: Counter[str] = Counter()
        outside: Counter[str] = Counter()
        for batch in batches:
            for html in batch.column("html").to_pylist():
                found = labelled(read(html or ""))
                if found:
                    inside.update(found[0])
                    outside.update(found[1])
        keys = sorted(inside.keys() | outside.keys())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(keys, pa.string()),
                pa.array([inside[k] for k in keys], pa.int64()),
                pa.array([outside[k] for k in keys], pa.int64()),
            ],
            ["key", "inside", "outside"],
        )

    counted = in_batches(chosen.select("html"), work, "key string, inside long, outside long")
    rows = counted.groupBy("key").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside")).collect()
    return learn(Counter({r["key"]: r["inside"] for r in rows}), Counter({r["key"]: r["outside"] for r in rows}))


def extract(pages: DataFrame, weights: dict[str, float], html_col: str = "html") -> DataFrame:
    """All columns of ``pages`` plus ``main_text``: the main text of each whole page.

    Words score positive and tags negative; words in links, navigation, forms, notices and the like score
    negative too. The contiguous region with the largest sum is found by one scan. The article or main element
    that it lies in is taken whole, else the smallest element that holds it, or the region as it is if that is
    the page. Blocks of boilerplate inside it are left out. Character references are decoded, white space inside a block becomes one space.

    Nulls and pages without words give an empty text. Repeated rows give equal texts. Missing end tags,
    bare ``<`` and cut-off pages are read as far as they go. A column named ``main_text`` is replaced. Long
    pages are read whole, one at a time; an empty table gives no rows. One pass, no shuffle.
    """
    named = pages.drop("main_text")
    columns = named.columns
    places = [f"c{i}" for i in range(len(columns))]
    at = columns.index(html_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(h, weights) for h in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in places], pa.array(found, pa.string())], [*places, "main_text"]
            )

    schema = ", ".join([*[f"{c} {t}" for c, (_, t) in zip(places, named.dtypes, strict=True)], "main_text string"])
    return in_batches(named.toDF(*places), work, schema).toDF(*columns, "main_text")
