"""Main text of pages: the given ones against a cut by hand, others by cases."""

import re
from html import unescape

import pytest

from corpus import SF, clashing
from storyloom.llm import html_region
from storyloom.llm.queries import QUERIES

WEIGHTS = {}


def by_hand(html):
    article = re.search(r"<article>(.*?)</article>", html, re.S)[1]
    parts = re.split(r"</?(?:p|h1|br)>", article)
    clean = (re.sub(r"\s+", " ", unescape(re.sub(r"</?b>", "", b))).strip() for b in parts)
    return "\n".join(b for b in clean if b)


def test_query_on_given_pages(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    found = QUERIES["op7_html_extraction"](spark, SF).collect()
    assert {r.page_id: (r.url, r.text, r.n_chars) for r in found} == {
        i: (p.url, by_hand(p.html), len(by_hand(p.html))) for i, p in pages.items()
    }


STORY = "<p>The first paragraph of the story, with <a href=x>a link</a> in it.</p><p>And a second one, which is as long.</p>"
TEXT = "The first paragraph of the story, with a link in it.\nAnd a second one, which is as long."


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (f"<body><nav><a>Home</a> <a>More</a></nav><article>{STORY}</article><footer>All rights reserved</footer>", TEXT),
        (f"<div id=main-menu><ul><li><a>One</a><li><a>Two</a></ul></div><div class=post>{STORY}</div>", TEXT),
        (f"<main><header><p>Site name and slogan</p></header>{STORY}<form><p>Your mail</p></form></main>", TEXT),
        (f"<article>{STORY}<aside><p>Read this other story too please</p></aside></article>", TEXT),
        (f"<article>{STORY}<div class='user-comments'><p>Nice story, thanks a lot for it</p></div></article>", TEXT),
        (f"<article><script>var x = '<p>no</p>';</script><style>p{{}}</style>{STORY}<!-- <p>not this</p> --></article>", TEXT),
        (f"<div class=cookie-notice>We use cookies on this site</div><article>{STORY}</article>", TEXT),
        (f"<article>{STORY}<p hidden>Nobody sees this text here</p></article>", TEXT),
        ("<article><p>Fish &amp; chips &lt;b&gt; &#233;&nbsp;x &notanentity;</article>", "Fish & chips <b> é x ¬anentity;"),
        ("<article><h2> A  title\n here </h2><ul><li>one<li>two</ul><p>un<b>bro</b>ken", "A title here\none\ntwo\nunbroken"),
        ("<article><p>1 < 2 and 3 > 2 hold</p></article>", "1 < 2 and 3 > 2 hold"),
        ("<p>cut off <a href='", "cut off"),
        (None, ""),
        ("", ""),
        ("<div></div>", ""),
        ("only words and no tags", "only words and no tags"),
    ],
)
def test_cases(html, text):
    assert html_region.main_text(html, WEIGHTS) == text


def test_very_long_page_is_read_whole():
    html = "<body><nav>a b</nav><article>" + "<p>some words here</p>" * 50_000 + "</article>"
    assert html_region.main_text(html, WEIGHTS).count("\n") == 49_999


def test_best_region():
    assert html_region.best_region([-1, 2, 3, -4, 5, -9, 1]) == (1, 5)
    assert html_region.best_region([-1, -2]) == (0, 0) and html_region.best_region([]) == (0, 0)


def test_learned_weights_keep_their_signs(spark):
    weights = html_region.fit(spark.read.parquet(f"{SF}/pages.parquet"))
    assert weights["word"] > 0 and weights["word:nav"] < 0
    assert all(w < 0 for k, w in weights.items() if k != "word")


def test_tables(spark):
    rows = [(1, "u", "<p>a b c</p>"), (1, "u", "<p>a b c</p>"), (None, None, None)]
    df = clashing(spark.createDataFrame(rows, "page_id long, url string, html string"), "main_text", "HTML", "text")
    found = html_region.extract(df, html_region.fit(df))
    assert sorted((str(r["page_id"]), r["main_text"]) for r in found.collect()) == [("1", "a b c"), ("1", "a b c"), ("None", "")]
    assert html_region.extract(df.filter("false"), {}).collect() == []
