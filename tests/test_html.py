import pandas as pd
import pytest
from pyspark.sql import functions as F

from storyloom.functions.html import _shell_texts_batch, extract_main_content, main_text, unwrap_feed_xml
from storyloom.operators import summarize
from storyloom.sources.feeds import parsed_documents

LONG = "The long story. " * 40


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<body><article>short</article><article>the longer one</article></body>", "the longer one"),
        ("<body><article>teaser</article><div class='x entry-content'>the real, longer body</div></body>",
         "the real, longer body"),
        ("<article>Body<div id='ar-widget'>Listen now</div> text</article>", "Body text"),
        ("<article>a<script>var t='</p>';</script><style>p{}</style>b</article>", "ab"),
        ("<article>a<span class='ad-label'>AD</span>b</article>", "ab"),
        ("<body><nav>menu</nav><div class='page-content'>page</div></body>", "page"),
        ("<body><nav>menu</nav><main>first</main><main>second longer</main></body>", "first"),
        ("<html><head><title>t</title></head><body>only <b>body</b></body></html>", "only body"),
        ("<article>teaser</article><section class='a k5a-article'>the story itself</section>", "the story itself"),
        ("<body><article>  </article><main>never reached</main></body>", "  "),
        ("<body><article></article><main>reached</main></body>", "reached"),
        ("<article>x &amp; y &lt;z&gt; &eacute;</article>", "x & y <z> é"),
        ("<article><p>one<p>two<div>three</article> outside", "onetwothree"),
        ("<div><article>in</div> out</article>", "in"),
        ("plain text, no markup", "plain text, no markup"),
        ("<article>same</article><article>size</article>", "same"),
        ("<div class='post-body'>aaaa</div><div class='post-content'>bbbb</div>", "bbbb"),
        ("<article>ééé</article><article>abcde</article>", "ééé"),
        ("", ""),
    ],
)
def test_main_text(html, want):
    assert main_text(html) == want


def test_wide_wrapper_never_beats_a_precise_match():
    html = f"<div class='content'><nav>{LONG}</nav><article>story</article></div>"
    assert main_text(html) == "story"


def test_extraction_trims_and_clips(apply):
    got = apply(["<article>  " + "é" * 10 + "  </article>", None], "string", lambda c: extract_main_content(c, 5))
    assert got == ["éé...", None]


def test_unwrap_feed_xml(apply):
    rss = '<rss version="2.0"><channel><title>a &amp; b</title></channel></rss>'
    escaped = rss.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    cases = {
        f"  {rss}\n": rss,
        '<?xml version="1.0"?><feed/>': '<?xml version="1.0"?><feed/>',
        f"<html><body><pre>{escaped}</pre></body></html>": rss,
        f"<html><body><pre> </pre><p>{escaped}</p></body></html>": rss,
        f'<html><body><div id="webkit-xml-viewer-source-xml">{rss}</div><pre>no</pre></body></html>': rss,
        "nothing here": "nothing here",
    }
    assert apply(list(cases), "string", unwrap_feed_xml) == list(cases.values())


def test_a_source_copy_ends_with_its_own_element(apply):
    feed = "<rss><channel><item><description><div>a</div><!-- </div> --><![CDATA[</div>]]></description></item></channel></rss>"
    copy = f'<div class="x" id="webkit-xml-viewer-source-xml">{feed}</div>'
    pages = [
        f"<html><body>{copy}</body></html>",
        f"<html><body><div>head</div>{copy}<div class='viewer'><div>rendered &lt;rss&gt;</div></div><div/></body></html>",
        "<html><body><div id='webkit-xml-viewer-source-xml'>plain</div><pre>p</pre></body></html>",
        "<html><body><div id='webkit-xml-viewer-source-xml'><rss>never closed</body></html>",
    ]
    found = apply(pages, "string", unwrap_feed_xml)
    assert found[:3] == [feed, feed, "p"] and "never closed" in found[3]


def test_texts_reach_python_in_bounded_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(key)
    articles = spark.range(300).select("id", F.lit("u").alias("url"), F.expr("repeat('x', 100000)").alias("full_content"))

    def sizes(batches):
        for batch in batches:
            yield pd.DataFrame({"n": [len(batch)]})

    def largest():
        return articles.coalesce(1).mapInPandas(sizes, "n long").agg(F.max("n")).first()[0]

    try:
        for build in (
            lambda: unwrap_feed_xml(F.col("full_content")),
            lambda: extract_main_content(F.col("full_content")),
            lambda: parsed_documents(articles.select(F.col("url").alias("feed_url"), F.col("full_content").alias("xml"))),
            lambda: summarize.summary_attempts(articles),
            lambda: summarize.embed_rows(articles.withColumn("summary", F.col("full_content"))),
        ):
            spark.conf.set(key, str(1 << 30))
            build()
            assert largest() <= 50
    finally:
        spark.conf.set(key, held)


def test_shell_texts_of_a_batch():
    pages = pd.Series([None, "<html><body>b<pre>p</pre></body></html>", ""])
    found = [tuple(r) for r in _shell_texts_batch.func(pages).itertuples(index=False)]
    assert found == [(None, None, None), ("p", "bp", ""), ("", "", "")]
    assert list(_shell_texts_batch.func(pages[:0]).columns) == ["pre", "body", "source"]
