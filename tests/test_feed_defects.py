"""Feed documents with defects: what is recovered, and what is told."""

import pytest

from storyloom.functions.feed_xml import recovered, repaired
from storyloom.operators import admission
from storyloom.sources import feeds
from storyloom.streaming import ingest

GOOD = "<item><title>One</title><link>https://e.example/1</link><pubDate>Tue, 01 Jul 2025 08:00:00 GMT</pubDate><description>d</description></item>"


def rss(body):
    return f'<?xml version="1.0" encoding="ISO-8859-1"?><rss version="2.0"><channel><title>c</title>{body}'


END = "</channel></rss>"
SHAPES = {
    "good": (rss(GOOD + END), ["One"], "success"),
    "none": (rss(END), [], "success"),
    "bare": (rss(GOOD + "<item><title>Q & A &nbsp;&copy; &unknown; &amp; AT&T</title></item>" + END), ["One", "Q & A \xa0© &unknown; & AT&T"], "success"),
    "cdata": (rss("<item><title><![CDATA[a & b &amp; <i>]]></title></item><item><title>c & d</title></item>" + END), ["a & b &amp; <i>", "c & d"], "success"),
    "control": (rss("<item><title>bell\x07 & x</title></item>" + END), ["bell & x"], "success"),
    "cut": (rss(GOOD + "<item><title>Two</tit"), ["One"], "error"),
    "crossed": (rss(GOOD + "<item><title>Two</link></item>" + GOOD + END), ["One"], "error"),
    "page": ("<html><body>no feed</body></html>", [], "error"),
    "empty": ("", [], "error"),
    "null": (None, [], "error"),
    "atom": (
        '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>A & B</title><link rel="self" href="x"/><link href="https://e.example/7"/>'
        "<updated>2025-07-01T08:00:00Z</updated><summary>s</summary></entry><entry><title>cut",
        ["A & B"], "error",
    ),
    "rdf": ('<rdf:RDF xmlns:rdf="r" xmlns:dc="d"><item><title>R & D</title><link>https://e.example/8</link><dc:date>2025-07-01T08:00:00Z</dc:date></item></rdf:RDF>', ["R & D"], "success"),
    "undeclared": ('<rdf:RDF xmlns:rdf="r"><item><title>R & D</title><dc:date>2025</dc:date></item></rdf:RDF>', [], "error"),
}


@pytest.fixture(scope="module")
def documents(spark):
    return spark.createDataFrame([(k, x) for k, (x, _, _) in SHAPES.items()], "feed_url string, xml string").repartition(2)


def test_items_and_outcomes(spark, documents):
    found = {k: [] for k in SHAPES}
    for r in sorted(feeds.parse_feeds(documents).collect(), key=lambda r: (r.feed_url, r.item_no)):
        found[r.feed_url].append(r.title)
    assert found == {k: titles for k, (_, titles, _) in SHAPES.items()}
    outcomes = {r.feed_url: r for r in feeds.parse_outcomes(documents).collect()}
    assert {k: (r.status, r.articles_found) for k, r in outcomes.items()} == {k: (s, len(t)) for k, (_, t, s) in SHAPES.items()}
    assert all((r.message == "parse_failed") == (r.status == "error") for r in outcomes.values())
    assert "unclosed token" in outcomes["cut"].detail and outcomes["page"].detail == "Failed to parse feed: not a feed"


def test_fields_of_recovered_items_equal_those_of_good_ones(spark):
    whole = rss(GOOD + END)
    rows = feeds.parse_feeds(spark.createDataFrame([("a", whole), ("b", whole.replace("<title>c<", "<title>c & c<")), ("c", whole[:-8])], "feed_url string, xml string"))
    assert len({(r.link, r.title, r.published, r.description) for r in rows.collect()}) == 1 and rows.count() == 3


def test_rows_of_atom_and_rdf_have_their_links_and_dates(documents):
    rows = {r.feed_url: r for r in feeds.parse_feeds(documents).filter("feed_url IN ('atom', 'rdf')").collect()}
    assert (rows["atom"].link, rows["rdf"].link) == ("https://e.example/7", "https://e.example/8")
    assert rows["atom"].published == rows["rdf"].published is not None and rows["atom"].description == "s"


def test_repairs_leave_references_and_verbatim_parts():
    assert repaired("&#65;&#x41;&lt;&eacute; a&b; <!-- & --><![CDATA[&]]>") == "&#65;&#x41;&lt;é a&amp;b; <!-- & --><![CDATA[&]]>"
    assert recovered(None) is None and recovered("")[0] == []
    assert repaired("&lt &amp &euro;") == "&amp;lt &amp;amp €"


def test_log_rows_tell_what_their_own_run_found(spark):
    statuses = spark.createDataFrame(
        [(1, "f", "processed"), (1, "f", "skipped_duplicate"), (2, "f", "processed"), (2, None, "processed"), (1, "g", "processed")],
        "run long, feed_url string, status string",
    )
    fetches = spark.createDataFrame(
        [(1, "f", "success", "", 5), (2, "f", "success", "", 6), (3, "f", "success", "", 7), (1, "g", "error", "x", 8), (2, None, "success", "", 9)],
        "run long, feed_url string, status string, message string, duration_ms long",
    )
    from datetime import datetime

    rows = admission.fetch_log_rows(statuses, fetches, datetime(2025, 7, 1)).collect()
    assert {(r.run, r.feed_url): (r.articles_found, r.new_articles) for r in rows} == {
        (1, "f"): (2, 1), (2, "f"): (1, 1), (3, "f"): (0, 0), (1, "g"): (0, 0), (2, None): (0, 0),
    }


def test_half_written_decisions_are_made_again(spark, tmp_path):
    from datetime import datetime, timezone

    from pyspark.sql import functions as F

    at = datetime(2025, 7, 1, tzinfo=timezone.utc)
    batch = spark.createDataFrame([(f"l{i}", at, "f", i) for i in range(10)], "link string, published timestamp, feed_url string, item_no long")
    stored = spark.createDataFrame([("l3",)], "url string")
    folder = str(tmp_path / "decided")

    def decide(rows, run):
        return {r.link: r.status for r in ingest._decisions(rows, stored, at, at, folder, run).collect()}

    whole = decide(batch, 4)
    assert len(whole) == 10 and whole["l3"] == "skipped_duplicate"
    # What was decided holds, whatever is stored by now.
    assert {r.link: r.status for r in ingest._decisions(batch, batch.select(F.col("link").alias("url")), at, at, folder, 4).collect()} == whole
    # The driver went down while run 6 was writing: some of its rows are there, but not the mark.
    part = batch.filter("item_no < 4").withColumn("status", F.lit("processed")).withColumn("_run", F.lit(6).cast("long"))
    part.write.mode("overwrite").parquet(folder)
    assert decide(batch, 6) == whole
