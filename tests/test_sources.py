from datetime import datetime, timezone

from pyspark.sql import functions as F

from storyloom.functions.time import parse_feed_time
from storyloom.functions.text import SUMMARY_UNAVAILABLE
from storyloom.operators import cluster, summarize
from storyloom.sources import feeds
from storyloom.sources.tables import append, read_table
from storyloom.schemas import ARTICLES
from test_listing import NOW, article, table

RSS = """<?xml version="1.0"?><rss version="2.0"><channel><title>c</title>
<item><title>One &amp; only</title><link>https://e.example/1</link><pubDate>Tue, 01 Jul 2025 08:00:00 EST</pubDate>
<description>first</description></item>
<item><title>Undated</title><link>https://e.example/2</link></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>f</title><entry><title>Entry</title>
<link rel="self" href="https://e.example/self"/><link rel="alternate" href="https://e.example/3"/>
<updated>2025-07-01T10:00:00+02:00</updated><summary>sum</summary></entry></feed>"""


def test_feed_list_file(spark, tmp_path):
    path = tmp_path / "feeds.txt"
    path.write_text("# comment\n\n  https://a.example/feed \n\t#x\nhttps://b.example/feed\n")
    assert [r.feed_url for r in feeds.read_feed_list(spark, str(path)).collect()] == ["https://a.example/feed", "https://b.example/feed"]


def test_rss_and_atom_documents(spark, tmp_path):
    (tmp_path / "a.xml").write_text(RSS)
    (tmp_path / "b.xml").write_text(ATOM)
    shell = RSS.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    (tmp_path / "c.html").write_text(f"<html><body><pre>{shell}</pre></body></html>")
    got = feeds.parse_feeds(feeds.read_feed_files(spark, str(tmp_path))).withColumn("published", F.col("published").cast("timestamp_ntz"))
    rows = sorted((r.feed_url[-6:], r.item_no, r.link, r.title, r.published, r.description) for r in got.collect())
    at = datetime(2025, 7, 1, 13)
    assert rows == [
        ("/a.xml", 0, "https://e.example/1", "One & only", at, "first"),
        ("/a.xml", 1, "https://e.example/2", "Undated", None, None),
        ("/b.xml", 0, "https://e.example/3", "Entry", datetime(2025, 7, 1, 8), "sum"),
        ("c.html", 0, "https://e.example/1", "One & only", at, "first"),
        ("c.html", 1, "https://e.example/2", "Undated", None, None),
    ]


RDF = """<?xml version="1.0"?><!-- <rss> --><rdf:RDF xmlns:rdf="r" xmlns="http://purl.org/rss/1.0/" xmlns:dc="d">
<channel><title>c</title></channel><item><title>R</title><link>https://e.example/4</link>
<dc:date>2025-07-01T10:00:00Z</dc:date></item></rdf:RDF>"""
PREFIXED = """<atom:feed xmlns:atom="http://www.w3.org/2005/Atom"><atom:entry><atom:title>P</atom:title>
<atom:link href="https://e.example/5"/><atom:updated>2025-07-01T10:00:00Z</atom:updated></atom:entry></atom:feed>"""
CDATA = ATOM.replace("<summary>sum</summary>", "<summary><![CDATA[about <rss version='2.0'> feeds]]></summary>")
DC = RSS.replace("<pubDate>Tue, 01 Jul 2025 08:00:00 EST</pubDate>", "<dc:date>2025-07-01T13:00:00Z</dc:date>")


def test_other_feed_shapes(spark):
    shapes = [("rdf", RDF), ("prefixed", PREFIXED), ("cdata", CDATA), ("dc", DC), ("page", "<html><feed/></html>"), ("none", None)]
    documents = spark.createDataFrame(shapes, "feed_url string, xml string")
    got = feeds.parse_feeds(documents).withColumn("published", F.col("published").cast("timestamp_ntz")).collect()
    assert sorted((r.feed_url, r.item_no, r.link, r.title, r.published and r.published.hour) for r in got) == [
        ("cdata", 0, "https://e.example/3", "Entry", 8),
        ("dc", 0, "https://e.example/1", "One & only", 13),
        ("dc", 1, "https://e.example/2", "Undated", None),
        ("prefixed", 0, "https://e.example/5", "P", 10),
        ("rdf", 0, "https://e.example/4", "R", 10),
    ]
    failed = {r.feed_url for r in feeds.parse_outcomes(documents).collect() if r.message == "parse_failed"}
    assert failed == {"page", "none"}


def test_feed_dates(apply):
    forms = [
        "Tue, 01 Jul 2025 08:00:00 EST", "01-Jul-25 13:00:00 GMT", "1 July 2025 13:00 +0000", "Tuesday, 01-Jul-25 13:00:00 UTC",
        "Tue 1 Jul 2025 13:00:00 CEST", "2025-07-01T15:00:00+02:00", "01 Jul 99 13:00 GMT", "soon",
    ]
    got = apply(forms, "string", lambda c: parse_feed_time(c).cast("timestamp_ntz"))
    at = datetime(2025, 7, 1, 13)
    assert got == [at] * 6 + [at.replace(year=1999), None]


def test_rss_files_split_by_the_reader(spark, tmp_path):
    (tmp_path / "a.xml").write_text(RSS)
    rows = feeds.read_rss_files(spark, str(tmp_path)).collect()
    assert sorted((r.link, r.title) for r in rows) == [("https://e.example/1", "One & only"), ("https://e.example/2", "Undated")]


def test_solver_envelopes(apply):
    ok = '{"status":"ok","message":"","solution":{"status":200,"response":"<rss/>"}}'
    got = apply([ok, ok.replace("200", "403"), ok.replace('"ok"', '"error"'), "junk"], "string", feeds.solver_response)
    assert got == ["<rss/>", None, None, None]


def test_tables_round_trip_by_day(spark, tmp_path):
    path = str(tmp_path / "articles")
    append(table(spark, [article(1), article(2, None)]), path, day_of="publish_date")
    got = read_table(spark, path, ARTICLES)
    assert sorted(r.id for r in got.collect()) == [1, 2] and got.columns == ARTICLES.fieldNames()


def test_summaries_retry_and_fall_back(spark):
    rows = table(spark, [article(1, full_content="One. Two! Three? Four."), article(2, full_content="bad"), article(3, full_content="  ")])

    def model(prompt, text):
        if text == "bad":
            raise RuntimeError("down")
        return "<think>hm</think> " + summarize.lead_sentences(prompt, text)

    attempts = summarize.summary_attempts(rows, model).cache()
    log = sorted((r.id, r.retry_attempt, r.status, r.error_message) for r in attempts.collect())
    assert log == [
        (1, 1, "success", ""),
        (2, 1, "retry_failed", "down"), (2, 2, "retry_failed", "down"), (2, 3, "failed", "down"),
        (2, 3, "retry_failed", "down"), (3, 0, "failed", summarize.EMPTY_TEXT),
    ]
    final = {r.id: r.summary for r in summarize.final_summaries(attempts).collect()}
    assert final == {1: "One. Two! Three?", 2: SUMMARY_UNAVAILABLE, 3: SUMMARY_UNAVAILABLE}


def test_embedding_skips_failures_and_fallback_texts(spark):
    rows = table(spark, [article(1, summary="alpha beta"), article(2, summary=SUMMARY_UNAVAILABLE), article(3, summary="boom"), article(4)])

    def embedder(text):
        if text == "boom":
            raise ValueError(text)
        return summarize.word_hash_vector(text, 8)

    got = summarize.embed_rows(cluster.pending_embedding(rows, NOW), embedder).collect()
    assert [(r.id, len(r.summary_embedding)) for r in got] == [(1, 8)]
    assert datetime(2026, 7, 15, tzinfo=timezone.utc) < NOW
