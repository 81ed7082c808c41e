from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from storyloom.operators import notify, reextract, stats, tables
from storyloom.operators.ordering import number_rows
from storyloom.schemas import ARTICLES, WEBHOOK_LOGS
from storyloom.sources.pages import latest_pages
from test_listing import NOW, article, table

LATER = NOW + timedelta(hours=1)
INCOMING = (
    "title string, url string, publish_date timestamp, summary string, full_content string, fetch_time timestamp, "
    "posted_to_discord boolean, feed_url string, content_hash string, fetch_duration_ms int, batch_no long"
)


def incoming(spark, rows):
    return spark.createDataFrame(
        [(t, u, None, s, c, LATER, p, None, None, None, n) for n, (t, u, s, c, p) in enumerate(rows)], INCOMING
    )


def by_url(df):
    return {r.url: r for r in df.collect()}


def test_upsert_keeps_known_values_and_overwrites_the_rest(spark):
    arts = table(spark, [article(7, summary="old", posted_to_discord=True, cluster=3), article(8)])
    got = by_url(tables.upsert(arts, incoming(spark, [("new", "u7", None, None, False), ("add", "x", "s", None, True)]), LATER))
    assert (got["u7"].id, got["u7"].title, got["u7"].summary, got["u7"].full_content) == (7, "new", "old", "text")
    assert got["u7"].posted_to_discord is False and got["u7"].story_cluster_id == 3
    assert got["u7"].updated_at > got["u7"].created_at
    assert got["u8"].updated_at == got["u8"].created_at
    assert (got["x"].id, got["x"].summary, got["x"].story_cluster_id) == (9, "s", None)


def test_upsert_folds_repeated_urls_and_is_idempotent(spark):
    arts = table(spark, [article(1)])
    batch = incoming(spark, [("a", "n", "first", "body", True), ("b", "n", None, "later", False), ("c", "m", None, None, False)])
    once = tables.upsert(arts, batch, LATER)
    got = by_url(once)
    assert (got["n"].title, got["n"].summary, got["n"].full_content, got["n"].posted_to_discord) == ("b", "first", "later", False)
    assert (got["n"].id, got["m"].id) == (2, 3)
    twice = tables.upsert(once, batch, LATER)
    assert sorted(once.collect()) == sorted(twice.collect())


def test_insert_ignore_leaves_stored_urls_alone(spark):
    arts = table(spark, [article(4, title="kept")])
    new = table(spark, [article(0, url="u4", title="ignored"), article(0, url="b"), article(0, url="a"), article(0, url="a")])
    got = by_url(tables.insert_ignore(arts, new, [F.col("title")]))
    assert {u: r.id for u, r in got.items()} == {"u4": 4, "a": 5, "b": 6} and got["u4"].title == "kept"


def test_new_rows_are_numbered_without_their_texts(spark, monkeypatch):
    seen = []

    def spy(df, *args, **options):
        seen.append(df.columns)
        return number_rows(df, *args, **options)

    monkeypatch.setattr(tables, "number_rows", spy)
    arts = table(spark, [article(4)])
    batch = incoming(spark, [("a", "z", "s", "body", True), ("b", None, "n", "none", True), ("c", "y", None, "long", True)])
    got = by_url(tables.upsert(arts, batch, LATER))
    assert {u: (r.id, r.full_content) for u, r in got.items()} == {"u4": (4, "text"), "z": (5, "body"), None: (6, "none"), "y": (7, "long")}
    new = table(spark, [article(9, url="b", title="2"), article(9, url="c", title="1"), article(9, url="a", title="3")])
    got = by_url(tables.insert_ignore(arts, new, [F.col("title")], ["title"]))
    assert {u: r.id for u, r in got.items()} == {"u4": 4, "c": 5, "b": 6, "a": 7}
    assert seen == [["url", "batch_no"], ["url", "title"]]


def test_keyed_update_and_unmatched(spark):
    arts = table(spark, [article(1, summary="s"), article(2, summary="s")])
    updates = spark.createDataFrame([(1, None), (9, "x")], "id long, summary string")
    got = {r.id: r for r in tables.keyed_update(arts, updates, "id", ["summary"], LATER).collect()}
    assert (got[1].summary, got[2].summary) == (None, "s")
    assert got[1].updated_at > got[2].updated_at
    assert [r.id for r in tables.unmatched_updates(arts, updates, "id").collect()] == [9]


def log(i, article_id, attempt, code, ms=10):
    return (i, article_id, attempt, code, None, ms, None, NOW)


def test_webhook_stats_with_unmatched_articles_and_missing_codes(spark):
    arts = table(spark, [article(1, feed="a"), article(2, feed="a"), article(3, feed="b"), article(4, feed=None)])
    logs = spark.createDataFrame([log(1, 1, 1, None), log(2, 1, 2, 204, 30), log(3, 2, 1, 500, 20), log(4, 99, 1, 200)], WEBHOOK_LOGS)
    got = {r.feed_url: tuple(r)[1:5] for r in stats.webhook_stats(arts, logs).collect()}
    assert got == {"a": (3, 1, 2, 20.0), "b": (0, 0, 0, None), None: (0, 0, 0, None)}


def test_cascade_and_counts(spark):
    arts = table(spark, [article(1)])
    logs = spark.createDataFrame([log(1, 1, 1, 200), log(2, 5, 1, 200)], WEBHOOK_LOGS)
    assert [r.id for r in tables.cascade_delete(logs, arts).collect()] == [1]
    counts = tables.table_counts({"articles": arts, "webhook_logs": logs})
    assert {r.table_name: r.record_count for r in counts.collect()} == {"articles": 1, "webhook_logs": 2}


@pytest.mark.parametrize("slice_rows", [1_000_000, 50])
def test_numbering_a_hot_key_slice_by_slice(spark, slice_rows):
    df = spark.range(600).select(
        "id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50 + 1).alias("k"), (F.col("id") % 7).alias("t")
    )
    got = number_rows(df, ["k"], [F.col("t"), F.col("id")], slice_rows=slice_rows).toPandas()
    want = got.sort_values(["k", "t", "id"]).groupby("k").cumcount() + 1
    assert len(got) == 600 and (got.loc[want.index, "row_no"] == want).all()


def test_attempts_continue_after_the_highest(spark):
    logs = spark.createDataFrame([log(1, 1, 4, 500), log(2, 2, 1, 200)], WEBHOOK_LOGS)
    new = spark.createDataFrame(
        [(11, 1, NOW + timedelta(minutes=2)), (12, 1, NOW), (13, 3, NOW)], "id long, article_id long, created_at timestamp"
    )
    got = {r.id: r.attempt for r in notify.numbered_attempts(new, logs).collect()}
    assert got == {12: 5, 11: 6, 13: 1}


def test_deliver_stops_at_success_and_never_sends_oversized(spark):
    rows = [(1, "u1", "https://h/ok", "p", True), (2, "u2", "https://h/bad", "p", True), (3, "u3", "https://h/ok", "p", False)]
    payloads = spark.createDataFrame(rows, "id long, article_url string, webhook_url string, payload string, size_ok boolean")

    def send(url, payload):
        return 204 if url.endswith("ok") else 500

    got = {}
    for r in notify.deliver(payloads, send).collect():
        got.setdefault(r.id, []).append((r.attempt, r.response_code, r.ok))
    assert got == {
        1: [(1, 204, True)],
        2: [(1, 500, False), (2, 500, False), (3, 500, False)],
        3: [(1, None, False), (2, None, False), (3, None, False)],
    }


def test_eligibility_and_details(spark):
    old = NOW - timedelta(days=30)
    rows = [
        article(1, summary="s", feed="https://a.example/feed"),
        article(2, summary="s", posted_to_discord=True),
        article(3, summary="summary unavailable"),
        article(4, old, summary="s"),
        article(5, None, summary="s"),  # undated: announced as new, from an unknown feed
        article(6, summary="s", feed="https://noisy.example/feed"),
        article(7, summary="s", feed=None),
        article(8, summary="s", title="  "),
        article(9),
    ]
    got = notify.notify_eligible(table(spark, rows), NOW, NOW - timedelta(days=7), ["NOISY.example"])
    assert {r.id: r.feed_title for r in got.collect()} == {1: "a.example", 5: "Unknown Feed", 7: "Unknown Feed"}
    sent = notify.notification_payloads(table(spark, rows), ["https://h/1", " ", "https://h/2"], NOW, NOW, ["noisy"])
    assert sorted((r.id, r.webhook_url) for r in sent.collect()) == [
        (i, h) for i in (1, 5, 7) for h in ("https://h/1", "https://h/2")
    ]
    log = notify.deliver(sent, lambda url, body: 200 if url.endswith("1") else None, attempts=1)
    updates = notify.posted_updates(log)
    after = tables.keyed_update(table(spark, rows), updates, "id", ["posted_to_discord"], LATER)
    assert sorted(r.id for r in after.filter("posted_to_discord").collect()) == [1, 2, 5, 7]


def test_message_leaves_out_absent_parts_and_escapes(spark):
    df = spark.createDataFrame([("T <b> & c", "u", "", NOW, " ")], "t string, u string, s string, p timestamp, f string")
    (body,) = df.select(notify.message_json(F.col("t"), F.col("u"), F.col("s"), F.col("p"), F.col("f"))).first()
    assert '"title":"T \\u003cb\\u003e \\u0026 c"' in body and '"timestamp":"2026-07-15T14:30:00Z"' in body
    assert "author" not in body and "description" not in body and "avatar" not in body


def test_reextract_outcomes(spark):
    arts = table(spark, [article(i, url=f"https://site.example/{i}", summary="s", cluster=1) for i in (1, 2, 3, 4)])
    long = "<article>" + "word " * 100 + "</article>"
    pages = spark.createDataFrame(
        [("https://site.example/1", long, 200), ("https://site.example/2", "<article>short</article>", 200),
         ("https://site.example/3", long, 503)],
        "url string, html string, status int",
    )
    outcomes = reextract.reextract_outcomes(arts, pages, "SITE.example")
    assert {r.id: r.outcome for r in outcomes.collect()} == {1: "updated", 2: "skipped", 3: "failed", 4: "failed"}
    got = {r.id: r for r in reextract.reextract(arts, outcomes, LATER).collect()}
    assert got[1].summary is None and got[1].full_content.startswith("word word") and got[1].story_cluster_id == 1
    assert got[2].summary == "s" and got[2].full_content == "text"
    reset = {r.id: r for r in reextract.reextract(arts, outcomes, LATER, reset_embedding=True).collect()}
    assert reset[1].story_cluster_id is None and reset[2].story_cluster_id == 1
    assert {r.outcome: r.n for r in reextract.backfill_report(outcomes).collect()} == {"updated": 1, "skipped": 1, "failed": 2}


def test_schema_of_the_article_table(spark):
    assert table(spark, []).schema == ARTICLES
    assert datetime(2026, 7, 15, 14, 30, tzinfo=timezone.utc) == NOW


def test_repeated_update_keys_keep_the_number_of_rows(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, x string")
    updates = spark.createDataFrame([(1, "c"), (1, "d"), (1, None), (9, "z")], "id long, x string")
    assert sorted(map(tuple, tables.keyed_update(rows, updates, "id", ["x"]).collect())) == [(1, "d"), (2, "b")]


def test_of_several_fetches_of_a_page_the_latest_counts(spark):
    pages = spark.createDataFrame([("u", "old", 1), ("u", "new", 3), ("v", None, 1), ("v", "x", 2)], "url string, html string, fetched_at int")
    assert sorted(map(tuple, latest_pages(pages).collect())) == [("u", "new"), ("v", "x")]
    assert latest_pages(pages.drop("fetched_at")).count() == 2
