import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from storyloom.operators import alerts
from storyloom.operators.breaker import breaker_replay
from storyloom.schemas import ITEMS
from storyloom.sources.feeds import stream_feed_files
from storyloom.streaming.alerts import alert_stream, breaker_stream
from storyloom.streaming.clusters import ASSIGNMENTS, cluster_stream
from storyloom.streaming.ingest import bounded_dedup, ingest_stream

DRAIN = {"availableNow": True}
T0 = datetime(2025, 6, 1, tzinfo=timezone.utc)
EARLY = datetime(2020, 1, 1, tzinfo=timezone.utc)


def land(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_ingest_skips_what_is_stored_and_survives_a_replay(spark, tmp_path):
    landing, out = str(tmp_path / "landing"), str(tmp_path / "articles")

    def run(state):
        items = spark.readStream.schema(ITEMS).parquet(landing)
        ingest_stream(items, out, str(tmp_path / state), T0, EARLY, lambda: T0, DRAIN).awaitTermination()
        return sorted(r.url for r in spark.read.parquet(out).collect())

    land(spark, [("f", 0, "a", "t", T0, "d"), ("g", 0, "a", "t", T0, "d"), ("f", 1, "old", "t", EARLY, "d")], ITEMS, landing)
    assert run("one") == ["a"]
    land(spark, [("f", 2, "a", "t", T0, "d"), ("f", 3, "b", "t", T0, "d")], ITEMS, landing)
    assert run("one") == ["a", "b"]
    assert run("lost-checkpoint") == ["a", "b"]


def test_landed_feed_documents_become_articles_with_page_text(spark, tmp_path):
    landing, out = tmp_path / "landing", str(tmp_path / "articles")
    landing.mkdir()
    log = str(tmp_path / "log")
    item = "<item><title>{0}</title><link>https://e.example/{0}</link><pubDate>{1}</pubDate><description>d{0}</description></item>"
    new, old = "Sun, 01 Jun 2025 10:00:00 GMT", "Wed, 01 Jan 2020 10:00:00 GMT"

    def rss(*items):
        return '<rss version="2.0"><channel>' + "".join(item.format(n, at) for n, at in items) + "</channel></rss>"

    pages = spark.createDataFrame([("https://e.example/b", "<article>page b</article>")], "url string, html string")

    def run():
        items = stream_feed_files(spark, str(landing), 1)
        ingest_stream(items, out, str(tmp_path / "state"), T0, EARLY, lambda: T0, DRAIN, lambda: pages, log).awaitTermination()
        return {r.url[-1]: r.full_content for r in spark.read.parquet(out).collect()}

    (landing / "one.xml").write_text(rss(("a", new), ("b", new), ("z", old)))
    assert run() == {"a": "da", "b": "page b"}
    (landing / "two.xml").write_text(rss(("a", new), ("c", new)))
    assert run() == {"a": "da", "b": "page b", "c": "dc"}
    logged = {r.feed_url[-7:]: (r.articles_found, r.new_articles) for r in spark.read.parquet(log).collect()}
    assert logged == {"one.xml": (3, 2), "two.xml": (2, 1)}


def test_clusters_grow_over_batches(spark, tmp_path):
    schema = "id long, publish_date timestamp, summary_embedding array<float>"
    landing, out = str(tmp_path / "landing"), str(tmp_path / "assigned")

    def run():
        arts = spark.readStream.schema(schema).parquet(landing)
        cluster_stream(arts, out, str(tmp_path / "state"), lambda: T0, 0.85, 35, DRAIN).awaitTermination()
        return {r.id: r.story_cluster_id for r in spark.read.schema(ASSIGNMENTS).parquet(out).collect()}

    hour = timedelta(hours=1)
    land(spark, [(1, T0, [1.0, 0.0]), (2, T0 + hour, [0.99, 0.1]), (3, T0 - timedelta(days=50), [1.0, 0.0])], schema, landing)
    assert run() == {1: 1, 2: 1}
    land(spark, [(4, T0 + 2 * hour, [0.0, 1.0]), (5, T0 + 3 * hour, [1.0, 0.05])], schema, landing)
    assert run() == {1: 1, 2: 1, 4: 4, 5: 1}
    future = T0 + timedelta(days=27_000)
    land(spark, [(6, future, [1.0, 0.01]), (7, T0 + 4 * hour, [0.99, 0.0])], schema, landing)
    assert run() == {1: 1, 2: 1, 4: 4, 5: 1, 6: 1, 7: 1}
    land(spark, [(8, T0 + 5 * hour, [0.01, 1.0])], schema, landing)
    assert run()[8] == 4


def test_a_date_to_come_does_not_close_the_watermark(spark, tmp_path):
    landing, out = str(tmp_path / "landing"), str(tmp_path / "out")

    def run():
        stream = bounded_dedup(spark.readStream.schema(ITEMS).parquet(landing), F.lit(T0))
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state"))
        query.outputMode("append").trigger(**DRAIN).start().awaitTermination()
        return sorted(r.link for r in spark.read.parquet(out).collect())

    future, day = T0 + timedelta(days=27_000), timedelta(days=1)
    for link, at in (("a", future), ("b", T0 - 9 * day), ("c", T0 - 8 * day), ("b\ufffd", T0 - 7 * day)):
        land(spark, [("f", 0, link, "t", at, "d")], ITEMS, landing)
        found = run()
    assert found == ["a", "b", "c"]


def test_a_failure_between_the_appends_changes_nothing(spark, tmp_path, monkeypatch):
    from storyloom.streaming import ingest

    landing, out, log = (str(tmp_path / x) for x in ("landing", "articles", "log"))
    land(spark, [("f", 0, "a", "t", T0, "d"), ("f", 1, "a\ufffd", "t", T0, "d"), ("g", 0, "b", "t", T0, "d")], ITEMS, landing)

    def run():
        items = spark.readStream.schema(ITEMS).parquet(landing)
        ingest_stream(items, out, str(tmp_path / "state"), T0, EARLY, lambda: T0, DRAIN, None, log).awaitTermination()

    def broken(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(ingest, "batch_log", broken)
        with pytest.raises(StreamingQueryException):
            run()
    assert spark.read.parquet(out).count() == 2
    for _ in range(2):
        run()
    assert sorted(r.url for r in spark.read.parquet(out).collect()) == ["a", "b"]
    logged = sorted((r.run, r.feed_url, r.articles_found, r.new_articles) for r in spark.read.parquet(log).collect())
    assert logged == [(0, "f", 2, 1), (0, "g", 1, 1)]


def test_breaker_state_carries_over_batches(spark, tmp_path):
    schema = "name string, ts timestamp, seq long, ok boolean"
    landing, out = str(tmp_path / "landing"), str(tmp_path / "out")
    rows = [("x", T0 + timedelta(seconds=20 * i), i, i % 9 > 5) for i in range(40)]

    def run():
        stream = breaker_stream(spark.readStream.schema(schema).parquet(landing))
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state"))
        query.outputMode("append").trigger(**DRAIN).start().awaitTermination()

    for part in (rows[:13], rows[13:]):
        land(spark, part, schema, landing)
        run()
    want = breaker_replay(spark.createDataFrame(rows, schema)).collect()
    assert sorted(spark.read.parquet(out).collect()) == sorted(want)


def drain(stream, tmp_path):
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out"))
    query = query.option("checkpointLocation", str(tmp_path / "state")).outputMode("append")
    query.trigger(**DRAIN).start().awaitTermination()


def shuffled_batches(rows, seed, lateness):
    """Three batches of rows by their times (second field), none more than ``lateness`` seconds behind the latest."""
    rng = random.Random(seed)
    start, third = rows[0][1], (rows[-1][1] - rows[0][1]).total_seconds() / 3 + 1
    parts = [[], [], []]
    for r in rows:
        parts[min(int(((r[1] - start).total_seconds() + rng.uniform(0, lateness)) // third), 2)].append(r)
    for p in parts:
        rng.shuffle(p)
    return parts


def test_attempts_out_of_order_are_replayed_in_order(spark, tmp_path):
    schema = "name string, ts timestamp, seq long, ok boolean"
    rows = [(n, T0 + timedelta(seconds=20 * i, microseconds=i), i, (i * 7 + k) % 9 > 5) for i in range(60) for k, n in enumerate(("x", None, "y"))]
    rows += [("x", rows[90][1], 1000, False)]  # equal times are told apart by seq
    rows.sort(key=lambda r: r[1])
    landing = str(tmp_path / "landing")
    parts = shuffled_batches(rows, 1, 100)
    assert all(parts) and parts[0] != sorted(parts[0], key=lambda r: r[1])
    for part in parts:  # each drained on its own, state kept in between
        land(spark, part, schema, landing)
        drain(breaker_stream(spark.readStream.schema(schema).parquet(landing), delay="120 seconds"), tmp_path)
    want = [r for r in breaker_replay(spark.createDataFrame(rows, schema)).collect()]
    edge = max(r.ts for r in want) - timedelta(seconds=120)
    closed = {tuple(r) for r in want if r.ts < edge.replace(microsecond=edge.microsecond // 1000 * 1000)}
    found = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert len(found) == len(set(found)) and set(found) == closed and len(closed) > 150


def test_samples_out_of_order_give_the_edges_of_the_batch_operator(spark, tmp_path):
    rule = alerts.Rule("r", "m", "gt", 3.0, "w", "d")
    schema = "metric string, tick timestamp, series string, value double"
    rng = random.Random(3)
    rows = [("m", T0 + timedelta(minutes=i), s, float(rng.randint(0, 6))) for i in range(60) for s in ("a", "b")]
    landing = str(tmp_path / "landing")
    for part in shuffled_batches(rows, 2, 300):
        land(spark, part, schema, landing)
        drain(alert_stream(spark.readStream.schema(schema).parquet(landing), [rule], delay="6 minutes"), tmp_path)
    want = alerts.transitions(alerts.evaluate(spark.createDataFrame(rows, schema), [rule]))
    closed = want.filter(F.col("tick") < F.lit(T0 + timedelta(minutes=53))).select("rule", "series", "status", "tick", "value")
    found = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, closed.collect())) and found.count() > 20


def test_late_rows_are_dropped_not_folded_twice(spark, tmp_path):
    schema = "name string, ts timestamp, seq long, ok boolean"
    landing = str(tmp_path / "landing")
    batches = [[("x", T0, 0, False), ("x", T0 + timedelta(hours=1), 1, False)], [("x", T0 + timedelta(minutes=5), 2, False)], [("x", T0 + timedelta(hours=3), 3, True)]]
    for rows in batches:
        land(spark, rows, schema, landing)
        drain(breaker_stream(spark.readStream.schema(schema).parquet(landing), delay="10 minutes"), tmp_path)
    assert sorted(r.seq for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1]
