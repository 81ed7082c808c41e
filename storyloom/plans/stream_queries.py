"""Streams over the given tables, drained with ``availableNow`` into tables that are then read back."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.operators import alerts
from storyloom.plans import derived as d
from storyloom.plans.metric_queries import BREAKER_SQL, DAILY_SQL, EVENTS_SQL, P95_SQL, stage_events
from storyloom.plans.registry import query
from storyloom.plans.story_queries import leader_sql
from storyloom.session import shared_folder
from storyloom.streaming.alerts import alert_stream, breaker_stream
from storyloom.streaming.clusters import cluster_stream
from storyloom.streaming.ingest import bounded_dedup, ingest_stream
from storyloom.streaming.metrics import windowed_counts, windowed_rates
from storyloom.streaming.rollups import BOUNDS, compact, read_totals, rollup_daily_ingestion, rollup_p95, rollup_stream

DRAIN = {"availableNow": True}


def _drain_into(stream: DataFrame, out: str, state: str) -> None:
    """Run an append-mode stream to the end of what there is now."""
    run = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", state)
        .outputMode("append")
        .trigger(**DRAIN)
        .start()
    )
    run.awaitTermination()


def _drain(stream: DataFrame, name: str) -> str:
    """Run an append-mode stream to its end; returns the folder it wrote."""
    out, state = (shared_folder(stream.sparkSession, f"{name}-{part}") for part in ("out", "state"))
    _drain_into(stream, out, state)
    return out


def _drained(stream: DataFrame, name: str) -> DataFrame:
    return stream.sparkSession.read.schema(stream.schema).parquet(_drain(stream, name))


@query(
    "ingest_stream",
    """SELECT link AS url, title, published AS publish_date, feed_url, sha256(title || link || description)
         AS content_hash FROM items
       WHERE link IS NOT NULL AND published >= TIMESTAMP '2025-07-15 14:30:00' - INTERVAL 100 DAY QUALIFY
       row_number() OVER (PARTITION BY link ORDER BY published, feed_url NULLS FIRST, item_no) = 1""",
)
def _(spark, sf):
    items = d.items_from(d.articles_from(d.stream(spark, sf, "documents")))
    table, state = shared_folder(spark, "articles"), shared_folder(spark, "ingest-state")
    run = ingest_stream(items, table, state, d.CUTOFF, d.INITIATION, lambda: d.ARTICLE_NOW, DRAIN)
    run.awaitTermination()
    return spark.read.parquet(table).select("url", "title", "publish_date", "feed_url", "content_hash")


@query("stream_dedup", "SELECT DISTINCT link FROM items WHERE link IS NOT NULL AND published IS NOT NULL")
def _(spark, sf):
    items = d.items_from(d.articles_from(d.stream(spark, sf, "documents")))
    return _drained(bounded_dedup(items, F.lit(d.ARTICLE_NOW)).select("link"), "dedup")


@query(
    "late_data",
    """WITH timed AS (SELECT least(published, TIMESTAMP '2025-07-15 14:30:00') AS seen, link FROM items
         WHERE published IS NOT NULL)
       SELECT date_trunc('day', seen) AS window_start, date_trunc('day', seen) + INTERVAL 1 DAY AS window_end,
         count(*) AS events, count(link) AS good FROM timed GROUP BY 1, 2
       HAVING date_trunc('day', seen) + INTERVAL 1 DAY <= (SELECT max(seen) FROM timed) - INTERVAL 35 DAY""",
)
def _(spark, sf):
    items = d.items_from(d.articles_from(d.stream(spark, sf, "documents")))
    at = F.least("published", F.lit(d.ARTICLE_NOW))  # dates to come would close every window
    events = items.filter(F.col("published").isNotNull()).select(at.alias("ts"), F.col("link").isNotNull().alias("ok"))
    return _drained(windowed_counts(events, [], "1 day", delay="35 days"), "late")


def _fetch_stream(spark, sf):
    logs = d.fetch_logs_from(d.stream(spark, sf, "events"))
    return logs.select(F.col("created_at").alias("ts"), "feed_url", "id", (F.col("status") == "success").alias("ok"))


CLOSED = "(SELECT max(created_at) FROM fetch_logs) - INTERVAL 10 MINUTE"


@query(
    "windowed_metrics",
    f"""SELECT date_trunc('hour', created_at) AS window_start, date_trunc('hour', created_at) + INTERVAL 1 HOUR
          AS window_end, feed_url, count(*) AS events, count(*) FILTER (WHERE status = 'success') AS good,
          count(*) / 3600 AS rate FROM fetch_logs GROUP BY 1, 2, 3
        HAVING date_trunc('hour', created_at) + INTERVAL 1 HOUR <= {CLOSED}""",
)
def _(spark, sf):
    return _drained(windowed_rates(_fetch_stream(spark, sf), ["feed_url"], "1 hour"), "rates")


@query(
    "windowed_metrics_sliding",
    f"""SELECT w AS window_start, w + INTERVAL 6 HOUR AS window_end, count(*) AS events,
          count(*) FILTER (WHERE status = 'success') AS good
        FROM (SELECT *, unnest([time_bucket(INTERVAL 2 HOUR, created_at), time_bucket(INTERVAL 2 HOUR, created_at)
          - INTERVAL 2 HOUR, time_bucket(INTERVAL 2 HOUR, created_at) - INTERVAL 4 HOUR]) AS w FROM fetch_logs)
        GROUP BY 1 HAVING w + INTERVAL 6 HOUR <= {CLOSED}""",
)
def _(spark, sf):
    return _drained(windowed_counts(_fetch_stream(spark, sf), [], "6 hours", "2 hours"), "sliding")


@query(
    "cluster_stream",
    leader_sql(
        """SELECT row_number() OVER (ORDER BY publish_date, id) AS rn, id, summary_embedding::DOUBLE[] AS v
           FROM articles WHERE summary_embedding IS NOT NULL
             AND publish_date >= TIMESTAMP '2025-07-15 14:30:00' - INTERVAL 300 DAY"""
    ),
)
def _(spark, sf):
    emb = d.base(spark, sf, "embeddings").select("vec_id", "embedding")
    docs = d.stream(spark, sf, "documents").join(emb, F.col("vec_id") == F.col("doc_id"), "left")
    arts = d.articles_from(docs, F.col("embedding")).select("id", "publish_date", "summary_embedding")
    out, state = shared_folder(spark, "assignments"), shared_folder(spark, "cluster-state")
    run = cluster_stream(arts, out, state, lambda: d.ARTICLE_NOW, d.VECTOR_THRESHOLD, 300, DRAIN)
    run.awaitTermination()
    return spark.read.parquet(out).select("id", "story_cluster_id")


def _in_batches(rows, time: str, span: int, jitter: int, name: str, follow):
    """What ``follow`` makes of ``rows`` as a stream that is out of order: three spans of time, mixed by up to ``jitter`` seconds.

    They land one after the other, each a micro-batch of as many files as tasks wrote, its rows in no order.
    """
    spark = rows.sparkSession
    late = F.pmod(F.xxhash64(*rows.columns), F.lit(jitter))
    first = rows.agg(F.min(F.unix_seconds(time))).first()[0] or 0
    part = F.least(F.floor((F.unix_seconds(time) + late - first) / span), F.lit(2))
    folder, out, state = (shared_folder(spark, f"{name}{end}") for end in ("", "-out", "-state"))
    dealt = rows.withColumn("part", part).persist()
    for k in range(3):
        landing = dealt.filter(F.col("part") == k).drop("part").orderBy(F.xxhash64(*rows.columns))
        landing.write.mode("append").parquet(folder)
        stream = follow(spark.readStream.schema(rows.schema).parquet(folder))
        _drain_into(stream, out, state)
    dealt.unpersist()
    return spark.read.schema(stream.schema).parquet(out)


@query(
    "breaker_stream",
    f"""WITH replayed AS MATERIALIZED ({BREAKER_SQL})
        SELECT * FROM replayed WHERE ts < (SELECT max(ts) FROM replayed) - INTERVAL 10 HOUR""",
)
def _(spark, sf):
    squeezed = F.timestamp_micros(F.expr("unix_micros(created_at) div 10"))
    logs = d.fetch_logs(spark, sf).select(
        F.col("feed_url").alias("name"), squeezed.alias("ts"), F.col("id").alias("seq"), (F.col("status") == "success").alias("ok")
    )
    # Three days of squeezed time, in batches that overlap by up to eight hours.
    return _in_batches(logs, "ts", 86_400, 28_800, "attempts", lambda landed: breaker_stream(landed, delay="10 hours"))


ERROR_RULE = alerts.Rule("errors_in_a_day", "errors[1d]", "gt", 4.0, "warning", "many errors in a day")


@query(
    "alert_stream",
    """WITH s AS (SELECT feed_url, date_trunc('day', created_at) + INTERVAL 1 DAY AS tick, count(*)::DOUBLE AS value
         FROM fetch_logs WHERE status = 'error' GROUP BY 1, 2 HAVING date_trunc('day', created_at) + INTERVAL 1 DAY
           <= (SELECT max(created_at) FROM fetch_logs WHERE status = 'error') - INTERVAL 10 MINUTE),
       e AS (SELECT *, value > 4 AS firing, coalesce(lag(value > 4) OVER (PARTITION BY feed_url ORDER BY tick), false)
         AS was FROM s)
       SELECT 'errors_in_a_day' AS rule, feed_url AS series, CASE WHEN firing THEN 'firing' ELSE 'resolved' END
         AS status, tick, value FROM e WHERE firing <> was AND tick < (SELECT max(tick) FROM s) - INTERVAL 3 DAY""",
)
def _(spark, sf):
    errors = _fetch_stream(spark, sf).filter(~F.col("ok"))
    samples = windowed_counts(errors, ["feed_url"], "1 day").select(
        F.lit(ERROR_RULE.metric).alias("metric"),
        F.col("feed_url").alias("series"),
        F.col("window_end").alias("tick"),
        F.col("events").cast("double").alias("value"),
    )
    # The closed windows are a table of their own, which the alert stream follows, out of order.
    closed = spark.read.schema(samples.schema).parquet(_drain(samples, "samples"))
    return _in_batches(
        closed, "tick", 10 * 86_400, 2 * 86_400, "landed-samples", lambda landed: alert_stream(landed, [ERROR_RULE], delay="3 days")
    )


# -- roll-ups -------------------------------------------------------------


def _rollups(spark, sf) -> str:
    """Totals of all stage events, which arrive in four batches in no order of time; two are folded into a base."""
    events = stage_events(spark, sf)
    landing, path, state = (shared_folder(spark, n) for n in ("stage-events", "rollups", "rollup-state"))
    dealt = events.withColumn("part", F.pmod(F.xxhash64(*events.columns), F.lit(4))).persist()
    for k in range(4):
        # A batch is what has landed since the one before, in as many files as tasks wrote.
        dealt.filter(F.col("part") == k).drop("part").write.mode("append").parquet(landing)
        rollup_stream(spark.readStream.schema(events.schema).parquet(landing), path, state, DRAIN).awaitTermination()
    dealt.unpersist()
    compact(spark, path, 1)
    return path


@query("rollup_daily_ingestion", DAILY_SQL)
def _(spark, sf):
    return rollup_daily_ingestion(spark, _rollups(spark, sf), d.ARTICLE_NOW)


@query("rollup_latency_p95", P95_SQL)
def _(spark, sf):
    return rollup_p95(spark, _rollups(spark, sf), d.LOG_NOW, timedelta(days=1))


@query(
    "rollup_hours",
    f"""SELECT stage, date_trunc('hour', ts) AS slot, count(*) AS events, count(*) FILTER (WHERE ok) AS good,
          count(*) FILTER (WHERE seconds <= 1) AS within_second FROM ({EVENTS_SQL}) GROUP BY 1, 2""",
)
def _(spark, sf):
    hours = read_totals(spark, _rollups(spark, sf), "hour")
    second = F.sum(f"le_{BOUNDS.index(1.0)}").alias("within_second")
    return hours.groupBy("stage", "slot").agg(F.sum("events").alias("events"), F.sum("good").alias("good"), second)
