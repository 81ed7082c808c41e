"""Notifications: which articles to announce, the message, and the delivery log."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from storyloom.functions.text import SUMMARY_UNAVAILABLE, is_blank, truncate_words
from storyloom.functions.time import rfc3339
from storyloom.functions.urls import UNKNOWN_FEED, delivery_error_class, feed_excluded, feed_title, mask_webhook_url
from storyloom.operators.ledger import call_once
from storyloom.operators.ordering import SLICE_ROWS, number_rows
from storyloom.operators.skew import lookup_join

# Message format and limits.
TITLE_BYTES = 256
DESCRIPTION_BYTES = 300
MESSAGE_BYTES = 2_000
EMBED_COLOR = 0x5865F2
JSON_ESCAPES = {"&": "\\u0026", "<": "\\u003c", ">": "\\u003e", "\u2028": "\\u2028", "\u2029": "\\u2029"}
SENDER_NAME = "storyloom"


def _with_details(articles: DataFrame, now: datetime) -> DataFrame:
    """Feed title and date as announced; without feed or date: an unknown feed, now."""
    known = F.col("feed_url").isNotNull() & F.col("publish_date").isNotNull()
    return articles.withColumns(
        {
            "feed_title": F.when(known, feed_title(F.col("feed_url"))).otherwise(UNKNOWN_FEED),
            "feed_url": F.when(known, F.col("feed_url")).otherwise(""),
            "publish_date": F.when(known, F.col("publish_date")).otherwise(F.lit(now)),
        }
    )


def notify_eligible(
    articles: DataFrame, now: datetime, cutoff: datetime, excluded_feeds: Sequence[str] = ()
) -> DataFrame:
    """Summarized articles that were not posted yet, are recent enough and not from an excluded feed.

    Adds ``feed_title``; ``feed_url`` and ``publish_date`` become the announced ones.
    """
    posted = F.coalesce(F.col("posted_to_discord"), F.lit(False))
    return _with_details(articles, now).filter(
        F.col("summary").isNotNull()
        & (F.col("summary") != SUMMARY_UNAVAILABLE)
        & ~posted
        & ~feed_excluded(F.col("feed_url"), excluded_feeds)
        & (F.col("publish_date") >= F.lit(cutoff))
        & ~is_blank(F.col("title"))
        & ~is_blank(F.col("url"))
    )


def article_details(requests: DataFrame, articles: DataFrame, now: datetime) -> DataFrame:
    """Feed address, display title and date per requested url; unknown urls get stand-ins."""
    known = articles.select(F.col("url").alias("_url"), "feed_url", "publish_date").filter(
        F.col("feed_url").isNotNull() & F.col("publish_date").isNotNull()
    )
    hit = F.col("_url").isNotNull()
    return requests.join(known, requests["url"] == known["_url"], "left").select(
        *[requests[c] for c in requests.columns],
        F.coalesce("feed_url", F.lit("")).alias("feed_url"),
        F.when(hit, feed_title(F.col("feed_url"))).otherwise(UNKNOWN_FEED).alias("feed_title"),
        F.coalesce("publish_date", F.lit(now).cast("timestamp")).alias("publish_date"),
    )


def message_json(
    title: Column,
    url: Column,
    summary: Column,
    published: Column,
    feed: Column,
    sender: str = SENDER_NAME,
    avatar_url: str | None = None,
) -> Column:
    """The message body. Absent parts (author, avatar, empty description) are left out."""
    author = F.when(~is_blank(feed), F.struct(truncate_words(feed, TITLE_BYTES).alias("name")))
    embed = F.struct(
        truncate_words(title, TITLE_BYTES).alias("title"),
        F.nullif(truncate_words(summary, DESCRIPTION_BYTES), F.lit("")).alias("description"),
        url.alias("url"),
        F.lit(EMBED_COLOR).alias("color"),
        rfc3339(published).alias("timestamp"),
        F.struct(F.lit(sender).alias("text")).alias("footer"),
        author.alias("author"),
    )
    message = F.struct(
        F.lit(sender).alias("username"),
        F.lit(avatar_url).cast("string").alias("avatar_url"),
        F.array(embed).alias("embeds"),
    )
    body = F.to_json(message)
    for char, escape in JSON_ESCAPES.items():  # they occur inside strings only
        body = F.replace(body, F.lit(char), F.lit(escape))
    return body


def payload_size_ok(payload: Column) -> Column:
    return F.octet_length(payload) <= MESSAGE_BYTES


def notification_payloads(
    articles: DataFrame,
    webhooks: Sequence[str],
    now: datetime,
    cutoff: datetime,
    excluded_feeds: Sequence[str] = (),
    sender: str = SENDER_NAME,
) -> DataFrame:
    """One message per eligible article and webhook."""
    targets = [w for w in webhooks if w.strip()]
    rows = notify_eligible(articles, now, cutoff, excluded_feeds)
    parts = [F.col(c) for c in ("title", "url", "summary", "publish_date", "feed_title")]
    payload = message_json(*parts, sender)
    return (
        rows.select("id", F.col("url").alias("article_url"), payload.alias("payload"))
        .withColumn("size_ok", payload_size_ok(F.col("payload")))
        .withColumn("webhook_url", F.explode(F.array(*[F.lit(t) for t in targets]).cast("array<string>")))
        .select("id", "article_url", "webhook_url", "payload", "size_ok")
    )


def deliver(payloads: DataFrame, send: Callable[[str, str], int | None], attempts: int = 3) -> DataFrame:
    """Call ``send(webhook_url, payload)`` per message until it returns a 2xx code; log every attempt.

    ``send`` returns the response code, or None when the transport failed. Oversized messages
    are never sent. Delivery is at least once: a retried task sends again, and so does evaluating
    the result twice, so store it before use.
    """
    import pandas as pd

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                for attempt in range(1, attempts + 1):
                    code = send(r.webhook_url, r.payload) if r.size_ok else None
                    rows.append((r.id, r.article_url, r.webhook_url, attempt, code, bool(code and 200 <= code < 300)))
                    if rows[-1][-1]:
                        break
            out = pd.DataFrame(rows, columns=["id", "article_url", "webhook_url", "attempt", "response_code", "ok"])
            yield out.astype({"response_code": "Int64"})

    schema = "id long, article_url string, webhook_url string, attempt long, response_code long, ok boolean"
    return payloads.mapInPandas(run, schema)


def deliver_once(
    payloads: DataFrame, send: Callable[[str, str], int | None], ledger: str, attempts: int = 3, **options
) -> DataFrame:
    """``deliver`` with a ledger: a message is sent at most once for each attempt, however often this is evaluated.

    An attempt whose task went down during it is ``in_doubt``: it may have arrived, so it is not sent again and ends
    the attempts of its message. ``options`` are those of ``call_once``.
    """

    def attempt(message: Row, _: int) -> dict:
        return {"response_code": send(message.webhook_url, message.payload) if message.size_ok else None}

    def delivered(outcome: dict) -> bool:
        return bool(outcome["response_code"]) and 200 <= outcome["response_code"] < 300

    made = call_once(
        payloads, ledger, ["id", "webhook_url"], attempt, delivered, "response_code bigint", attempts, **options
    )
    ok = F.coalesce(F.col("response_code").between(200, 299), F.lit(False))
    columns = ["id", "article_url", "webhook_url", F.col("attempt").cast("long").alias("attempt"), "response_code"]
    return made.select(*columns, ok.alias("ok"), "in_doubt")


def posted_updates(attempts: DataFrame) -> DataFrame:
    """(id, posted_to_discord) of articles that reached at least one webhook, for a keyed update."""
    return attempts.groupBy("id").agg(F.bool_or("ok").alias("posted_to_discord")).filter("posted_to_discord")


def delivery_errors(attempts: DataFrame, max_attempts: int = 3) -> DataFrame:
    """Error-log rows of failed attempts, with the webhook token hidden.

    ``attempts``: webhook_url, article_url, attempt, response_code, error_message, duration_ms, created_at.
    """
    code = F.col("response_code")
    failed = attempts.filter(code.isNull() | ~code.between(200, 299))
    return failed.select(
        mask_webhook_url(F.col("webhook_url")).alias("webhook_url"),
        "article_url",
        F.coalesce("error_message", F.lit("")).alias("error_message"),
        F.coalesce(code, F.lit(0)).cast("int").alias("status_code"),
        F.col("attempt").cast("int").alias("retry_attempt"),
        F.col("duration_ms").cast("int").alias("duration_ms"),
        delivery_error_class(code).alias("error_class"),
        (F.col("attempt") >= max_attempts).alias("max_retries_exceeded"),
        "created_at",
    )


def resolve_log_urls(log_rows: DataFrame, articles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Delivery attempts keyed by url: (rows with article_id, rows whose url is unknown)."""
    ids = articles.select(F.col("id").alias("article_id"), "url")
    return log_rows.join(ids, "url"), log_rows.join(ids, "url", "left_anti")


def numbered_attempts(
    new_rows: DataFrame, webhook_logs: DataFrame, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Continue each article's attempt numbers over new rows, in (created_at, id) order."""
    order = [F.col("created_at").asc_nulls_last(), F.col("id").asc_nulls_last()]
    numbered = number_rows(new_rows, ["article_id"], order, out="_no", slice_rows=slice_rows)
    last = webhook_logs.groupBy("article_id").agg(F.max("attempt").alias("_last"))
    return (
        lookup_join(numbered, last, "article_id", ["id"])
        .withColumn("attempt", (F.col("_no") + F.coalesce("_last", F.lit(0))).cast("int"))
        .drop("_no", "_last")
    )


def append_webhook_logs(
    webhook_logs: DataFrame, new_rows: DataFrame, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """The log with the new attempts appended; rows bring their own ids."""
    rows = numbered_attempts(new_rows, webhook_logs, slice_rows)
    return webhook_logs.unionByName(rows.select(*webhook_logs.columns))
