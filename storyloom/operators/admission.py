"""Which feed items enter the article table, and why the others do not."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions.html import extract_main_content
from storyloom.functions.text import MAX_ARTICLE_BYTES, content_hash, sanitize_utf8
from storyloom.operators.skew import lookup_join
from storyloom.sources.pages import latest_pages

# Admission outcomes, in the order they are tested.
NO_LINK = "skipped_no_link"
NO_DATE = "skipped_no_publish_date"
BEFORE_CUTOFF = "skipped_before_cutoff"
BEFORE_INITIATION = "skipped_before_initiation"
DUPLICATE = "skipped_duplicate"
PROCESSED = "processed"

SHIPPED_BYTES = 8 * 1024 * 1024

def within_dates(published: Column, cutoff: datetime, initiation: datetime) -> Column:
    """Both bounds are inclusive; a missing date is out."""
    return F.coalesce((published >= F.lit(cutoff)) & (published >= F.lit(initiation)), F.lit(False))


def date_cutoff(items: DataFrame, cutoff: datetime, initiation: datetime) -> DataFrame:
    return items.filter((F.col("published") >= F.lit(cutoff)) & (F.col("published") >= F.lit(initiation)))


def chronological(items: DataFrame) -> DataFrame:
    """Per feed oldest first, undated last, else document order."""
    return items.orderBy("feed_url", F.col("published").asc_nulls_last(), "item_no")


def _has_link(link: Column) -> Column:
    return F.coalesce(link, F.lit("")) != ""


def stored_link(link: Column) -> Column:
    """The url that an item is stored under, which is what makes it a duplicate."""
    return sanitize_utf8(link)


def _arrival() -> list[Column]:
    return [F.col("published").asc_nulls_last(), F.col("feed_url").asc_nulls_first(), F.col("item_no").asc_nulls_first()]


def first_per_url(items: DataFrame) -> DataFrame:
    """The earliest item of each link. Each task forwards one row per link, so hot links stay small."""
    w = Window.partitionBy("_stored").orderBy(*_arrival())
    ranked = items.withColumn("_stored", stored_link(F.col("link"))).withColumn("_rn", F.row_number().over(w))
    return ranked.filter("_rn = 1").drop("_rn", "_stored")


def dedup_anti(items: DataFrame, stored_urls: DataFrame) -> DataFrame:
    """First item per link among those whose link is not stored yet.

    Links are made unique first, so that the stored table meets one row per link.
    """
    first = first_per_url(items).withColumn("_stored", stored_link(F.col("link")))
    return first.join(stored_urls.select(F.col("url").alias("_stored")), "_stored", "left_anti").drop("_stored")


def linked_rows(items: DataFrame, table: DataFrame) -> DataFrame:
    """Rows of ``table`` (keyed by ``url``) that ``items`` link to: all that a small batch can meet.

    Links of at most ``SHIPPED_BYTES`` travel to the table, which is then scanned but not shuffled.
    """
    link = F.col("link")
    links = items.filter(_has_link(link)).select(F.explode(F.array(link, stored_link(link))).alias("url")).distinct()
    size = links.agg(F.sum(F.octet_length("url"))).first()[0] or 0
    if size <= SHIPPED_BYTES:
        links = F.broadcast(links)
    return table.join(links, "url", "left_semi")


def admission_status(items: DataFrame, stored_urls: DataFrame, cutoff: datetime, initiation: datetime) -> DataFrame:
    """Every item with its ``status``."""
    early = (
        F.when(~_has_link(F.col("link")), NO_LINK)
        .when(F.col("published").isNull(), NO_DATE)
        .when(F.col("published") < F.lit(cutoff), BEFORE_CUTOFF)
        .when(F.col("published") < F.lit(initiation), BEFORE_INITIATION)
    )
    judged = items.withColumn("_early", early)
    # Rows already rejected get a key of their own: they match nothing and cannot pile up on one link.
    own_key = F.concat_ws("\n", F.lit(""), "feed_url", "item_no")
    keyed = judged.withColumn("_key", F.when(F.col("_early").isNull(), stored_link(F.col("link"))).otherwise(own_key))
    passing = judged.filter(F.col("_early").isNull()).select("link", "published", "feed_url", "item_no")
    winners = dedup_anti(passing, stored_urls).select(
        stored_link(F.col("link")).alias("_key"), F.col("feed_url").alias("_win_feed"), F.col("item_no").alias("_win_no")
    )
    is_winner = F.col("_win_feed").eqNullSafe(F.col("feed_url")) & (F.col("_win_no") == F.col("item_no"))
    status = F.coalesce("_early", F.when(is_winner, PROCESSED).otherwise(DUPLICATE))
    return lookup_join(keyed, winners, "_key", ["feed_url", "item_no"]).select(
        *[F.col(c) for c in items.columns], status.alias("status")
    )


def admitted(items: DataFrame, cutoff: datetime, initiation: datetime) -> DataFrame:
    """Items that pass every test but the duplicate ones."""
    return date_cutoff(items.filter(_has_link(F.col("link"))), cutoff, initiation)


def with_page_text(items: DataFrame, pages: DataFrame, max_bytes: int | None = MAX_ARTICLE_BYTES) -> DataFrame:
    """Attach extracted page text as ``content``, cut at ``max_bytes``; the description stands in for a missing page.

    ``pages`` holds (url, html) of successful fetches; of several for one url the latest counts.
    """
    texts = latest_pages(pages).select(
        F.col("url").alias("link"), extract_main_content(F.col("html"), max_bytes).alias("_text")
    )
    return (
        items.join(texts, "link", "left")
        .withColumn("content", F.coalesce("_text", "description"))
        .drop("_text")
    )


def as_articles(items: DataFrame, now: datetime) -> DataFrame:
    """Admitted items (with ``content``) as article rows without id."""
    duration = F.col("fetch_duration_ms") if "fetch_duration_ms" in items.columns else F.lit(None)
    at = F.lit(now).cast("timestamp")
    return items.select(
        sanitize_utf8(F.col("title")).alias("title"),
        sanitize_utf8(F.col("link")).alias("url"),
        F.col("published").alias("publish_date"),
        F.lit(None).cast("string").alias("summary"),
        sanitize_utf8(F.col("content")).alias("full_content"),
        at.alias("fetch_time"),
        F.lit(False).alias("posted_to_discord"),
        at.alias("created_at"),
        at.alias("updated_at"),
        sanitize_utf8(F.col("feed_url")).alias("feed_url"),
        content_hash(F.col("title"), F.col("link"), F.col("content")).alias("content_hash"),
        duration.cast("int").alias("fetch_duration_ms"),
        F.lit(None).cast("array<float>").alias("summary_embedding"),
        F.lit(None).cast("long").alias("story_cluster_id"),
    )


#: What a fetch is known by: the feed, and the run where several are logged together.
FETCH_KEYS = ("run", "feed_url")


def feed_run_summary(statuses: DataFrame) -> DataFrame:
    """Items found and newly stored per feed, and per ``run`` if there is such a column."""
    keys = [c for c in FETCH_KEYS if c in statuses.columns]
    return statuses.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("articles_found"),
        F.count_if(F.col("status") == PROCESSED).alias("new_articles"),
    )


def fetch_log_rows(
    statuses: DataFrame, fetches: DataFrame, now: datetime
) -> DataFrame:
    """One fetch-log row per attempted feed and run.

    ``fetches`` holds (run, feed_url, status, message, duration_ms) per attempt; failed ones found nothing. An
    attempt gets what its own run found. Without ``run`` on both sides there must be one attempt a feed.
    """
    keys = [c for c in FETCH_KEYS if c in statuses.columns and c in fetches.columns]
    key = F.when(F.col("feed_url").isNotNull(), F.concat_ws("\n", *keys))
    runs = feed_run_summary(statuses).withColumn("_key", key).filter("_key IS NOT NULL")
    ok = F.col("status") == "success"
    spread_by = [c for c in fetches.columns if c != "feed_url"]
    counted = runs.select("_key", "articles_found", "new_articles")
    return lookup_join(fetches.withColumn("_key", key), counted, "_key", spread_by).select(
        *keys,
        "status",
        "message",
        F.col("duration_ms").cast("int").alias("duration_ms"),
        F.when(ok, F.coalesce("articles_found", F.lit(0))).otherwise(0).cast("int").alias("articles_found"),
        F.when(ok, F.coalesce("new_articles", F.lit(0))).otherwise(0).cast("int").alias("new_articles"),
        F.lit(now).cast("timestamp").alias("created_at"),
    )
