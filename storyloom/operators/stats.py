"""Feed, system, delivery and summarization statistics."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def feed_stats(articles: DataFrame) -> DataFrame:
    return (
        articles.filter(F.col("feed_url").isNotNull())
        .groupBy("feed_url")
        .agg(
            F.count(F.lit(1)).alias("article_count"),
            F.max("publish_date").alias("latest_article"),
            F.min("publish_date").alias("oldest_article"),
            F.avg("fetch_duration_ms").alias("avg_fetch_duration_ms"),
        )
        .orderBy(F.col("article_count").desc_nulls_first(), F.col("feed_url").asc_nulls_last())
    )


def system_stats(articles: DataFrame, fetch_logs: DataFrame, now: datetime) -> DataFrame:
    """Nine figures from one pass over each table."""

    def fetched_within(days: int) -> Column:
        return F.count_if(F.col("fetch_time") >= F.lit(now - timedelta(days=days)))

    recent = F.col("created_at") > F.lit(now - timedelta(days=1))
    ok = (F.col("status") == "success") & recent
    of_articles = articles.agg(
        F.count(F.lit(1)).alias("total_articles"),
        F.countDistinct("feed_url").alias("total_feeds"),
        fetched_within(1).alias("articles_today"),
        fetched_within(7).alias("articles_this_week"),
        fetched_within(30).alias("articles_this_month"),
    )
    of_fetches = fetch_logs.agg(
        F.max("created_at").alias("last_fetch"),
        F.count_if(ok).alias("successful_fetches_24h"),
        F.count_if((F.col("status") == "error") & recent).alias("failed_fetches_24h"),
        F.avg(F.when(ok, F.col("duration_ms"))).alias("avg_fetch_time_ms"),
    )
    # Two single rows with different columns; the maximum picks the one value of each.
    both = of_articles.unionByName(of_fetches, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def article_stats(articles: DataFrame) -> DataFrame:
    return articles.agg(
        F.count(F.lit(1)).alias("total_articles"),
        F.count_if(F.col("posted_to_discord")).alias("posted_to_discord"),
        F.count_if(~F.col("posted_to_discord")).alias("pending_discord"),
        F.countDistinct("feed_url").alias("unique_feeds"),
        F.min("publish_date").alias("earliest_article"),
        F.max("publish_date").alias("latest_article"),
    )


def article_count(articles: DataFrame) -> DataFrame:
    return articles.agg(F.count(F.lit(1)).alias("article_count"))


def webhook_stats(articles: DataFrame, webhook_logs: DataFrame) -> DataFrame:
    """Delivery attempts per feed. Logs are summed per article before they meet the articles."""
    ok = F.col("response_code").between(200, 299)
    per_article = webhook_logs.groupBy("article_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(ok).alias("n_ok"),
        F.sum("latency_ms").alias("latency"),
        F.count("latency_ms").alias("n_latency"),
        F.max("created_at").alias("last_attempt"),
    )
    joined = articles.select("id", "feed_url").join(per_article, F.col("id") == F.col("article_id"), "left")
    total, good = F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("n_ok"), F.lit(0))
    return joined.groupBy("feed_url").agg(
        total.alias("total_attempts"),
        good.alias("successful_attempts"),
        (total - good).alias("failed_attempts"),
        (F.sum("latency") / F.sum("n_latency")).alias("avg_latency_ms"),
        F.max("last_attempt").alias("last_attempt"),
    )


def summary_stats(summary_logs: DataFrame, now: datetime) -> DataFrame:
    recent = F.col("created_at") > F.lit(now - timedelta(days=1))
    ok = F.col("status") == "success"
    return summary_logs.agg(
        F.count_if(ok).alias("total_successful_summaries"),
        F.count_if((F.col("status") == "failed") & recent).alias("failed_summaries_24h"),
        F.avg(F.when(ok & recent, F.col("duration_ms"))).alias("avg_processing_time_ms_24h"),
    )


def recent_error(summary_logs: DataFrame) -> DataFrame:
    """Newest failure that carries a message; no row when there is none."""
    newest = F.struct("created_at", (-F.col("id")).alias("neg"))
    return (
        summary_logs.filter((F.col("status") == "failed") & F.col("error_message").isNotNull())
        .agg(F.max_by("error_message", newest).alias("message"), F.max("created_at").alias("time"))
        .filter(F.col("time").isNotNull())
    )


def next_attempts(webhook_logs: DataFrame) -> DataFrame:
    """Number of the next delivery attempt per article with earlier ones."""
    return webhook_logs.groupBy("article_id").agg((F.max("attempt") + 1).cast("long").alias("next_attempt"))


def breaker_health(states: DataFrame) -> DataFrame:
    """``states``: name, state. Any open breaker degrades the service."""
    is_open = F.col("state") == "open"
    return states.agg(
        F.count(F.lit(1)).alias("breakers"),
        F.count_if(is_open).alias("open_breakers"),
        F.when(F.coalesce(F.bool_or(is_open), F.lit(False)), "degraded").otherwise("healthy").alias("status"),
    )
