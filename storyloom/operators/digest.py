"""The digest: recent articles ranked by how many other feeds carry the same story."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.functions.time import CLUSTER_WINDOW_DAYS, digest_count_since, digest_since
from storyloom.operators.listing import LIST_COLUMNS, newest, view_rows
from storyloom.operators.skew import lookup_join

# Fixed value: other feeds that make a story important.
IMPORTANT_FEEDS = 2


def cross_feed_counts(articles: DataFrame, count_since: datetime) -> DataFrame:
    """Distinct feeds per story since ``count_since``."""
    return (
        articles.filter((F.col("publish_date") >= F.lit(count_since)) & F.col("story_cluster_id").isNotNull())
        .groupBy("story_cluster_id")
        .agg(F.countDistinct("feed_url").alias("distinct_feeds"))
    )


def importance(count: Column) -> Column:
    return F.when(count >= IMPORTANT_FEEDS, "important").otherwise("other")


def digest_rows(
    articles: DataFrame, range_name: str | None, now: datetime, cluster_days: int = CLUSTER_WINDOW_DAYS
) -> DataFrame:
    """Articles published within the range, with ``cross_feed_count``, unsorted and with NULLs kept."""
    since = digest_since(range_name, now)
    counts = cross_feed_counts(articles, digest_count_since(since, now, cluster_days))
    listed = articles.filter(
        (F.col("publish_date") >= F.lit(since)) & (F.col("publish_date") <= F.lit(now))
    ).select(*LIST_COLUMNS, "story_cluster_id")
    # Unclustered articles look up their own negative id, which matches no cluster.
    listed = listed.withColumn("_story", F.coalesce("story_cluster_id", -F.col("id")))
    counts = counts.withColumnRenamed("story_cluster_id", "_story")
    return (
        lookup_join(listed, counts, "_story", ["id"])
        .withColumn("cross_feed_count", F.coalesce(F.col("distinct_feeds") - 1, F.lit(0)).cast("long"))
        .drop("_story", "distinct_feeds")
    )


def digest(
    articles: DataFrame, range_name: str | None, now: datetime, cluster_days: int = CLUSTER_WINDOW_DAYS
) -> DataFrame:
    """Showable digest rows with their bucket, most covered first."""
    rows = view_rows(digest_rows(articles, range_name, now, cluster_days))
    return rows.withColumn("bucket", importance(F.col("cross_feed_count"))).orderBy(
        F.col("cross_feed_count").desc_nulls_first(), newest(), F.col("id").asc_nulls_last()
    )
