"""Story clustering: leader clustering with the result of the sequential rule.

Sequential rule: walk the articles in order; join the most similar earlier seed at or above the
threshold, else become a seed. The seeds are the lexicographically first maximal independent set of
the graph of pairs at or above the threshold, which parallel rounds find exactly (Blelloch, Fineman,
Shun, SPAA 2012). The rounds run over growing prefixes of the order, so that the members of a dense
story are taken out by its first article instead of being compared with each other.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions.text import SUMMARY_FILTERED_OUT, SUMMARY_UNAVAILABLE
from storyloom.functions.time import CLUSTER_WINDOW_DAYS
from storyloom.operators.matching import BLOCK_ROWS, FIRST, earlier_matches, vector_frame
from storyloom.session import durable

# Clustering defaults.
SIMILARITY_THRESHOLD = 0.85
EMBED_BATCH_SIZE = 200

PREFIX_ROWS = BLOCK_ROWS


def pending_embedding(
    articles: DataFrame,
    now: datetime,
    window_days: int = CLUSTER_WINDOW_DAYS,
    batch: int | None = None,
    skip_filtered_out: bool = False,
) -> DataFrame:
    """Newest summarized articles of the window that have no vector yet."""
    summary = F.col("summary")
    keep = summary.isNotNull() & (summary != SUMMARY_UNAVAILABLE)
    if skip_filtered_out:
        keep = keep & (summary != SUMMARY_FILTERED_OUT)
    rows = articles.filter(
        (F.col("publish_date") >= F.lit(now - timedelta(days=window_days)))
        & F.col("summary_embedding").isNull()
        & keep
    ).select("id", "summary", "publish_date")
    if batch is None:
        return rows
    return rows.orderBy(F.col("publish_date").desc_nulls_first(), F.col("id").asc_nulls_last()).limit(batch)


def unclustered(articles: DataFrame, now: datetime, window_days: int = CLUSTER_WINDOW_DAYS) -> DataFrame:
    return articles.filter(
        (F.col("publish_date") >= F.lit(now - timedelta(days=window_days)))
        & F.col("story_cluster_id").isNull()
        & F.col("summary_embedding").isNotNull()
    ).select("id", "publish_date", "summary_embedding")


def seeds(articles: DataFrame, now: datetime, window_days: int = CLUSTER_WINDOW_DAYS) -> DataFrame:
    return articles.filter(
        (F.col("publish_date") >= F.lit(now - timedelta(days=window_days)))
        & (F.col("story_cluster_id") == F.col("id"))
    ).select("id", "publish_date", "summary_embedding")


def assign_to_seeds(
    items: DataFrame, known: DataFrame, threshold: float = SIMILARITY_THRESHOLD, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Best existing seed per item. Both sides are ``vector_frame`` rows; every seed counts as earlier."""
    matches = earlier_matches(items, known.withColumn("pos", F.lit(FIRST)), threshold, block_rows)
    return matches.select("id", F.col("match_id").alias("seed_id"), "similarity")


def _without(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids.select("id"), "id", "left_anti")


def _independent_seeds(group: DataFrame, threshold: float, block_rows: int) -> DataFrame:
    """Seeds of one prefix in which no row is near a seed found before."""
    undecided, found = group, None
    while True:
        blocked = durable(earlier_matches(undecided, undecided, threshold, block_rows))
        fresh = durable(_without(undecided, blocked))
        found = fresh if found is None else found.unionByName(fresh)
        rest = undecided.join(blocked.select("id"), "id", "left_semi")
        undecided = durable(_without(rest, earlier_matches(rest, fresh, threshold, block_rows)))
        if undecided.isEmpty():
            return found


def leader_seeds(
    items: DataFrame,
    threshold: float,
    block_rows: int = BLOCK_ROWS,
    prefix_rows: int = PREFIX_ROWS,
) -> DataFrame:
    """The items that become seeds, given that none is near an existing seed."""
    pending, found = items, None
    while True:
        n = pending.count()
        if n == 0:
            return found if found is not None else items.limit(0)
        whole = n <= prefix_rows
        if whole:
            head = pending
        else:
            # A position with roughly prefix_rows rows at or below it; ties stay together.
            cut = pending.agg(F.percentile_approx("pos", prefix_rows / n, 1_000_000)).first()[0]
            head = pending.filter(F.col("pos") <= cut)
        fresh = _independent_seeds(head, threshold, block_rows)
        found = fresh if found is None else found.unionByName(fresh)
        if whole:
            return found
        tail = pending.filter(F.col("pos") > cut)
        pending = durable(_without(tail, earlier_matches(tail, fresh, threshold, block_rows)))
        prefix_rows *= 2


def leader_cluster(
    items: DataFrame,
    threshold: float = SIMILARITY_THRESHOLD,
    known: DataFrame | None = None,
    block_rows: int = BLOCK_ROWS,
    prefix_rows: int = PREFIX_ROWS,
) -> DataFrame:
    """(id, story_cluster_id) for every item, in the order of ``pos`` then ``id``.

    ``known`` holds seeds of earlier runs. They precede all items and keep their ids.
    """
    items = durable(items)
    free = items
    if known is not None:
        known = durable(known.withColumn("pos", F.lit(FIRST)))
        free = durable(_without(items, earlier_matches(items, known, threshold, block_rows)))
    new_seeds = leader_seeds(free, threshold, block_rows, prefix_rows)
    all_seeds = new_seeds if known is None else new_seeds.unionByName(known)
    members = _without(items, new_seeds)
    joined = earlier_matches(members, all_seeds, threshold, block_rows).select(
        "id", F.col("match_id").alias("story_cluster_id")
    )
    return joined.unionByName(new_seeds.select("id", F.col("id").alias("story_cluster_id")))


def article_vectors(articles: DataFrame) -> DataFrame:
    """Articles as ``vector_frame`` rows in publishing order."""
    return vector_frame(articles, "id", "summary_embedding", F.unix_micros("publish_date"))


def cluster_cycle(
    articles: DataFrame,
    now: datetime,
    window_days: int = CLUSTER_WINDOW_DAYS,
    threshold: float = SIMILARITY_THRESHOLD,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Assignments for the unclustered articles of the window, next to the seeds already stored."""
    return leader_cluster(
        article_vectors(unclustered(articles, now, window_days)),
        threshold,
        article_vectors(seeds(articles, now, window_days)),
        block_rows,
    )


def story_groups(digest_rows: DataFrame) -> DataFrame:
    """One row per story of a digest; articles without a cluster stand alone."""
    alone = F.col("story_cluster_id").isNull()
    key = F.struct(
        F.coalesce("story_cluster_id", "id").alias("k"), alone.alias("alone")
    )
    newest = F.struct(F.col("publish_date"), (-F.col("id")).alias("neg"))
    return (
        digest_rows.groupBy(key.alias("story"))
        .agg(
            F.count(F.lit(1)).alias("n_articles"),
            F.countDistinct("feed_url").alias("n_feeds"),
            F.max("cross_feed_count").alias("cross_feed_count"),
            F.max("publish_date").alias("latest"),
            F.max_by("title", newest).alias("headline"),
            F.max_by("id", newest).alias("headline_id"),
        )
        .select(
            F.when(~F.col("story.alone"), F.col("story.k")).alias("story_cluster_id"),
            "headline_id",
            "headline",
            "n_articles",
            "n_feeds",
            "cross_feed_count",
            "latest",
        )
    )


def corroboration_lags(articles: DataFrame) -> DataFrame:
    """Per clustered story: seconds between the first article of the first and of the second feed."""
    firsts = (
        articles.filter(
            F.col("story_cluster_id").isNotNull() & F.col("feed_url").isNotNull() & F.col("publish_date").isNotNull()
        )
        .groupBy("story_cluster_id", "feed_url")
        .agg(F.min("publish_date").alias("first_seen"))
    )
    # At most one row per feed; only the top two of each task reach the shuffle.
    w = Window.partitionBy("story_cluster_id").orderBy(F.col("first_seen").asc_nulls_last(), "feed_url")
    top = firsts.withColumn("rn", F.row_number().over(w)).filter("rn <= 2")
    return (
        top.groupBy("story_cluster_id")
        .agg(F.min("first_seen").alias("first_seen"), F.max("first_seen").alias("second_seen"), F.count("rn").alias("n"))
        .filter("n = 2")
        .select("story_cluster_id", (F.unix_seconds("second_seen") - F.unix_seconds("first_seen")).alias("lag_seconds"))
    )


def corroboration_summary(articles: DataFrame) -> DataFrame:
    """How soon a second feed picks a story up: share within a day, median and upper quartile."""
    lags = corroboration_lags(articles).groupBy("lag_seconds").agg(F.count(F.lit(1)).alias("n"))
    # Lags are whole seconds within the stored period, which bounds the percentile's value map.
    return lags.agg(
        F.sum("n").alias("stories"),
        (F.sum(F.when(F.col("lag_seconds") <= 86_400, F.col("n")).otherwise(0)) / F.sum("n")).alias("within_day"),
        F.percentile("lag_seconds", F.lit(0.5), F.col("n")).alias("median_seconds"),
        F.percentile("lag_seconds", F.lit(0.75), F.col("n")).alias("p75_seconds"),
    )
