"""Listing, search, digest and statistics queries."""

from datetime import timedelta
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions.time import (
    RANGE_DAYS,
    digest_count_since_column,
    digest_since_column,
)
from storyloom.operators import cluster, digest, listing, metrics, search_index, stats, tables
from storyloom.operators.skew import lookup_join
from storyloom.plans import derived as d
from storyloom.plans.registry import query
from storyloom.session import shared_folder
from storyloom.sources.pages import url_scan

A = "TIMESTAMP '2025-07-15 14:30:00'"
L = "TIMESTAMP '2024-01-31 00:00:00'"
VIEW = "id, title, url, summary, full_content, publish_date, feed_url, content_hash"
NANOS = "CAST(fetch_duration_ms AS BIGINT) * 1000000 AS fetch_duration"
SHOWABLE = (
    "full_content IS NOT NULL AND publish_date IS NOT NULL AND fetch_duration_ms IS NOT NULL "
    "AND feed_url IS NOT NULL AND content_hash IS NOT NULL"
)
FEED = "https://src3.example.com/feed"


def _digest_sql(days: int, cluster_days: int = 35) -> str:
    return f"""
        SELECT {VIEW}, {NANOS}, story_cluster_id, cross_feed_count,
          CASE WHEN cross_feed_count >= 2 THEN 'important' ELSE 'other' END AS bucket
        FROM (SELECT a.*, CAST(coalesce(c.n - 1, 0) AS BIGINT) AS cross_feed_count FROM articles a
          LEFT JOIN (SELECT story_cluster_id AS k, count(DISTINCT feed_url) AS n FROM articles
            WHERE publish_date >= {A} - INTERVAL {max(days, cluster_days)} DAY AND story_cluster_id IS NOT NULL
            GROUP BY 1) c ON c.k = a.story_cluster_id
          WHERE publish_date >= {A} - INTERVAL {days} DAY AND publish_date <= {A})
        WHERE {SHOWABLE} ORDER BY cross_feed_count DESC, publish_date DESC NULLS FIRST, id"""


def _register_digest(name: str, range_name: str) -> None:
    @query(name, _digest_sql(RANGE_DAYS[range_name]))
    def _(spark, sf):
        return digest.digest(d.articles(spark, sf), range_name, d.ARTICLE_NOW)


_register_digest("digest", "monthly")
for _range in ("daily", "weekly", "quarterly", "halfyearly", "yearly"):
    _register_digest(f"digest_{_range}", _range)


@query(
    "cross_feed_count",
    f"""SELECT story_cluster_id, count(DISTINCT feed_url) - 1 AS cross_feed_count FROM articles
        WHERE publish_date >= {A} - INTERVAL 35 DAY AND story_cluster_id IS NOT NULL GROUP BY 1""",
)
def _(spark, sf):
    counts = digest.cross_feed_counts(d.articles(spark, sf), d.ARTICLE_NOW - timedelta(days=35))
    return counts.select("story_cluster_id", (F.col("distinct_feeds") - 1).alias("cross_feed_count"))


@query(
    "digest_order",
    f"""SELECT id, cross_feed_count, rank() OVER (ORDER BY cross_feed_count DESC) AS coverage_rank
        FROM ({_digest_sql(365)})""",
)
def _(spark, sf):
    ranked = digest.digest(d.articles(spark, sf), "yearly", d.ARTICLE_NOW).select("id", "cross_feed_count")
    # Coverage takes few values, so ranks come from a count per value, not from one sorted task.
    above = Window.orderBy(F.col("cross_feed_count").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    ranks = (
        ranked.groupBy("cross_feed_count")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("cross_feed_count", (F.coalesce(F.sum("n").over(above), F.lit(0)) + 1).alias("coverage_rank"))
    )
    return lookup_join(ranked, ranks, "cross_feed_count", ["id"]).select("id", "cross_feed_count", "coverage_rank")


@query(
    "important_split",
    f"SELECT bucket, count(*) AS n, sum(cross_feed_count)::BIGINT AS coverage FROM ({_digest_sql(90)}) GROUP BY 1",
)
def _(spark, sf):
    rows = digest.digest_rows(d.articles(spark, sf), "quarterly", d.ARTICLE_NOW)
    bucket = digest.importance(F.col("cross_feed_count")).alias("bucket")
    return (
        listing.view_rows(rows)
        .groupBy(bucket)
        .agg(F.count(F.lit(1)).alias("n"), F.sum("cross_feed_count").alias("coverage"))
    )


@query("upcoming_split", f"SELECT id, url, publish_date FROM articles WHERE publish_date > {A}")
def _(spark, sf):
    return listing.upcoming(d.articles(spark, sf), d.ARTICLE_NOW).select("id", "url", "publish_date")


@query(
    "digest_since",
    f"""SELECT id, CASE id % 8 WHEN 0 THEN 'daily' WHEN 1 THEN 'weekly' WHEN 2 THEN 'monthly' WHEN 3 THEN 'quarterly'
          WHEN 4 THEN 'halfyearly' WHEN 5 THEN 'yearly' WHEN 6 THEN 'garbage' ELSE '' END AS range_name,
          publish_date - to_days(CASE id % 8 WHEN 1 THEN 7 WHEN 2 THEN 30 WHEN 3 THEN 90 WHEN 4 THEN 182
            WHEN 5 THEN 365 ELSE 1 END) AS since FROM articles""",
)
def _(spark, sf):
    names = [*RANGE_DAYS, "garbage", ""]
    name = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("id") % 8 + 1).cast("int"))
    return d.articles(spark, sf).select(
        "id", name.alias("range_name"), digest_since_column(name, F.col("publish_date")).alias("since")
    )


@query(
    "digest_count_since",
    f"""SELECT id, CASE WHEN id % 60 > 0 THEN least(publish_date, {A} - to_days(CAST(id % 60 AS INTEGER)))
          ELSE publish_date END AS count_since FROM articles WHERE publish_date IS NOT NULL""",
)
def _(spark, sf):
    rows = d.articles(spark, sf).filter(F.col("publish_date").isNotNull())
    since = digest_count_since_column(
        F.col("publish_date"), F.lit(d.ARTICLE_NOW), (F.col("id") % 60).cast("int")
    )
    return rows.select("id", since.alias("count_since"))


@query("url_scan", "SELECT url FROM articles")
def _(spark, sf):
    return url_scan(d.articles(spark, sf))


@query(
    "article_list",
    f"""SELECT {VIEW}, {NANOS} FROM (SELECT * FROM articles WHERE feed_url = '{FEED}'
          AND (title ILIKE '%tion%' OR summary ILIKE '%tion%' OR full_content ILIKE '%tion%')
          ORDER BY publish_date DESC NULLS FIRST, id LIMIT 20 OFFSET 5) WHERE {SHOWABLE}""",
)
def _(spark, sf):
    return listing.article_list(d.articles(spark, sf), feed=FEED, q=" tion ", limit=20, offset=5)


@query(
    "newest",
    f"""SELECT {VIEW}, {NANOS} FROM (SELECT * FROM articles
        ORDER BY publish_date DESC NULLS FIRST, id LIMIT 50) WHERE {SHOWABLE}""",
)
def _(spark, sf):
    return listing.article_list(d.articles(spark, sf), sort="1; DROP TABLE articles", limit="0")


@query(
    "oldest",
    f"""SELECT {VIEW}, {NANOS} FROM (SELECT * FROM articles
        ORDER BY publish_date ASC NULLS LAST, id LIMIT 50) WHERE {SHOWABLE}""",
)
def _(spark, sf):
    return listing.article_list(d.articles(spark, sf), q="a", sort="oldest")


@query(
    "article_search",
    """SELECT id, url FROM articles
       WHERE title ILIKE '%ouer%' OR summary ILIKE '%ouer%' OR full_content ILIKE '%ouer%'""",
)
def _(spark, sf):
    return listing.search(d.articles(spark, sf), "OUER").select("id", "url")


# Terms with wildcards, an escaped one, letters in other case, too few letters for a trigram, and no match.
SEARCH_TERMS = ("OUER", "th%st", "an_h", "É, q", "li", "1\\%", "in the % of", "zzqxj")


@query(
    "article_search_index",
    " UNION ALL ".join(
        f"""SELECT '{t}' AS term, id, url FROM articles WHERE title ILIKE '%{t}%' ESCAPE '\'
            OR summary ILIKE '%{t}%' ESCAPE '\' OR full_content ILIKE '%{t}%' ESCAPE '\'"""
        for t in SEARCH_TERMS
    ),
)
def _(spark, sf):
    arts = d.articles(spark, sf)
    path = shared_folder(spark, "search-index")
    search_index.write_index(arts, path, range_ids=1024)
    found = [
        search_index.indexed_search(spark, path, arts.schema, t, range_ids=1024).select(F.lit(t).alias("term"), "id", "url")
        for t in SEARCH_TERMS
    ]
    return reduce(DataFrame.unionByName, found)


@query(
    "url_pattern_index",
    """SELECT 'SRC1.EXAMPLE' AS pattern, id, url FROM articles WHERE url ILIKE '%SRC1.EXAMPLE%'
       UNION ALL SELECT '/a/_7%9', id, url FROM articles WHERE url ILIKE '%/a/_7%9%'""",
)
def _(spark, sf):
    arts = d.articles(spark, sf).select("id", "url")
    path = shared_folder(spark, "url-index")
    search_index.write_index(arts, path, columns=["url"])
    found = [
        search_index.indexed_url_match(spark, path, arts.schema, p).select(F.lit(p).alias("pattern"), "id", "url")
        for p in ("SRC1.EXAMPLE", "/a/_7%9")
    ]
    return reduce(DataFrame.unionByName, found)


@query("article_by_id", f"SELECT {VIEW}, {NANOS} FROM articles WHERE id = 42 AND {SHOWABLE}")
def _(spark, sf):
    return listing.article_by_id(d.articles(spark, sf), "42")


@query("article_by_url", "SELECT id, title, url, publish_date FROM articles WHERE url = 'https://src7.example.com/a/7'")
def _(spark, sf):
    rows = listing.article_by_url(d.articles(spark, sf), "https://src7.example.com/a/7")
    return rows.select("id", "title", "url", "publish_date")


@query(
    "articles_by_posted",
    """SELECT id, url, fetch_time FROM articles WHERE posted_to_discord
       ORDER BY fetch_time DESC NULLS FIRST, id LIMIT 30 OFFSET 10""",
)
def _(spark, sf):
    return listing.by_posted_status(d.articles(spark, sf), True, 30, 10).select("id", "url", "fetch_time")


@query("url_pattern_match", "SELECT id, url FROM articles WHERE url ILIKE '%' || 'SRC1.EXAMPLE' || '%' ORDER BY id")
def _(spark, sf):
    return listing.url_pattern_match(d.articles(spark, sf), "SRC1.EXAMPLE")


@query(
    "latest_fetched",
    f"""SELECT id, title, url, full_content, publish_date, feed_url, content_hash, fetch_time, {NANOS}
        FROM (SELECT * FROM articles ORDER BY fetch_time DESC NULLS FIRST, id LIMIT 20) WHERE {SHOWABLE}""",
)
def _(spark, sf):
    return listing.latest_fetched(d.articles(spark, sf))


@query(
    "webhook_logs_by_article",
    """SELECT id, article_id, attempt, response_code, latency_ms, error_message, created_at
       FROM webhook_logs WHERE article_id = 17 ORDER BY attempt DESC""",
)
def _(spark, sf):
    rows = listing.logs_of_article(d.webhook_logs(spark, sf), 17)
    return rows.select("id", "article_id", "attempt", "response_code", "latency_ms", "error_message", "created_at")


@query(
    "summary_status_filter",
    f"""SELECT 'fetch' AS log, id, status, created_at FROM fetch_logs
          WHERE status = 'error' AND created_at > {L} - INTERVAL 24 HOUR
        UNION ALL SELECT 'summary', id, status, created_at FROM summary_logs
          WHERE status = 'failed' AND created_at > {L} - INTERVAL 24 HOUR""",
)
def _(spark, sf):
    cols = ["id", "status", "created_at"]
    fetch = listing.recent_logs(d.fetch_logs(spark, sf), "error", d.LOG_NOW)
    summary = listing.recent_logs(d.summary_logs(spark, sf), "failed", d.LOG_NOW)
    return fetch.select(F.lit("fetch").alias("log"), *cols).unionByName(
        summary.select(F.lit("summary").alias("log"), *cols)
    )


FEED_STATS = """SELECT feed_url, count(*) AS article_count, max(publish_date) AS latest_article,
    min(publish_date) AS oldest_article, avg(fetch_duration_ms) AS avg_fetch_duration_ms
    FROM articles WHERE feed_url IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1"""


@query("feed_stats", FEED_STATS)
def _(spark, sf):
    return stats.feed_stats(d.articles(spark, sf))


@query("feeds_by_count", f"SELECT feed_url, article_count FROM ({FEED_STATS})")
def _(spark, sf):
    return stats.feed_stats(d.articles(spark, sf)).select("feed_url", "article_count")


@query(
    "system_stats",
    f"""SELECT * FROM (SELECT count(*) AS total_articles, count(DISTINCT feed_url) AS total_feeds,
          count(*) FILTER (WHERE fetch_time >= {A} - INTERVAL 1 DAY) AS articles_today,
          count(*) FILTER (WHERE fetch_time >= {A} - INTERVAL 7 DAY) AS articles_this_week,
          count(*) FILTER (WHERE fetch_time >= {A} - INTERVAL 30 DAY) AS articles_this_month FROM articles),
        (SELECT max(created_at) AS last_fetch,
          count(*) FILTER (WHERE status = 'success' AND created_at > {A} - INTERVAL 24 HOUR) AS successful_fetches_24h,
          count(*) FILTER (WHERE status = 'error' AND created_at > {A} - INTERVAL 24 HOUR) AS failed_fetches_24h,
          avg(duration_ms) FILTER (WHERE status = 'success' AND created_at > {A} - INTERVAL 24 HOUR)
            AS avg_fetch_time_ms
          FROM (SELECT status, duration_ms, created_at + ({A} - {L}) AS created_at FROM fetch_logs))""",
)
def _(spark, sf):
    shift = int((d.ARTICLE_NOW - d.LOG_NOW).total_seconds())
    logs = d.fetch_logs(spark, sf)
    logs = logs.withColumn("created_at", F.timestamp_micros(F.unix_micros("created_at") + shift * 1_000_000))
    return stats.system_stats(d.articles(spark, sf), logs, d.ARTICLE_NOW)


@query(
    "article_stats",
    """SELECT count(*) AS total_articles, count(*) FILTER (WHERE posted_to_discord) AS posted_to_discord,
         count(*) FILTER (WHERE NOT posted_to_discord) AS pending_discord, count(DISTINCT feed_url) AS unique_feeds,
         min(publish_date) AS earliest_article, max(publish_date) AS latest_article FROM articles""",
)
def _(spark, sf):
    return stats.article_stats(d.articles(spark, sf))


@query("article_count", "SELECT count(*) AS article_count FROM articles")
def _(spark, sf):
    return stats.article_count(d.articles(spark, sf))


@query(
    "webhook_stats",
    """SELECT a.feed_url, count(w.id) AS total_attempts,
         count(w.id) FILTER (WHERE w.response_code BETWEEN 200 AND 299) AS successful_attempts,
         count(w.id) FILTER (WHERE w.response_code NOT BETWEEN 200 AND 299 OR w.response_code IS NULL)
           AS failed_attempts,
         avg(w.latency_ms) AS avg_latency_ms, max(w.created_at) AS last_attempt
       FROM articles a LEFT JOIN webhook_logs w ON a.id = w.article_id GROUP BY a.feed_url""",
)
def _(spark, sf):
    return stats.webhook_stats(d.articles(spark, sf), d.webhook_logs(spark, sf))


@query(
    "summary_stats",
    f"""SELECT count(*) FILTER (WHERE status = 'success') AS total_successful_summaries,
          count(*) FILTER (WHERE status = 'failed' AND created_at > {L} - INTERVAL 24 HOUR) AS failed_summaries_24h,
          avg(duration_ms) FILTER (WHERE status = 'success' AND created_at > {L} - INTERVAL 24 HOUR)
            AS avg_processing_time_ms_24h FROM summary_logs""",
)
def _(spark, sf):
    return stats.summary_stats(d.summary_logs(spark, sf), d.LOG_NOW)


@query(
    "recent_error",
    """SELECT error_message AS message, created_at AS time FROM summary_logs
       WHERE status = 'failed' AND error_message IS NOT NULL ORDER BY created_at DESC, id LIMIT 1""",
)
def _(spark, sf):
    return stats.recent_error(d.summary_logs(spark, sf))


@query(
    "max_attempt",
    "SELECT article_id, CAST(coalesce(max(attempt), 0) + 1 AS BIGINT) AS next_attempt FROM webhook_logs GROUP BY 1",
)
def _(spark, sf):
    return stats.next_attempts(d.webhook_logs(spark, sf))


@query(
    "unique_violations",
    """SELECT 'url' AS key, link AS value, count(*) AS n, min(item_no) AS first_id FROM items
         WHERE link IS NOT NULL GROUP BY link HAVING count(*) > 1
       UNION ALL SELECT 'content_hash', h, count(*), min(item_no) FROM
         (SELECT sha256(title || link || description) AS h, item_no FROM items) WHERE h IS NOT NULL
         GROUP BY h HAVING count(*) > 1""",
)
def _(spark, sf):
    text = F.concat("title", "link", "description")  # NULL without a link
    rows = d.items(spark, sf).select(
        F.col("item_no").alias("id"), F.col("link").alias("url"), F.sha2(text, 256).alias("content_hash")
    )
    return tables.unique_violations(rows, "url").unionByName(tables.unique_violations(rows, "content_hash"))


@query(
    "top_feeds_by_errors",
    """SELECT feed_url, error_type, count(*) AS errors FROM failed_fetches
       GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 10""",
)
def _(spark, sf):
    return metrics.top_feeds_by_errors(d.fetch_logs(spark, sf), 10)


@query(
    "story_group",
    f"""SELECT story_cluster_id, arg_max(id, (publish_date, -id)) AS headline_id,
          arg_max(title, (publish_date, -id)) AS headline, count(*) AS n_articles,
          count(DISTINCT feed_url) AS n_feeds, max(cross_feed_count) AS cross_feed_count, max(publish_date) AS latest
        FROM ({_digest_sql(365)}) GROUP BY coalesce(story_cluster_id, -id), story_cluster_id""",
)
def _(spark, sf):
    rows = listing.view_rows(digest.digest_rows(d.articles(spark, sf), "yearly", d.ARTICLE_NOW))
    return cluster.story_groups(rows)


@query(
    "corroboration_lag",
    """WITH firsts AS (SELECT story_cluster_id AS k, feed_url, min(publish_date) AS f FROM articles
         WHERE story_cluster_id IS NOT NULL AND feed_url IS NOT NULL AND publish_date IS NOT NULL GROUP BY 1, 2),
       r AS (SELECT k, f, row_number() OVER (PARTITION BY k ORDER BY f, feed_url) AS rn FROM firsts),
       lags AS (SELECT k, date_diff('second', min(f), max(f)) AS s FROM r WHERE rn <= 2 GROUP BY k HAVING count(*) = 2)
       SELECT count(*) AS stories, count(*) FILTER (WHERE s <= 86400) / count(*) AS within_day,
         quantile_cont(s, 0.5) AS median_seconds, quantile_cont(s, 0.75) AS p75_seconds FROM lags""",
)
def _(spark, sf):
    return cluster.corroboration_summary(d.articles(spark, sf))
