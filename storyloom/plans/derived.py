"""News tables derived from the given base tables, in Spark and in SQL.

Every derived table covers all rows of its base table. Modulo expressions below choose column
values (which rows have a NULL date, which feed an event belongs to), never which rows are read.
"""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ARTICLE_NOW = datetime(2025, 7, 15, 14, 30, tzinfo=timezone.utc)
LOG_NOW = datetime(2024, 1, 31, tzinfo=timezone.utc)
CUTOFF = ARTICLE_NOW - timedelta(days=100)
INITIATION = ARTICLE_NOW - timedelta(days=200)
STORED_BEFORE = ARTICLE_NOW - timedelta(days=22)
VECTOR_THRESHOLD = 0.35

_A = int(ARTICLE_NOW.timestamp())
FETCH_ERRORS = (
    "HTTP 403", "HTTP 429", "HTTP 500", "HTTP 503", "HTTP 520", "Circuit breaker is open",
    "Failed to create request: bad url", "Failed to fetch feed: timeout", "Failed to parse feed: EOF",
    "FlareSolverr: solved with HTTP 403", "something else",
)
WEBHOOKS = (
    "https://chat.example.com/api/webhooks/1001/token-a",
    "https://chat.example.com/api/webhooks/1002/token-b",
)


def stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """The same table as a file stream."""
    schema = spark.read.parquet(f"{sf}/{name}.parquet").schema
    df = spark.readStream.schema(schema).parquet(f"{sf}/{name}*.parquet")
    return df.withColumn("ts", F.col("ts").cast("timestamp")) if name == "events" else df


def base(spark: SparkSession, sf: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    if name == "events":
        df = df.withColumn("ts", F.col("ts").cast("timestamp"))
    return df


def _mod(c: str, n: int) -> Column:
    return F.col(c) % n


def _before_a(seconds: Column) -> Column:
    return F.timestamp_seconds(F.lit(_A) - seconds)


def articles(spark: SparkSession, sf: str, vectors: bool = False) -> DataFrame:
    docs = base(spark, sf, "documents")
    if not vectors:
        return articles_from(docs)
    emb = base(spark, sf, "embeddings").select("vec_id", "embedding")
    return articles_from(docs.join(emb, F.col("vec_id") == F.col("doc_id"), "left"), F.col("embedding"))


def articles_from(docs: DataFrame, embedding: Column | None = None) -> DataFrame:
    embedding = F.lit(None).cast("array<float>") if embedding is None else embedding
    r = (F.col("doc_id") * 37) % 101
    url = F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/a/"), F.col("doc_id").cast("string"))
    title = F.substring_index("text", "\n", 1)
    fetched = _before_a(60 * ((F.col("doc_id") * 104729) % 64800))
    summary = (
        F.when(_mod("doc_id", 11) == 0, None)
        .when(_mod("doc_id", 13) == 0, "summary unavailable")
        .otherwise(F.replace("text", F.lit("\n"), F.lit(" ")))
    )
    return docs.select(
        (F.col("doc_id") + 1).alias("id"),
        title.alias("title"),
        url.alias("url"),
        F.when(_mod("doc_id", 53) != 0, _before_a(3600 * (F.floor(r * r * 9 / 10) - 48))).alias("publish_date"),
        summary.alias("summary"),
        F.col("text").alias("full_content"),
        fetched.alias("fetch_time"),
        (_mod("doc_id", 3) == 0).alias("posted_to_discord"),
        fetched.alias("created_at"),
        fetched.alias("updated_at"),
        F.when(
            _mod("doc_id", 97) != 0, F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/feed"))
        ).alias("feed_url"),
        F.sha2(F.concat(title, url, F.col("text")), 256).alias("content_hash"),
        F.when(_mod("doc_id", 89) != 0, (F.col("doc_id") * 131) % 5000).cast("int").alias("fetch_duration_ms"),
        embedding.alias("summary_embedding"),
        F.when(_mod("doc_id", 7) != 0, _mod("doc_id", 97) + 1).alias("story_cluster_id"),
    )


def stored_articles(spark: SparkSession, sf: str, vectors: bool = False) -> DataFrame:
    """The table as it stood some weeks before ``ARTICLE_NOW``."""
    return articles(spark, sf, vectors).filter(F.col("fetch_time") < F.lit(STORED_BEFORE))


def items(spark: SparkSession, sf: str) -> DataFrame:
    """Every article as a feed item, and once more an hour later from a mirroring feed."""
    return items_from(articles(spark, sf))


def items_from(arts: DataFrame) -> DataFrame:
    doc = F.col("id") - 1
    link = F.when(doc % 41 != 0, F.col("url"))
    text = [F.col("title"), F.col("publish_date").alias("published"), F.col("full_content").alias("description")]
    own = arts.select(F.col("feed_url"), doc.alias("item_no"), link.alias("link"), *text)
    mirror = F.concat(F.lit("https://mirror"), (F.col("item_no") % 7).cast("string"), F.lit(".example.com/feed"))
    later = own.select(
        mirror.alias("feed_url"),
        "item_no",
        "link",
        "title",
        (F.col("published") + F.expr("INTERVAL 1 HOUR")).alias("published"),
        "description",
    )
    return own.unionByName(later)


def _tenths(c: str) -> Column:
    return F.floor(F.col(c) * 10).cast("int")


def fetch_logs(spark: SparkSession, sf: str) -> DataFrame:
    return fetch_logs_from(base(spark, sf, "events"))


def fetch_logs_from(ev: DataFrame) -> DataFrame:
    bad = F.col("event_type") == "error"
    message = F.element_at(F.array(*[F.lit(m) for m in FETCH_ERRORS]), (_mod("event_id", 11) + 1).cast("int"))
    found = _mod("event_id", 30)
    return ev.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("https://src"), _mod("user_id", 20).cast("string"), F.lit(".example.com/feed")).alias("feed_url"),
        F.when(bad, "error").otherwise("success").alias("status"),
        F.when(bad, message).otherwise("").alias("message"),
        _tenths("value").alias("duration_ms"),
        F.when(bad, 0).otherwise(found).cast("int").alias("articles_found"),
        F.when(bad, 0).otherwise(F.floor(found / 4)).cast("int").alias("new_articles"),
        F.col("ts").alias("created_at"),
    )


def webhook_logs(spark: SparkSession, sf: str) -> DataFrame:
    """Eight delivery attempts per article; the last ids have no article."""
    code = (
        F.when(F.col("event_type") == "signup", 500)
        .when(F.col("event_type") == "view", 404)
        .when(F.col("event_type") == "click", 204)
        .when(F.col("event_type") == "purchase", 200)
    )
    return base(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        (F.expr("event_id div 8") + 1).alias("article_id"),
        (_mod("event_id", 8) + 1).cast("int").alias("attempt"),
        code.cast("int").alias("response_code"),
        F.lit(None).cast("string").alias("response_body"),
        _tenths("value").alias("latency_ms"),
        F.when(F.col("event_type") == "error", "timeout").alias("error_message"),
        F.col("ts").alias("created_at"),
    )


def summary_logs(spark: SparkSession, sf: str) -> DataFrame:
    doc = F.expr("event_id div 10")
    kind = F.col("event_type")
    ok = kind.isin("click", "view", "purchase")
    url = F.concat(
        F.lit("https://src"), (doc % 20).cast("string"), F.lit(".example.com/a/"), doc.cast("string")
    )
    return base(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        url.alias("article_url"),
        F.concat(F.lit("m"), _mod("user_id", 3).cast("string")).alias("model"),
        F.when(ok, "success").when(kind == "signup", "retry_failed").otherwise("failed").alias("status"),
        F.when(ok, "a summary").otherwise("summary unavailable").alias("summary"),
        F.when(ok, "").otherwise(F.concat(F.lit("E"), _mod("event_id", 7).cast("string"))).alias("error_message"),
        F.floor(F.col("value") * 100).cast("int").alias("duration_ms"),
        (_mod("event_id", 3) + 1).cast("int").alias("retry_attempt"),
        F.col("ts").alias("created_at"),
    )


def save_logs(spark: SparkSession, sf: str) -> DataFrame:
    return articles(spark, sf).select(
        F.col("created_at"),
        "feed_url",
        F.when((F.col("id") - 1) % 29 == 0, "save_failed").otherwise("processed").alias("status"),
    )


def tagged_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Model answers: whole document texts with reasoning blocks around parts of them."""
    text = F.col("text")
    block = F.concat(F.lit("<think>"), F.substring("text", 1, 40), F.lit("</think> "), F.expr("substring(text, 41)"))
    answer = (
        F.when(_mod("doc_id", 17) == 0, F.concat(F.lit("<analysis>"), text, F.lit("</analysis>")))
        .when(_mod("doc_id", 3) == 0, block)
        .when(_mod("doc_id", 3) == 1, F.concat(F.lit("<THINKING >"), text))
        .otherwise(text)
    )
    return base(spark, sf, "documents").select("doc_id", answer.alias("answer"))


def page_fetches(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(_mod("page_id", 10) == 9, 404).otherwise(200)
    return base(spark, sf, "pages").select("page_id", "url", "html", status.alias("status"))


def page_articles(spark: SparkSession, sf: str) -> DataFrame:
    """One stored article per page, plus its page's raw markup as stale content."""
    p = base(spark, sf, "pages")
    return p.select(
        (F.col("page_id") + 1).alias("id"),
        "url",
        F.col("html").alias("full_content"),
        F.lit("old summary").alias("summary"),
        F.lit(ARTICLE_NOW - timedelta(days=1)).cast("timestamp").alias("updated_at"),
    )


SQL = {
    "articles": """
        SELECT doc_id + 1 AS id, split_part(text, chr(10), 1) AS title,
          'https://' || source || '.example.com/a/' || doc_id AS url,
          CASE WHEN doc_id % 53 <> 0 THEN TIMESTAMP '2025-07-15 14:30:00'
            - to_hours(CAST(((doc_id*37)%101) * ((doc_id*37)%101) * 9 // 10 - 48 AS BIGINT)) END AS publish_date,
          CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 13 = 0 THEN 'summary unavailable'
            ELSE replace(text, chr(10), ' ') END AS summary,
          text AS full_content,
          TIMESTAMP '2025-07-15 14:30:00' - to_minutes(CAST((doc_id*104729) % 64800 AS BIGINT)) AS fetch_time,
          doc_id % 3 = 0 AS posted_to_discord,
          TIMESTAMP '2025-07-15 14:30:00' - to_minutes(CAST((doc_id*104729) % 64800 AS BIGINT)) AS created_at,
          TIMESTAMP '2025-07-15 14:30:00' - to_minutes(CAST((doc_id*104729) % 64800 AS BIGINT)) AS updated_at,
          CASE WHEN doc_id % 97 <> 0 THEN 'https://' || source || '.example.com/feed' END AS feed_url,
          sha256(concat(split_part(text, chr(10), 1), 'https://' || source || '.example.com/a/' || doc_id, text))
            AS content_hash,
          CASE WHEN doc_id % 89 <> 0 THEN CAST((doc_id*131) % 5000 AS INTEGER) END AS fetch_duration_ms,
          embedding AS summary_embedding,
          CASE WHEN doc_id % 7 <> 0 THEN doc_id % 97 + 1 END AS story_cluster_id
        FROM documents LEFT JOIN embeddings ON vec_id = doc_id""",
    "stored_articles": "SELECT * FROM articles WHERE fetch_time < TIMESTAMP '2025-07-15 14:30:00' - INTERVAL 22 DAY",
    "items": """
        SELECT feed_url, id - 1 AS item_no, CASE WHEN (id-1) % 41 <> 0 THEN url END AS link, title,
          publish_date AS published, full_content AS description FROM articles
        UNION ALL
        SELECT 'https://mirror' || ((id-1) % 7) || '.example.com/feed', id - 1,
          CASE WHEN (id-1) % 41 <> 0 THEN url END, title, publish_date + INTERVAL 1 HOUR, full_content
        FROM articles""",
    "fetch_logs": """
        SELECT event_id AS id, 'https://src' || (user_id % 20) || '.example.com/feed' AS feed_url,
          CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status,
          CASE WHEN event_type = 'error' THEN (['HTTP 403', 'HTTP 429', 'HTTP 500', 'HTTP 503', 'HTTP 520',
            'Circuit breaker is open', 'Failed to create request: bad url', 'Failed to fetch feed: timeout',
            'Failed to parse feed: EOF', 'FlareSolverr: solved with HTTP 403', 'something else'])[event_id % 11 + 1]
            ELSE '' END AS message,
          CAST(floor(value*10) AS INTEGER) AS duration_ms,
          CAST(CASE WHEN event_type = 'error' THEN 0 ELSE event_id % 30 END AS INTEGER) AS articles_found,
          CAST(CASE WHEN event_type = 'error' THEN 0 ELSE (event_id % 30) // 4 END AS INTEGER) AS new_articles,
          ts AS created_at FROM events""",
    "failed_fetches": """
        SELECT *, CASE WHEN message LIKE 'HTTP %' THEN 'http_error'
          ELSE ['circuit_breaker_open', 'request_creation_failed', 'http_request_failed', 'parse_failed',
            'flaresolverr_failed', 'unknown'][id % 11 - 4] END AS error_type FROM fetch_logs WHERE status = 'error'""",
    "webhook_logs": """
        SELECT event_id AS id, event_id // 8 + 1 AS article_id, CAST(event_id % 8 + 1 AS INTEGER) AS attempt,
          CAST(CASE event_type WHEN 'signup' THEN 500 WHEN 'view' THEN 404 WHEN 'click' THEN 204
            WHEN 'purchase' THEN 200 END AS INTEGER) AS response_code,
          CAST(NULL AS VARCHAR) AS response_body, CAST(floor(value*10) AS INTEGER) AS latency_ms,
          CASE WHEN event_type = 'error' THEN 'timeout' END AS error_message, ts AS created_at FROM events""",
    "summary_logs": """
        SELECT event_id AS id,
          'https://src' || ((event_id // 10) % 20) || '.example.com/a/' || (event_id // 10) AS article_url,
          'm' || (user_id % 3) AS model,
          CASE WHEN event_type IN ('click','view','purchase') THEN 'success' WHEN event_type = 'signup'
            THEN 'retry_failed' ELSE 'failed' END AS status,
          CASE WHEN event_type IN ('click','view','purchase') THEN 'a summary' ELSE 'summary unavailable' END AS summary,
          CASE WHEN event_type IN ('click','view','purchase') THEN '' ELSE 'E' || (event_id % 7) END AS error_message,
          CAST(floor(value*100) AS INTEGER) AS duration_ms, CAST(event_id % 3 + 1 AS INTEGER) AS retry_attempt,
          ts AS created_at FROM events""",
    "save_logs": """
        SELECT created_at, feed_url, CASE WHEN (id-1) % 29 = 0 THEN 'save_failed' ELSE 'processed' END AS status
        FROM articles""",
    "tagged_texts": """
        SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN '<analysis>' || text || '</analysis>'
          WHEN doc_id % 3 = 0 THEN '<think>' || substr(text,1,40) || '</think> ' || substr(text,41)
          WHEN doc_id % 3 = 1 THEN '<THINKING >' || text ELSE text END AS answer FROM documents""",
    "page_fetches": """
        SELECT page_id, url, html, CASE WHEN page_id % 10 = 9 THEN 404 ELSE 200 END AS status FROM pages""",
    "page_articles": """
        SELECT page_id + 1 AS id, url, html AS full_content, 'old summary' AS summary,
          TIMESTAMP '2025-07-14 14:30:00' AS updated_at FROM pages""",
    # Feed items admitted by date, and the outcome of each item.
    "admission": """
        SELECT i.*, CASE
          WHEN coalesce(link, '') = '' THEN 'skipped_no_link'
          WHEN published IS NULL THEN 'skipped_no_publish_date'
          WHEN published < TIMESTAMP '2025-07-15 14:30:00' - INTERVAL 100 DAY THEN 'skipped_before_cutoff'
          WHEN published < TIMESTAMP '2025-07-15 14:30:00' - INTERVAL 200 DAY THEN 'skipped_before_initiation'
          WHEN link IN (SELECT url FROM stored_articles) THEN 'skipped_duplicate'
          WHEN row_number() OVER (PARTITION BY link,
              published >= TIMESTAMP '2025-07-15 14:30:00' - INTERVAL 100 DAY
            ORDER BY published NULLS LAST, feed_url NULLS FIRST, item_no) > 1 THEN 'skipped_duplicate'
          ELSE 'processed' END AS status
        FROM items i""",
    # One landed feed document per article: RSS for even ids, Atom for odd ones.
    "feed_docs": """
        SELECT id, CASE WHEN id % 2 = 0 THEN '<?xml version="1.0"?><rss version="2.0"><channel><title>t</title>'
            || '<item><title>' || t || '</title><link> ' || url || ' </link>' || coalesce('<pubDate>'
            || strftime(publish_date, '%a, %d %b %Y %H:%M:%S') || ' GMT</pubDate>', '') || '<description>' || c
            || '</description></item><item><title>second</title></item></channel></rss>'
          ELSE '<feed xmlns="http://www.w3.org/2005/Atom"><title>t</title><entry><title>' || t
            || '</title><link rel="self" href="x"/><link href="' || url || '"/>' || coalesce('<updated>'
            || strftime(publish_date, '%Y-%m-%dT%H:%M:%SZ') || '</updated>', '') || '<summary>' || c
            || '</summary></entry></feed>' END AS x
        FROM (SELECT *, replace(replace(title, '&', '&amp;'), '<', '&lt;') AS t,
          replace(replace(full_content, '&', '&amp;'), '<', '&lt;') AS c FROM articles)""",
    # Text of the article element of a page: markup dropped, entities decoded (the semicolon may be
    # missing), blanks trimmed.
    "page_texts": r"""
        SELECT page_id, url, regexp_replace(replace(t, chr(1), ''),
            '^[\s\x{0085}\x{00A0}]+|[\s\x{0085}\x{00A0}]+$', '', 'g') AS body
        FROM (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
            replace(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<', chr(1) || '<'),
            '(?s)<[^>]*>', '', 'g'),
            '&quot;?', '"', 'g'), '&copy;?', '©', 'g'), '&middot;?', '·', 'g'), '&amp;?', '&', 'g') AS t FROM pages)""",
    "page_contents": """
        SELECT page_id, url, CASE WHEN strlen(body) <= 10000 THEN body ELSE decode(unhex(substr(hex(encode(body)), 1,
          2 * CASE WHEN substr(hex(encode(body)), 20001, 2) NOT BETWEEN '80' AND 'BF' THEN 10000
                   WHEN substr(hex(encode(body)), 19999, 2) NOT BETWEEN '80' AND 'BF' THEN 9999
                   WHEN substr(hex(encode(body)), 19997, 2) NOT BETWEEN '80' AND 'BF' THEN 9998
                   ELSE 9997 END))) || '...' END AS content FROM page_texts""",
}


def with_tables(sql: str) -> str:
    """Put the derived tables that ``sql`` mentions in front of it."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in SQL.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(body)
                if name not in needed:
                    needed.append(name)

    visit(sql)
    ctes = [f"{n} AS ({SQL[n].strip()})" for n in needed]
    text = sql.strip()
    if text.upper().startswith("WITH RECURSIVE"):
        text = text[len("WITH RECURSIVE") :].strip()
        return "WITH RECURSIVE " + ", ".join([*ctes, text])
    if text.upper().startswith("WITH "):
        return "WITH " + ", ".join([*ctes, text[5:].strip()])
    return ("WITH " + ", ".join(ctes) + " " if ctes else "") + text
