"""Article listing, search, lookup and paging."""

from __future__ import annotations

import re

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Paging limits.
DEFAULT_LIMIT, MAX_LIMIT = 50, 100
DEFAULT_LATEST, MAX_LATEST = 20, 50
MIN_SEARCH_BYTES = 2

LIST_COLUMNS = (
    "id", "title", "url", "summary", "full_content",
    "publish_date", "fetch_duration_ms", "feed_url", "content_hash",
)
# A row with a NULL in one of these cannot be shown. It still counts against the page size.
NEVER_NULL = ("full_content", "publish_date", "fetch_duration_ms", "feed_url", "content_hash")


def _parse_int(value: str | int | None) -> int | None:
    """A signed 64-bit number in plain digits: no blanks, underscores or digits of other scripts."""
    found = re.fullmatch(r"[+-]?[0-9]+", str(value))
    n = int(found[0]) if found else None
    return n if n is not None and -(2**63) <= n < 2**63 else None


def like_pattern(term: str) -> str:
    """Substring pattern of ``term``. ``%`` and ``_`` stay wildcards and a backslash takes the next character as it is.

    A backslash at the end makes the closing ``%`` a character to match.
    """
    return re.sub(r"\\(.)", lambda m: m[0] if m[1] in "%_\\" else m[1], f"%{term}%", flags=re.DOTALL)


def page_limit(value: str | int | None, default: int = DEFAULT_LIMIT, most: int = MAX_LIMIT) -> int:
    n = _parse_int(value)
    return n if n is not None and 0 < n <= most else default


def page_offset(value: str | int | None) -> int:
    n = _parse_int(value)
    return n if n is not None and n >= 0 else 0


def parse_article_id(value: str) -> int:
    n = _parse_int(value)
    if n is None or n <= 0:
        raise ValueError(f"not an article id: {value!r}")
    return n


def search_term(q: str | None) -> str | None:
    """The trimmed term, or None when it is too short to search for."""
    q = (q or "").strip()
    return q if len(q.encode()) >= MIN_SEARCH_BYTES else None


def view_rows(df: DataFrame) -> DataFrame:
    """Output shape of listings: unshowable rows gone, durations in nanoseconds."""
    ns = F.col("fetch_duration_ms").cast("long") * 1_000_000
    return df.dropna(subset=list(NEVER_NULL)).withColumn("fetch_duration", ns).drop("fetch_duration_ms")


def newest(c: str = "publish_date") -> Column:
    return F.col(c).desc_nulls_first()


def oldest(c: str = "publish_date") -> Column:
    return F.col(c).asc_nulls_last()


def by_publish_date(sort: str | None) -> list[Column]:
    return [oldest() if sort == "oldest" else newest(), F.col("id").asc_nulls_last()]


def search(articles: DataFrame, q: str | None) -> DataFrame:
    """Substring match, case-insensitive, on title, summary or content. ``%`` and ``_`` stay wildcards."""
    term = search_term(q)
    if term is None:
        return articles
    pattern = like_pattern(term)
    return articles.filter(
        F.col("title").ilike(pattern) | F.col("summary").ilike(pattern) | F.col("full_content").ilike(pattern)
    )


def article_list(
    articles: DataFrame,
    feed: str | None = None,
    q: str | None = None,
    sort: str | None = None,
    limit: str | int | None = None,
    offset: str | int | None = None,
) -> DataFrame:
    rows = articles.filter(F.col("feed_url") == feed) if feed else articles
    page = (
        search(rows, q)
        .select(*LIST_COLUMNS)
        .orderBy(*by_publish_date(sort))
        .offset(page_offset(offset))
        .limit(page_limit(limit))
    )
    return view_rows(page)


def article_by_id(articles: DataFrame, article_id: str | int) -> DataFrame:
    n = parse_article_id(str(article_id))
    return view_rows(articles.filter(F.col("id") == n).select(*LIST_COLUMNS))


def article_by_url(articles: DataFrame, url: str) -> DataFrame:
    return articles.filter(F.col("url") == url)


def by_posted_status(articles: DataFrame, posted: bool, limit: int, offset: int = 0) -> DataFrame:
    return (
        articles.filter(F.col("posted_to_discord") == posted)
        .orderBy(newest("fetch_time"), F.col("id").asc_nulls_last())
        .offset(offset)
        .limit(limit)
    )


def url_pattern_match(articles: DataFrame, pattern: str) -> DataFrame:
    return articles.filter(F.col("url").ilike(like_pattern(pattern))).select("id", "url").orderBy(F.col("id").asc_nulls_last())


def latest_fetched(articles: DataFrame, limit: str | int | None = None) -> DataFrame:
    columns = [c for c in LIST_COLUMNS if c != "summary"]
    page = (
        articles.select(*columns, "fetch_time")
        .orderBy(newest("fetch_time"), F.col("id").asc_nulls_last())
        .limit(page_limit(limit, DEFAULT_LATEST, MAX_LATEST))
    )
    return view_rows(page)


def logs_of_article(webhook_logs: DataFrame, article_id: int) -> DataFrame:
    return webhook_logs.filter(F.col("article_id") == article_id).orderBy(
        F.col("attempt").desc_nulls_first(), F.col("id").asc_nulls_last()
    )


def recent_logs(logs: DataFrame, status: str, now: datetime, hours: int = 24) -> DataFrame:
    """Log rows of one status, strictly younger than ``hours``."""
    return logs.filter((F.col("status") == status) & (F.col("created_at") > F.lit(now - timedelta(hours=hours))))


def upcoming(articles: DataFrame, now: datetime) -> DataFrame:
    """Entries dated in the future, which digests leave out."""
    return articles.filter(F.col("publish_date") > F.lit(now))
