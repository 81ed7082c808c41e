"""Re-extraction of stored articles from freshly fetched pages."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.functions.html import extract_main_content
from storyloom.functions.text import MAX_ARTICLE_BYTES, sanitize_utf8
from storyloom.operators.listing import like_pattern
from storyloom.operators.tables import keyed_update
from storyloom.sources.pages import HTTP_OK, latest_pages

# Fixed value: shorter texts are not worth storing.
MIN_BODY_BYTES = 400


def body_long_enough(content: Column) -> Column:
    return F.octet_length(content) >= MIN_BODY_BYTES


def reextract_outcomes(
    articles: DataFrame, pages: DataFrame, pattern: str, max_bytes: int = MAX_ARTICLE_BYTES
) -> DataFrame:
    """(id, outcome, full_content) for every article whose url contains ``pattern``.

    ``pages``: url, html, status (HTTP code). A page that is missing or not 200 counts as failed; of several
    the latest one counts, by ``fetched_at`` if there is such a column.
    """
    matched = articles.filter(F.col("url").ilike(like_pattern(pattern))).select("id", "url")
    fetched = latest_pages(pages.filter(F.col("status") == HTTP_OK).join(matched.select("url").distinct(), "url", "left_semi"))
    content = extract_main_content(F.col("html"), max_bytes)
    # Text is extracted after the join, so only matched pages reach Python.
    got = matched.join(fetched, "url", "left").select("id", content.alias("full_content"))
    outcome = (
        F.when(F.col("full_content").isNull(), "failed")
        .when(~body_long_enough(F.col("full_content")), "skipped")
        .otherwise("updated")
    )
    return got.select("id", outcome.alias("outcome"), sanitize_utf8(F.col("full_content")).alias("full_content"))


def reextract(
    articles: DataFrame, outcomes: DataFrame, now: datetime, reset_embedding: bool = False
) -> DataFrame:
    """The table with the new texts; their summaries are cleared so that they are made again."""
    updates = outcomes.filter(F.col("outcome") == "updated").select("id", "full_content")
    fixed = {"summary": F.lit(None).cast("string")}
    if reset_embedding:
        fixed["summary_embedding"] = F.lit(None).cast("array<float>")
        fixed["story_cluster_id"] = F.lit(None).cast("long")
    return keyed_update(articles, updates, "id", ["full_content"], now, fixed)


def backfill_report(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))

