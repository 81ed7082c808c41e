"""Fetched pages and stored urls as input relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HTTP_OK = 200


def page_scan(pages: DataFrame) -> DataFrame:
    """Successful page bodies. ``pages``: url, html, status."""
    return pages.filter(F.col("status") == HTTP_OK).select("url", "html")


def latest_pages(pages: DataFrame) -> DataFrame:
    """One (url, html) a url: that of the latest ``fetched_at`` if there is one, else the largest."""
    order = [F.col("fetched_at")] if "fetched_at" in pages.columns else []
    newest = F.max_by("html", F.struct(*order, F.col("html")))
    return pages.groupBy("url").agg(newest.alias("html"))


def url_scan(articles: DataFrame) -> DataFrame:
    return articles.select("url")
