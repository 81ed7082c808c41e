from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from storyloom.operators import admission as ad
from storyloom.schemas import ITEMS

CUTOFF = datetime(2025, 5, 31, tzinfo=timezone.utc)
INITIATION = datetime(2020, 1, 1, tzinfo=timezone.utc)


def zone(hours):
    return timezone(timedelta(hours=hours))


DATES = [
    (datetime(2025, 5, 30, 23, 59, 59, tzinfo=timezone.utc), False),
    (datetime(2025, 5, 31, tzinfo=timezone.utc), True),
    (datetime(2025, 6, 1, 12, tzinfo=timezone.utc), True),
    (datetime(2025, 5, 30, 18, tzinfo=zone(-5)), False),
    (datetime(2025, 5, 30, 19, tzinfo=zone(-5)), True),
    (datetime(2025, 5, 31, 1, tzinfo=zone(1)), True),
    (datetime(2025, 5, 30, 15, tzinfo=zone(-8)), False),
    (datetime(2025, 5, 30, 16, tzinfo=zone(-8)), True),
    (datetime(2025, 5, 31, 9, tzinfo=zone(9)), True),
    (None, False),
]


def items(spark, rows):
    return spark.createDataFrame(rows, ITEMS)


def test_date_cutoff_is_inclusive_in_every_zone(spark):
    rows = [("f", i, f"u{i}", "t", at, "d") for i, (at, _) in enumerate(DATES)]
    kept = {r.item_no for r in ad.date_cutoff(items(spark, rows), CUTOFF, INITIATION).collect()}
    assert kept == {i for i, (_, keep) in enumerate(DATES) if keep}


def test_status_order_and_duplicates(spark):
    new, old = CUTOFF + timedelta(days=1), CUTOFF - timedelta(days=1)
    rows = [
        ("f", 0, None, "t", None, ""),
        ("f", 1, "", "t", new, ""),
        ("f", 2, "u2", "t", None, ""),
        ("f", 3, "u3", "t", old, ""),
        ("f", 4, "dup", "t", new + timedelta(hours=1), ""),
        ("g", 0, "dup", "t", new, ""),
        ("g", 1, "stored", "t", new, ""),
        ("g", 2, "dup", "t", old, ""),
    ]
    stored = spark.createDataFrame([("stored",)], "url string")
    got = ad.admission_status(items(spark, rows), stored, CUTOFF, INITIATION)
    status = {(r.feed_url, r.item_no): r.status for r in got.collect()}
    assert status == {
        ("f", 0): "skipped_no_link",
        ("f", 1): "skipped_no_link",
        ("f", 2): "skipped_no_publish_date",
        ("f", 3): "skipped_before_cutoff",
        ("f", 4): "skipped_duplicate",
        ("g", 0): "processed",
        ("g", 1): "skipped_duplicate",
        ("g", 2): "skipped_before_cutoff",
    }
    late_start = ad.admission_status(items(spark, rows), stored, INITIATION, CUTOFF)
    assert {r.status for r in late_start.collect() if r.item_no == 3} == {"skipped_before_initiation"}


def test_hot_link_keeps_one_winner(spark):
    rows = spark.range(3000).select(
        F.lit("f").alias("feed_url"),
        F.col("id").alias("item_no"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("u"), "id")).alias("link"),
        F.lit("t").alias("title"),
        (F.lit(CUTOFF) + F.make_interval(mins=(3000 - F.col("id")).cast("int"))).alias("published"),
        F.lit("d").alias("description"),
    )
    none = spark.createDataFrame([], "url string")
    got = ad.admission_status(rows, none, CUTOFF, INITIATION).cache()
    assert got.count() == 3000
    assert got.filter("status = 'processed'").count() == 2001
    assert got.filter("link = 'hot' and status = 'processed'").first().item_no == 2997


def test_description_stands_in_for_a_missing_page(spark):
    new = CUTOFF + timedelta(days=1)
    rows = items(spark, [("f", 0, "a", "t", new, "desc a"), ("f", 1, "b", "t", new, "desc b")])
    pages = spark.createDataFrame([("a", "<article>page a</article>")], "url string, html string")
    got = {r.link: r.content for r in ad.with_page_text(rows, pages).collect()}
    assert got == {"a": "page a", "b": "desc b"}


@pytest.mark.parametrize("now", [datetime(2025, 6, 2, tzinfo=timezone.utc)])
def test_fetch_log_rows(spark, now):
    new = CUTOFF + timedelta(days=1)
    rows = items(spark, [("f", i, f"u{i}", "t", new if i else None, "") for i in range(3)])
    statuses = ad.admission_status(rows, spark.createDataFrame([], "url string"), CUTOFF, INITIATION)
    fetches = spark.createDataFrame(
        [("f", "success", "", 12), ("g", "error", "HTTP 500", 5)],
        "feed_url string, status string, message string, duration_ms int",
    )
    got = {r.feed_url: (r.articles_found, r.new_articles, r.status) for r in ad.fetch_log_rows(statuses, fetches, now).collect()}
    assert got == {"f": (3, 2, "success"), "g": (0, 0, "error")}
