from datetime import datetime, timedelta, timezone

import pytest

from storyloom.functions import time as tm
from storyloom.operators import digest as dg
from storyloom.operators import listing as ls
from storyloom.schemas import ARTICLES

NOW = datetime(2026, 7, 15, 14, 30, tzinfo=timezone.utc)


def article(i, published=NOW, feed="f", cluster=None, **other):
    row = {
        "id": i, "title": f"title {i}", "url": f"u{i}", "publish_date": published, "summary": None,
        "full_content": "text", "fetch_time": NOW, "posted_to_discord": False, "created_at": NOW, "updated_at": NOW,
        "feed_url": feed, "content_hash": f"h{i}", "fetch_duration_ms": 5, "summary_embedding": None,
        "story_cluster_id": cluster,
    }
    row.update(other)
    return tuple(row[f.name] for f in ARTICLES)


def table(spark, rows):
    return spark.createDataFrame(rows, ARTICLES)


def ids(df):
    return [r.id for r in df.collect()]


def test_paging_values():
    assert [ls.page_limit(v) for v in (None, "0", "-1", "101", "x", "7", 100)] == [50, 50, 50, 50, 50, 7, 100]
    assert [ls.page_offset(v) for v in (None, "-1", "x", "0", "20")] == [0, 0, 0, 0, 20]
    assert [ls.page_limit(v, ls.DEFAULT_LATEST, ls.MAX_LATEST) for v in (None, 51, 50)] == [20, 20, 50]


def test_search_terms():
    assert [ls.search_term(q) for q in (None, "", "a", "   ", " cve ", "é")] == [None, None, None, None, "cve", "é"]


@pytest.mark.parametrize(("text", "n"), [("123", 123), ("1", 1)])
def test_article_id(text, n):
    assert ls.parse_article_id(text) == n


@pytest.mark.parametrize("text", ["", "abc", "0", "-5"])
def test_bad_article_id(text):
    with pytest.raises(ValueError, match="not an article id"):
        ls.parse_article_id(text)


def test_order_page_then_drop_unshowable(spark):
    day = timedelta(days=1)
    rows = [article(1, NOW - day), article(2, None), article(3, NOW), article(4, NOW), article(5, NOW - 2 * day)]
    arts = table(spark, rows)
    # The undated row sorts first, takes a place on the page, and is then not shown.
    assert ids(ls.article_list(arts, limit=3)) == [3, 4]
    assert ids(ls.article_list(arts, sort="oldest", limit=3)) == [5, 1, 3]
    assert ids(ls.article_list(arts, sort="publish_date; --", limit=2, offset=2)) == [4, 1]
    assert ls.article_list(arts, limit=2).first().fetch_duration == 5_000_000


def test_search_uses_three_columns_and_wildcards(spark):
    rows = [
        article(1, title="Ransomware wave"),
        article(2, summary="about RANSOMWARE"),
        article(3, full_content="the ransomware text", summary="x"),
        article(4),
        article(5, title="ransom-ware"),
    ]
    arts = table(spark, rows)
    assert sorted(ids(ls.search(arts, "ransomware"))) == [1, 2, 3]
    assert sorted(ids(ls.search(arts, "ransom_ware"))) == [5]
    assert sorted(ids(ls.search(arts, "r"))) == [1, 2, 3, 4, 5]
    assert ids(ls.article_list(arts, feed="other")) == []


@pytest.mark.parametrize(
    ("name", "days"),
    [("daily", 1), ("weekly", 7), ("monthly", 30), ("quarterly", 90), ("halfyearly", 182), ("yearly", 365),
     ("", 1), ("garbage", 1), (None, 1)],
)
def test_digest_windows(name, days):
    assert tm.digest_since(name, NOW) == NOW - timedelta(days=days)


@pytest.mark.parametrize("now", [datetime(2026, 7, 27), datetime(2026, 7, 1), datetime(2026, 1, 1), NOW])
def test_windows_nest(now):
    starts = [tm.digest_since(name, now) for name in tm.RANGE_DAYS]
    assert all(a > b for a, b in zip(starts, starts[1:], strict=False))


def test_count_window():
    daily, yearly = tm.digest_since("daily", NOW), tm.digest_since("yearly", NOW)
    assert tm.digest_count_since(daily, NOW, 35) == NOW - timedelta(days=35)
    assert tm.digest_count_since(yearly, NOW, 35) == yearly
    assert tm.digest_count_since(daily, NOW, 0) == daily
    assert all(tm.digest_count_since(tm.digest_since(r, NOW), NOW, 35) <= tm.digest_since(r, NOW) for r in tm.RANGE_DAYS)


def test_digest_counts_split_and_order(spark):
    hour = timedelta(hours=1)
    rows = [
        article(1, NOW - hour, "a", 1),
        article(2, NOW - 30 * 24 * hour, "b", 1),  # counted, not listed
        article(3, NOW + hour, "c", 1),  # upcoming: counted, not listed
        article(4, NOW - 40 * 24 * hour, "d", 1),  # outside both windows
        article(5, NOW - 2 * hour, "a", None),
        article(6, NOW - 3 * hour, None, 6, title="no feed"),
        article(7, NOW - 2 * hour, "a", 7),
        article(8, NOW, "z", 1),
    ]
    arts = table(spark, rows)
    got = [(r.id, r.cross_feed_count, r.bucket) for r in dg.digest(arts, "daily", NOW).collect()]
    assert got == [(8, 3, "important"), (1, 3, "important"), (5, 0, "other"), (7, 0, "other")]
    # A story whose feeds are all unknown counts -1; its rows cannot be shown.
    raw = {r.id: r.cross_feed_count for r in dg.digest_rows(arts, "daily", NOW).collect()}
    assert raw[6] == -1
    assert ids(ls.upcoming(arts, NOW)) == [3]


def test_importance_needs_two_other_feeds(apply):
    assert apply([3, 1, 2, 0, -1], "int", dg.importance) == ["important", "other", "important", "other", "other"]


def test_feed_times(apply):
    from pyspark.sql import functions as F

    texts = ["Tue, 15 Jul 2026 10:00:00 EST", "15 Jul 2026 10:00 GMT", "Wed, 1 May 2024 04:00:00 -0500",
             "2026-07-15T10:00:00Z", "2026-07-15T10:00:00+02:00", "nonsense", None]
    got = apply(texts, "string", lambda c: F.date_format(tm.parse_feed_time(c), "yyyy-MM-dd HH:mm"))
    assert got == ["2026-07-15 15:00", "2026-07-15 10:00", "2024-05-01 09:00", "2026-07-15 10:00",
                   "2026-07-15 08:00", None, None]


@pytest.mark.parametrize("bad", ["1_0", " 7 ", "\u0667", "1.0", "", "0", "-3", "9223372036854775808", "0x1"])
def test_ids_that_are_not_plain_numbers_are_rejected(bad):
    with pytest.raises(ValueError):
        ls.parse_article_id(bad)


def test_signed_ids_and_limits():
    assert ls.parse_article_id("+5") == 5 and ls.parse_article_id("9223372036854775807") == 2**63 - 1
    assert ls.page_limit("1_0", 20, 100) == 20 and ls.page_offset("-1") == 0


@pytest.mark.parametrize(
    ("term", "found"),
    [(r"C:\windows", ["C:windows now"]), (r"50\%", ["50% off"]), ("50%", ["50 euro", "50% off"]), (r"a\_b", ["a_b"]), (r"x\\y", [r"x\y"]), ("f\\", ["50% of%"])],
)
def test_backslashes_in_search_terms(spark, term, found):
    titles = ["C:windows now", r"C:\windows now", "50% off", "50 euro", "a_b", "acb", r"x\y", "50% of%"]
    rows = table(spark, [article(i, title=t) for i, t in enumerate(titles, 1)])
    got = sorted(r.title for r in ls.search(rows, term).select("title").collect())
    assert got == sorted(set(found) | ({"50% of%"} if "50" in term else set()))
