"""Merges into a stored table against the same merges of whole frames."""

import os
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from storyloom.operators import merge, tables
from storyloom.schemas import ARTICLES
from storyloom.session import shared_folder
from storyloom.sources.tables import read_table

NOW = datetime(2025, 7, 15, 12, tzinfo=timezone.utc)
DAYS = 6


@pytest.fixture(scope="module")
def stored(spark):
    """Five rows a day for some days, and one without a time."""
    rows = spark.range(1, 5 * DAYS + 2).select("id", F.concat(F.lit("u"), "id").alias("url"))
    created = F.when(F.col("id") <= 5 * DAYS, F.lit(NOW - timedelta(days=10)) + F.make_dt_interval(((F.col("id") - 1) / 5).cast("int")))
    given = {
        "title": F.concat(F.lit("t"), "id"),
        "full_content": F.concat(F.lit("text "), "id"),
        "created_at": created,
        "updated_at": created,
        "posted_to_discord": F.lit(False),
        "story_cluster_id": F.col("id") % 3,
        "fetch_duration_ms": F.col("id"),
    }
    out = [F.col(f.name) if f.name in ("id", "url") else given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in ARTICLES]
    return rows.select(*out)


def table(spark, rows):
    path = shared_folder(spark, "merge").removeprefix("file:")
    merge.write_table(rows, path)
    return path


def files(path):
    return {d: {n: os.stat(f"{path}/{d}/{n}").st_mtime_ns for n in os.listdir(f"{path}/{d}")} for d in os.listdir(path) if d.startswith("day=")}


def rows_of(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)


def incoming(spark, urls):
    data = [(f"new {u} {n}", u, None, f"s{n}" if n % 2 else None, None, NOW, True, None, None, 5, n) for n, u in enumerate(urls)]
    schema = (
        "title string, url string, publish_date timestamp, summary string, full_content string, fetch_time timestamp, "
        "posted_to_discord boolean, feed_url string, content_hash string, fetch_duration_ms int, batch_no long"
    )
    return spark.createDataFrame(data, schema)


@pytest.mark.parametrize("urls", [["u3", "x", "u4", "x", "y", "u3"], ["u31", "z"], ["new only"], []])
def test_upsert_equals_the_whole_frame(spark, stored, urls):
    path = table(spark, stored)
    batch = incoming(spark, urls)
    want = rows_of(tables.upsert(stored, batch, NOW))
    merge.merge_upsert(spark, path, ARTICLES, batch, NOW)
    assert rows_of(read_table(spark, path, ARTICLES)) == want
    merge.merge_upsert(spark, path, ARTICLES, batch, NOW)  # as after a failure
    assert rows_of(read_table(spark, path, ARTICLES)) == want


def test_upsert_leaves_other_days_alone(spark, stored):
    path = table(spark, stored)
    before = files(path)
    merge.merge_upsert(spark, path, ARTICLES, incoming(spark, ["u1", "u2", "fresh"]), NOW)
    after = files(path)
    changed = {d for d in before if after[d] != before[d]}
    assert changed == {"day=2025-07-05"} and set(after) - set(before) == {"day=2025-07-15"}


def test_texts_of_other_days_are_not_read(spark, stored):
    path = table(spark, stored)
    all_rows = merge._stored(spark, path, ARTICLES)
    keys = spark.createDataFrame([("u1",)], "url string")
    narrow = all_rows.select("url", "day").join(keys, "url", "left_semi")._jdf.queryExecution().toString()
    scan = next(line for line in narrow.splitlines() if "FileScan" in line)
    assert "ReadSchema: struct<url:string>" in scan
    _, days = merge._hits(all_rows, keys, "url")
    assert [str(d) for d in days] == ["2025-07-05"]
    assert {f.split("/")[-2] for f in merge._on_days(all_rows, days).inputFiles()} == {f"day={d}" for d in before_days(path)}
    plan = merge._on_days(all_rows, days)._jdf.queryExecution().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "PartitionFilters: [isnotnull(day#" in scan


def before_days(path):
    """All folders: the listing holds them, and the scan's partition filter prunes them."""
    return [d.removeprefix("day=") for d in os.listdir(path) if d.startswith("day=")]


def test_rewriting_reads_only_the_days_it_changes(spark, stored):
    path = table(spark, stored)
    folder = f"{path}/day=2025-07-08"
    damaged = []
    for name in os.listdir(folder):
        if name.endswith(".parquet"):
            damaged.append(f"{folder}/{name}")
        else:
            os.remove(f"{folder}/{name}")
    merge_day = merge._on_days(merge._stored(spark, path, ARTICLES), [datetime(2025, 7, 6).date()])
    for name in damaged:
        with open(name, "wb") as f:
            f.write(b"not a table")
    assert merge_day.count() == 5
    with pytest.raises(Exception):
        merge._on_days(merge._stored(spark, path, ARTICLES), [datetime(2025, 7, 8).date()]).count()


def test_insert_ignore_equals_the_whole_frame(spark, stored):
    rows = stored.withColumn("url", F.concat(F.lit("u"), F.col("id") * 2)).withColumn("feed_url", F.when(F.col("id") % 4 != 0, F.lit("f")))
    rows = rows.unionByName(rows.withColumn("title", F.lit("later")).withColumn("feed_url", F.lit("g"))).drop("id")
    order = [F.col("feed_url").asc_nulls_first()]
    at = F.lit(NOW).cast("timestamp")
    want = tables.insert_ignore(stored, rows.withColumns({"created_at": at, "updated_at": at}), order)
    path = table(spark, stored)
    before = files(path)
    for _ in range(2):
        merge.merge_insert_ignore(spark, path, ARTICLES, rows, [F.col("feed_url")], NOW)
        columns = ["id", "url", "title", "feed_url", "full_content", "created_at"]
        assert rows_of(read_table(spark, path, ARTICLES).select(columns)) == rows_of(want.select(columns))
    assert all(files(path)[d] == before[d] for d in before)  # appended only


@pytest.mark.parametrize("ids", [[1, 2, 2, 30], [31], [500], []])
def test_update_equals_the_whole_frame(spark, stored, ids):
    updates = spark.createDataFrame([(i, f"s{n}") for n, i in enumerate(ids)], "id long, summary string")
    want = rows_of(tables.keyed_update(stored, updates, "id", ["summary"], NOW))
    path = table(spark, stored)
    merge.merge_update(spark, path, ARTICLES, updates, "id", ["summary"], NOW)
    assert rows_of(read_table(spark, path, ARTICLES)) == want


def test_ids_follow_the_order_over_slices(spark, stored):
    fresh = incoming(spark, [f"n{i}" for i in range(40)])
    ids = merge.next_ids(fresh, stored, [F.col("batch_no"), F.col("url")], slice_rows=7).collect()
    assert sorted((r.id, r.url) for r in ids) == [(32 + i, f"n{i}") for i in range(40)]
