"""The physical plans the operators rely on, over stored tables."""

from datetime import timedelta

import pytest

from storyloom.operators import admission, digest, stats
from storyloom.plans.catalog import QUERIES
from storyloom.schemas import ARTICLES, ITEMS
from storyloom.sources.tables import append, read_table
from test_listing import NOW, article, table

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def schemas(text):
    return [line for line in text.splitlines() if line.startswith("ReadSchema")]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("articles"))
    append(table(spark, [article(i, NOW - i * timedelta(days=1), cluster=1) for i in range(6)]), path, day_of="publish_date")
    return path


def test_digest_pushes_time_filters_and_prunes_columns(spark, stored):
    text = plan(digest.digest(read_table(spark, stored, ARTICLES), "weekly", NOW))
    assert "GreaterThanOrEqual(publish_date" in text and "LessThanOrEqual(publish_date" in text
    assert "summary_embedding" not in " ".join(schemas(text))
    assert any("full_content" not in s and "feed_url" in s for s in schemas(text))


def test_days_outside_the_bounds_are_not_read(spark, stored):
    df = read_table(spark, stored, ARTICLES, since=NOW - timedelta(days=2), until=NOW)
    assert "PartitionFilters: [isnotnull(day" in plan(df).replace("\n", " ")
    assert len(df.inputFiles()) >= 3 and df.count() == 3


def test_statistics_do_not_read_texts(spark, stored):
    arts = read_table(spark, stored, ARTICLES)
    for df in (stats.feed_stats(arts), stats.article_stats(arts), digest.cross_feed_counts(arts, NOW)):
        assert all("full_content" not in s and "summary" not in s for s in schemas(plan(df)))


def test_first_per_url_is_limited_before_the_shuffle(spark):
    items = spark.createDataFrame([], ITEMS)
    assert plan(admission.first_per_url(items)).count("WindowGroupLimit") >= 2


def test_small_batches_do_not_shuffle_the_stored_table(spark, stored):
    items = spark.createDataFrame([("f", 0, "u1", "t", NOW, "d")], ITEMS)
    known = admission.linked_rows(items, read_table(spark, stored, ARTICLES).select("url"))
    assert [r.url for r in known.collect()] == ["u1"]
    assert "BroadcastHashJoin" in plan(known) and "SortMergeJoin" not in plan(known)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if "stream" not in n and "windowed" not in n and n != "late_data"))
def test_no_query_pairs_every_row_with_every_row(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
