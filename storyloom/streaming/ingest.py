"""Landed feed items into the article table, as a stream."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from storyloom.operators.admission import (
    PROCESSED,
    admission_status,
    as_articles,
    feed_run_summary,
    linked_rows,
    stored_link,
    with_page_text,
)
from storyloom.schemas import ARTICLES
from storyloom.sources.tables import append, read_table

# Fixed value: polling interval.
POLL_INTERVAL = "5 minutes"


def admit_batch(
    items: DataFrame,
    stored_urls: DataFrame,
    cutoff: datetime,
    initiation: datetime,
    now: datetime,
    pages: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(item statuses, article rows to append without id) of one micro-batch.

    ``pages``: url, html of fetched pages; without a page the item's description is the content.
    """
    statuses = admission_status(items, stored_urls, cutoff, initiation)
    return statuses, article_rows(statuses.filter(F.col("status") == PROCESSED), now, pages)


def article_rows(accepted: DataFrame, now: datetime, pages: DataFrame | None) -> DataFrame:
    if pages is None:
        return as_articles(accepted.withColumn("content", F.col("description")), now)
    return as_articles(with_page_text(accepted, linked_rows(accepted, pages)), now)


def ingest_stream(
    items: DataFrame,
    table_path: str,
    checkpoint: str,
    cutoff: datetime,
    initiation: datetime,
    now: Callable[[], datetime],
    trigger: dict | None = None,
    pages: Callable[[], DataFrame] | None = None,
    log_path: str | None = None,
) -> StreamingQuery:
    """Append admitted items to ``table_path``. The table itself is the memory of seen urls.

    ``now`` and ``pages`` are asked once a batch, so that times move on and pages landed since are seen.
    With ``log_path``, every batch writes a fetch-log row per feed it held items of, in a folder of its own
    (``run``). A batch first writes down what it decided on each item. Replayed after a failure at any
    later point, it keeps to that: urls that got stored are not appended again and its log is written
    over. Article ids are given when the table is compacted.
    """
    spark = items.sparkSession
    schema = type(ARTICLES)([f for f in ARTICLES if f.name != "id"])
    append(spark.createDataFrame([], schema), table_path)  # an empty file, so that the path exists

    def save(batch: DataFrame, run: int) -> None:
        at = now()
        stored = read_table(batch.sparkSession, table_path, schema).select("url")
        # Two slots in turn: that of the last batch is no longer needed.
        decided = _decisions(batch, stored, cutoff, initiation, f"{checkpoint}/decided/{run % 2}", run)
        accepted = decided.filter(F.col("status") == PROCESSED)
        fresh = accepted.withColumn("url", stored_link(F.col("link")))
        fresh = fresh.join(linked_rows(accepted, stored), "url", "left_anti").drop("url")
        append(article_rows(fresh, at, pages() if pages else None), table_path)
        if log_path is not None:
            batch_log(decided, at).write.mode("overwrite").parquet(f"{log_path}/run={run}")

    writer = items.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": POLL_INTERVAL})).start()


def _decisions(
    batch: DataFrame, stored: DataFrame, cutoff: datetime, initiation: datetime, folder: str, run: int
) -> DataFrame:
    """The batch's items with ``status``, as decided when the batch was first seen.

    The run is marked after its decisions are written whole; a folder without the mark is decided anew. Nothing
    has been appended then.
    """
    spark = batch.sparkSession
    mark, marked = f"{folder}-whole", "run long"
    schema = T.StructType([*batch.schema.fields, T.StructField("status", T.StringType()), T.StructField("_run", T.LongType())])
    try:
        last = spark.read.schema(marked).parquet(mark).first()
    except AnalysisException:  # no such folder yet
        last = None
    if last is None or last["run"] != run:
        batch.persist()
        statuses = admission_status(batch, linked_rows(batch, stored), cutoff, initiation)
        statuses.withColumn("_run", F.lit(run).cast("long")).write.mode("overwrite").parquet(folder)
        spark.range(1).select(F.lit(run).cast("long").alias("run")).write.mode("overwrite").parquet(mark)
        batch.unpersist()
    return spark.read.schema(schema).parquet(folder).drop("_run")


def batch_log(statuses: DataFrame, now: datetime) -> DataFrame:
    """Fetch-log rows of one batch: how many items each feed had and how many were new."""
    fetched = feed_run_summary(statuses).filter(F.col("feed_url").isNotNull())
    return fetched.select(
        "feed_url",
        F.lit("success").alias("status"),
        F.lit("").alias("message"),
        F.lit(None).cast("int").alias("duration_ms"),
        F.col("articles_found").cast("int").alias("articles_found"),
        F.col("new_articles").cast("int").alias("new_articles"),
        F.lit(now).cast("timestamp").alias("created_at"),
    )


def bounded_dedup(items: DataFrame, arrived: Column, delay: str = "35 days") -> DataFrame:
    """Stream variant with bounded memory: one item per stored link within the watermark.

    An item counts from its publish date or from when it ``arrived``, whichever is earlier: a date to come
    must not move the watermark past everything else.
    """
    dated = items.filter(F.col("published").isNotNull() & (F.coalesce("link", F.lit("")) != ""))
    timed = dated.withColumn("_at", F.least("published", arrived)).withColumn("_stored", stored_link(F.col("link")))
    return timed.withWatermark("_at", delay).dropDuplicatesWithinWatermark(["_stored"]).drop("_at", "_stored")
