"""Story clustering on a timer: every micro-batch clusters what is new since the last."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from storyloom.functions.time import CLUSTER_WINDOW_DAYS
from storyloom.operators.cluster import SIMILARITY_THRESHOLD, article_vectors, leader_cluster
from storyloom.sources.tables import append

CYCLE_INTERVAL = "15 minutes"
ASSIGNMENTS = "id long, story_cluster_id long, publish_date timestamp, summary_embedding array<float>"


def cluster_stream(
    articles: DataFrame,
    assignments_path: str,
    checkpoint: str,
    now: Callable[[], datetime],
    threshold: float = SIMILARITY_THRESHOLD,
    window_days: int = CLUSTER_WINDOW_DAYS,
    trigger: dict | None = None,
) -> StreamingQuery:
    """``articles``: id, publish_date, summary_embedding. Appends assignments to ``assignments_path``.

    Each batch meets the seeds stored by earlier batches. The window reaches back from ``now()``, asked
    once a batch; articles before it are late and never cluster, articles with dates to come do. Rows
    already assigned are skipped, so a replayed batch changes nothing.
    """
    spark = articles.sparkSession
    append(spark.createDataFrame([], ASSIGNMENTS), assignments_path)

    def cycle(batch: DataFrame, _: int) -> None:
        stored = batch.sparkSession.read.schema(ASSIGNMENTS).parquet(assignments_path)
        batch.persist()
        recent = F.col("publish_date") >= F.lit(now() - timedelta(days=window_days))
        fresh = batch.filter(recent & F.col("summary_embedding").isNotNull()).join(
            stored.select("id"), "id", "left_anti"
        )
        known = stored.filter(recent & (F.col("story_cluster_id") == F.col("id")))
        assigned = leader_cluster(article_vectors(fresh), threshold, article_vectors(known))
        append(assigned.join(fresh, "id").select("id", "story_cluster_id", "publish_date", "summary_embedding"),
               assignments_path)
        batch.unpersist()

    writer = articles.writeStream.foreachBatch(cycle).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": CYCLE_INTERVAL})).start()
