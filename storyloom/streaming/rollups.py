"""Minute, hour and day totals kept by a stream, which dashboards read in place of events.

Totals are sums and histogram buckets, so they merge by adding. Every micro-batch adds what it saw, per minute, per
hour and per day, to a folder of its own (``run``): late events need no watermark, and a batch that is run again
writes over its folder. ``compact`` folds the runs up to one into a base.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from storyloom.operators.metrics import STAGE_BOUNDS, bound_text, histogram_quantile, own_buckets

LEVELS = ("minute", "hour", "day")
BOUNDS = tuple(sorted({b for own in STAGE_BOUNDS.values() for b in own}))
_BUCKETS = [f"le_{i}" for i in range(len(BOUNDS))]
_SUMS = ["events", "good", "timed", *_BUCKETS]
#: ``on_edge``: the events at the very start of the slot, which windows that end there hold and others do not.
TOTALS = f"stage string, slot timestamp, on_edge boolean, {', '.join(f'{c} long' for c in _SUMS)}"
RUN, POLL_INTERVAL = "run", "1 minute"


def totals(events: DataFrame, level: str = "minute") -> DataFrame:
    """``TOTALS`` of events (ts, stage, ok, seconds); ``seconds`` may be NULL. Buckets are cumulative."""
    slot = F.date_trunc(level, "ts")
    buckets = [F.count_if(F.col("seconds") <= F.lit(b)).alias(c) for c, b in zip(_BUCKETS, BOUNDS, strict=True)]
    return events.groupBy("stage", slot.alias("slot"), (F.col("ts") == slot).alias("on_edge")).agg(
        F.count(F.lit(1)).alias("events"), F.count_if("ok").alias("good"), F.count("seconds").alias("timed"), *buckets
    )


def merged(rows: DataFrame, level: str) -> DataFrame:
    """``TOTALS`` rows of any runs and finer levels, added up."""
    slot = F.date_trunc(level, "slot")
    edge = F.col("on_edge") & (F.col("slot") == slot)
    return rows.groupBy("stage", slot.alias("_slot"), edge.alias("_edge")).agg(*[F.sum(c).alias(c) for c in _SUMS]).select(
        "stage", F.col("_slot").alias("slot"), F.col("_edge").alias("on_edge"), *_SUMS
    )


def add_totals(events: DataFrame, path: str, run: int) -> None:
    """What one batch adds, at every level; each from the one before it."""
    rows = totals(events).persist()
    for level in LEVELS:
        rows_of = rows if level == "minute" else merged(rows, level)
        rows_of.write.mode("overwrite").parquet(f"{path}/{level}/{RUN}={run}")
    rows.unpersist()


def rollup_stream(
    events: DataFrame, path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Keep the totals of a stream of events (ts, stage, ok, seconds) below ``path``."""

    def add(batch: DataFrame, run: int) -> None:
        add_totals(batch, path, run)

    writer = events.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": POLL_INTERVAL})).start()


def _base(spark: SparkSession, path: str, level: str) -> int | None:
    """The last run of the newest base that is whole: its mark is written behind it."""
    try:
        return spark.read.schema("base long").parquet(f"{path}/{level}-bases").agg(F.max("base")).first()[0]
    except AnalysisException:  # none yet
        return None


def _parts(spark: SparkSession, path: str, level: str, last: int | None = None) -> DataFrame:
    """All that is to be added up, of runs up to ``last``."""
    runs = spark.read.schema(f"{TOTALS}, {RUN} long").parquet(f"{path}/{level}")
    base = _base(spark, path, level)
    if last is not None:
        runs = runs.filter(F.col(RUN) <= last)
    if base is None:
        return runs.drop(RUN)
    folded = spark.read.schema(TOTALS).parquet(f"{path}/{level}-base/{RUN}={base}")
    return folded.unionByName(runs.filter(F.col(RUN) > base).drop(RUN))


def compact(spark: SparkSession, path: str, last: int) -> None:
    """Fold the runs up to ``last``, which must be whole, into a new base at every level. Readers see no change."""
    for level in LEVELS:
        base = _base(spark, path, level)
        if base is not None and base >= last:
            continue
        merged(_parts(spark, path, level, last), level).write.mode("overwrite").parquet(f"{path}/{level}-base/{RUN}={last}")
        spark.range(1).select(F.lit(last).cast("long").alias("base")).write.mode("append").parquet(f"{path}/{level}-bases")


def read_totals(spark: SparkSession, path: str, level: str) -> DataFrame:
    """``TOTALS`` of all runs, one row a stage, slot and edge."""
    return merged(_parts(spark, path, level), level)


def _after_until(since: datetime, until: datetime) -> Column:
    """Totals of (since, until], which must be whole slots: an edge belongs to the window that ends there."""
    slot, edge = F.col("slot"), F.col("on_edge")
    return ((slot >= F.lit(since)) & ~((slot == F.lit(since)) & edge) & (slot < F.lit(until))) | ((slot == F.lit(until)) & edge)


def rollup_p95(
    spark: SparkSession,
    path: str,
    now: datetime,
    window: timedelta,
    bounds: Mapping[str, Sequence[float]] = STAGE_BOUNDS,
) -> DataFrame:
    """``metrics.latency_p95`` from minutes; ``now`` and ``window`` must be whole minutes."""
    if now.second or now.microsecond or window % timedelta(minutes=1):
        raise ValueError("minutes hold whole minutes only")
    rows = _parts(spark, path, "minute").filter(_after_until(now - window, now))
    sums = rows.groupBy("stage").agg(*[F.sum(c).alias(c) for c in ("timed", *_BUCKETS)])
    cells = [F.struct(F.lit(bound_text(b)).alias("le"), F.col(c).alias("n")) for b, c in zip(BOUNDS, _BUCKETS, strict=True)]
    cells.append(F.struct(F.lit("+Inf").alias("le"), F.col("timed").alias("n")))
    buckets = sums.select("stage", F.explode(F.array(*cells)).alias("b")).select("stage", "b.*")
    return histogram_quantile(own_buckets(buckets, bounds), ["stage"], 0.95).withColumnRenamed("quantile", "p95_seconds")


def rollup_daily_ingestion(spark: SparkSession, path: str, now: datetime, days: int = 30) -> DataFrame:
    """``metrics.daily_ingestion`` from days: saved and failed ones of stage ``save``, zeros for days without any."""
    first, last = (now - timedelta(days=days - 1)).date(), now.date()
    day = F.to_date("slot")
    saves = _parts(spark, path, "day").filter((F.col("stage") == "save") & day.between(F.lit(first), F.lit(last)))
    counts = saves.groupBy(day.alias("day")).agg(F.sum("good").alias("saved"), F.sum(F.col("events") - F.col("good")).alias("failed"))
    calendar = spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("day"))
    return calendar.join(counts, "day", "left").fillna(0, ["saved", "failed"])


def rollup_ratios(spark: SparkSession, path: str, since: datetime, until: datetime) -> DataFrame:
    """(stage, slot, events, good) per hour of [since, until), which must be whole hours."""
    rows = _parts(spark, path, "hour").filter((F.col("slot") >= F.lit(since)) & (F.col("slot") < F.lit(until)))
    return rows.groupBy("stage", "slot").agg(F.sum("events").alias("events"), F.sum("good").alias("good"))
