"""Counters, histograms, gauges, rates and ratios over event logs.

Logs keep every event, so an increase is a filtered count and needs no reset handling.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions.urls import delivery_error_class
from storyloom.operators.ordering import along

# Histogram bounds in seconds, service-level targets, fetch error types by message start.
DEFAULT_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
SUMMARY_BOUNDS = (0.1, 0.5, 1.0, 2.5, 5.0, 10.0, 15.0, 30.0, 60.0)
WEBHOOK_BOUNDS = (0.01, 0.05, 0.1, 0.5, 1.0, 2.5, 5.0, 10.0)
PROCESSING_BOUNDS = (0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0, 120.0, 300.0)
STAGE_BOUNDS = {"fetch": DEFAULT_BOUNDS, "summary": SUMMARY_BOUNDS, "delivery": WEBHOOK_BOUNDS}
SUCCESS_TARGETS = {"fetch": 0.97, "save": 0.98, "delivery": 0.99, "summary": 0.99}
FETCH_ERROR_TYPES = {
    "Circuit breaker is open": "circuit_breaker_open",
    "Failed to create request": "request_creation_failed",
    "Failed to fetch feed": "http_request_failed",
    "HTTP ": "http_error",
    "Failed to parse feed": "parse_failed",
    "FlareSolverr: ": "flaresolverr_failed",
}


BREAKER_OPEN, MAX_RETRIES = "circuit_breaker_open", "max_retries_exceeded"


def fetch_error_type(message: Column) -> Column:
    """Error type of a failed fetch, by how its log message starts."""
    kind = F.lit("unknown")
    for start, name in FETCH_ERROR_TYPES.items():
        kind = F.when(F.startswith(message, F.lit(start)), name).otherwise(kind)
    return kind


def delivery_ok(code: Column) -> Column:
    return F.coalesce(code.between(200, 299), F.lit(False))


# -- event streams ------------------------------------------------------


def fetch_events(fetch_logs: DataFrame) -> DataFrame:
    return fetch_logs.select(
        F.col("created_at").alias("ts"),
        F.lit("fetch").alias("stage"),
        (F.col("status") == "success").alias("ok"),
        (F.col("duration_ms") / 1000).alias("seconds"),
    )


def summary_events(summary_logs: DataFrame) -> DataFrame:
    return summary_logs.select(
        F.col("created_at").alias("ts"),
        F.lit("summary").alias("stage"),
        (F.col("status") == "success").alias("ok"),
        (F.col("duration_ms") / 1000).alias("seconds"),
    )


def delivery_events(webhook_logs: DataFrame) -> DataFrame:
    return webhook_logs.select(
        F.col("created_at").alias("ts"),
        F.lit("delivery").alias("stage"),
        delivery_ok(F.col("response_code")).alias("ok"),
        (F.col("latency_ms") / 1000).alias("seconds"),
    )


def save_events(save_logs: DataFrame) -> DataFrame:
    """``save_logs``: created_at, status (processed or save_failed)."""
    return save_logs.select(
        F.col("created_at").alias("ts"),
        F.lit("save").alias("stage"),
        (F.col("status") == "processed").alias("ok"),
        F.lit(None).cast("double").alias("seconds"),
    )


# -- counters -----------------------------------------------------------


def _family(metric: str, labels: dict[str, Column], when: Column | bool = True, amount: str = "n") -> Column:
    """One counter family over a table of tallies: which rows feed it, under which labels."""
    pairs = [*labels.items(), ("", F.lit("")), ("", F.lit(""))][:2]
    parts = [F.lit(metric).alias("metric")]
    for i, (name, value) in enumerate(pairs, 1):
        parts += [F.lit(name).alias(f"label_{i}"), value.cast("string").alias(f"value_{i}")]
    row = F.struct(*parts, F.col(amount).cast("double").alias("amount"))
    return F.when(F.lit(when) if isinstance(when, bool) else when, row)


def _spread(tallies: DataFrame, families: Sequence[Column]) -> DataFrame:
    rows = F.filter(F.array(*families), lambda f: f.isNotNull())
    return tallies.select(F.explode(rows).alias("f")).select("f.*")


def counter_metrics(
    fetch_logs: DataFrame,
    admission: DataFrame,
    summary_logs: DataFrame,
    webhook_logs: DataFrame,
    max_attempts: int = 3,
) -> DataFrame:
    """(metric, label_1, value_1, label_2, value_2, total): every counter family as event tallies.

    Each log is read once and reduced to its label values; the families are cut from those tallies.
    ``admission``: items with their status. A delivery whose attempt ``max_attempts`` fails is given up.
    """
    feed, status, model = F.col("feed_url"), F.col("status"), F.col("model")
    # The log knows an open breaker as an error; the counter has a status of its own for it.
    rejected = F.coalesce(F.col("error_type") == BREAKER_OPEN, F.lit(False))
    fetch_status = F.when(rejected, BREAKER_OPEN).otherwise(status)
    n = F.count(F.lit(1)).alias("n")
    fetches = fetch_logs.groupBy(
        "feed_url", "status", F.when(status == "error", fetch_error_type(F.col("message"))).alias("error_type")
    ).agg(n, F.sum("new_articles").alias("fresh"))
    outcome = F.when(status == "success", "success").otherwise("error")
    saved = status.isin("processed", "save_failed")
    gave_up = (F.col("attempt") == max_attempts) & ~delivery_ok(F.col("response_code"))
    delivered = webhook_logs.groupBy(
        delivery_ok(F.col("response_code")).alias("ok"), delivery_error_class(F.col("response_code")).alias("error_type")
    ).agg(n, F.count_if(gave_up).alias("gave_up"))
    parts = [
        _spread(
            fetches,
            [
                _family("rss_fetch_total", {"feed_url": feed, "status": fetch_status}),
                _family(
                    "rss_fetch_errors_total", {"feed_url": feed, "error_type": F.col("error_type")}, status == "error"
                ),
                _family("new_articles_found_total", {"feed_url": feed}, status == "success", "fresh"),
            ],
        ),
        _spread(
            admission.groupBy("feed_url", "status").agg(n),
            [
                _family("articles_processed_by_feed_total", {"feed_url": feed, "status": status}),
                _family(
                    "articles_filtered_pre_cutoff_total", {"feed_url": feed}, status == "skipped_before_cutoff"
                ),
                _family(
                    "articles_processed_post_cutoff_total", {"feed_url": feed}, saved | (status == "skipped_duplicate")
                ),
                _family(
                    "articles_processed_total",
                    {"status": F.when(status == "processed", "success").otherwise("failed")},
                    saved,
                ),
            ],
        ),
        _spread(
            summary_logs.groupBy("model", "status").agg(n),
            [
                _family("summary_api_requests_total", {"model": model, "status": outcome}, status != "failed"),
                _family(
                    "summary_api_errors_total",
                    {"model": model, "error_type": F.lit("api_call_failed")},
                    status == "retry_failed",
                ),
                _family(
                    "summarization_requests_processed_total",
                    {"model": model, "status": outcome},
                    status != "retry_failed",
                ),
            ],
        ),
        _spread(
            delivered,
            [
                _family("discord_webhook_requests_total", {"status": F.when(F.col("ok"), "success").otherwise("error")}),
                _family("discord_webhook_errors_total", {"error_type": F.col("error_type")}, ~F.col("ok")),
                _family(
                    "discord_webhook_errors_total", {"error_type": F.lit(MAX_RETRIES)}, F.col("gave_up") > 0, "gave_up"
                ),
            ],
        ),
    ]
    labels = ["metric", "label_1", "value_1", "label_2", "value_2"]
    return reduce(DataFrame.unionByName, parts).groupBy(*labels).agg(F.sum("amount").alias("total"))


def breaker_trip_counts(replay: DataFrame) -> DataFrame:
    """Trips per breaker from a breaker replay."""
    return replay.groupBy("name").agg(F.count_if("trip").alias("trips"))


# -- histograms and gauges ----------------------------------------------


def bound_text(bound: float) -> str:
    return f"{bound:g}"


def latency_histogram(df: DataFrame, seconds: Column, labels: Sequence[str], bounds: Sequence[float]) -> DataFrame:
    """Cumulative buckets per label set: (labels, le, n), upper bounds inclusive, ``+Inf`` last.

    One aggregate reads each row once; buckets are unpivoted afterwards.
    """
    counts = [F.count_if(seconds <= F.lit(b)).alias(f"_b{i}") for i, b in enumerate(bounds)]
    wide = df.groupBy(*labels).agg(*counts, F.count(seconds).alias("_inf"))
    names = [*map(bound_text, bounds), "+Inf"]
    cells = [*(f"_b{i}" for i in range(len(bounds))), "_inf"]
    buckets = F.array(
        *[F.struct(F.lit(le).alias("le"), F.col(c).alias("n")) for le, c in zip(names, cells, strict=True)]
    )
    return wide.select(*labels, F.explode(buckets).alias("_b")).select(*labels, "_b.le", "_b.n")


def histogram_totals(df: DataFrame, millis: str, labels: Sequence[str]) -> DataFrame:
    """Number and exact sum of the observations per label set."""
    return df.groupBy(*labels).agg(F.count(millis).alias("observations"), F.sum(millis).alias("total_ms"))


def histogram_quantile(buckets: DataFrame, labels: Sequence[str], q: float) -> DataFrame:
    """Quantile by linear interpolation inside its bucket; the last finite bound caps it."""
    le = F.when(F.col("le") == "+Inf", F.lit(float("inf"))).otherwise(F.col("le").cast("double"))
    w = Window.partitionBy(*labels).orderBy("_bound")  # one row per bucket
    rows = (
        buckets.select(*labels, le.alias("_bound"), F.col("n").alias("_n"))
        .withColumn("_prev_bound", F.coalesce(F.lag("_bound").over(w), F.lit(0.0)))
        .withColumn("_prev_n", F.coalesce(F.lag("_n").over(w), F.lit(0)))
        .withColumn("_total", F.max("_n").over(Window.partitionBy(*labels)))
        .withColumn("_rank", F.col("_total") * F.lit(q))
        .filter((F.col("_n") >= F.col("_rank")) & (F.col("_total") > 0))
    )
    inside = F.col("_prev_bound") + (F.col("_bound") - F.col("_prev_bound")) * (
        (F.col("_rank") - F.col("_prev_n")) / F.nullif(F.col("_n") - F.col("_prev_n"), F.lit(0))
    )
    value = F.when(F.col("_bound") == float("inf"), F.col("_prev_bound")).otherwise(
        F.coalesce(inside, F.col("_bound"))
    )
    return rows.groupBy(*labels).agg(F.min_by(value, "_bound").alias("quantile"))


def own_buckets(buckets: DataFrame, bounds: Mapping[str, Sequence[float]]) -> DataFrame:
    """Of each stage's buckets (stage, le, n), those of its own histogram."""
    own = [(F.col("stage") == s) & F.col("le").isin([*map(bound_text, bs), "+Inf"]) for s, bs in bounds.items()]
    return buckets.filter(reduce(Column.__or__, own))


def latency_p95(
    events: DataFrame,
    now: datetime,
    window: timedelta,
    bounds: Mapping[str, Sequence[float]] = STAGE_BOUNDS,
) -> DataFrame:
    """95th percentile per stage over the trailing window, from the buckets of each stage's own histogram."""
    recent = _trailing(events, now, window)
    every = sorted({b for own in bounds.values() for b in own})
    buckets = latency_histogram(recent, F.col("seconds"), ["stage"], every)
    return histogram_quantile(own_buckets(buckets, bounds), ["stage"], 0.95).withColumnRenamed("quantile", "p95_seconds")


def gauges(samples: DataFrame, series: Sequence[str]) -> DataFrame:
    """Last value per series. ``samples``: series columns, ts, seq (breaks ties), value."""
    at = F.struct("ts", "seq")
    return samples.groupBy(*series).agg(
        F.max_by("value", at).alias("value"), F.max("ts").alias("ts")
    )


# -- increases, rates, ratios -------------------------------------------


def _trailing(events: DataFrame, now: datetime, window: timedelta) -> DataFrame:
    return events.filter((F.col("ts") > F.lit(now - window)) & (F.col("ts") <= F.lit(now)))


def increase(
    events: DataFrame, labels: Sequence[str], now: datetime, window: timedelta, amount: Column | None = None
) -> DataFrame:
    """Growth per series over the window that ends at ``now``."""
    value = F.count(F.lit(1)) if amount is None else F.coalesce(F.sum(amount), F.lit(0))
    return _trailing(events, now, window).groupBy(*labels).agg(value.cast("long").alias("increase"))


def rate(
    events: DataFrame, labels: Sequence[str], now: datetime, window: timedelta = timedelta(minutes=5)
) -> DataFrame:
    """Events per second over the trailing window."""
    grown = increase(events, labels, now, window)
    return grown.select(*labels, (F.col("increase") / F.lit(float(window.total_seconds()))).alias("rate"))


# Steps of a series that are summed in one window.
BLOCK_STEPS = 100_000


def _slot_of(at: datetime, step: timedelta) -> int:
    seconds, size = at.timestamp(), step.total_seconds()
    if seconds % size:
        raise ValueError("a period begins and ends at whole steps")
    return int(seconds / size)


def window_changes(
    events: DataFrame,
    labels: Sequence[str],
    window: timedelta,
    step: timedelta,
    measures: Mapping[str, Column],
    series: DataFrame | None = None,
    period: tuple[datetime, datetime] | None = None,
) -> DataFrame:
    """Where trailing sums change: (labels, slot, until, events, each measure, and each with ``_before``).

    A row holds the sums over the ``window`` before every tick from ``slot`` to before ``until`` (in steps since
    the epoch; NULL: for good), and what they were before. Events are summed per step; a step adds its sums when it
    enters the window and takes them back when it leaves, so there are two rows a step at most, however long the
    window is. ``window`` is a whole number of steps; a tick covers (tick - window, tick].

    With ``series`` (the labels of all series) and ``period`` (first and last tick) there is a row at the first tick
    for every series, before which nothing is known, and ``until`` is NULL beyond the last tick.
    """
    size, n = int(step.total_seconds()), int(window / step)
    slot = F.ceil(F.unix_micros("ts") / F.lit(size * 1_000_000)).cast("long")
    names = ["events", *measures]
    sums = [F.coalesce(F.sum(m), F.lit(0)).cast("long").alias(name) for name, m in measures.items()]
    steps = events.groupBy(*labels, slot.alias("slot")).agg(F.count(F.lit(1)).alias("events"), *sums)
    enter = F.struct("slot", *names)
    leave = F.struct((F.col("slot") + n).alias("slot"), *[(-F.col(c)).alias(c) for c in names])
    deltas = steps.select(*labels, F.explode(F.array(enter, leave)).alias("_d")).select(*labels, "_d.*")
    if period is not None:
        first, last = _slot_of(period[0], step), _slot_of(period[1], step)
        begin = (series.select(*labels).distinct() if labels else series.limit(1)).select(
            *labels, F.lit(first).cast("long").alias("slot"), *[F.lit(0).cast("long").alias(c) for c in names]
        )
        deltas = deltas.unionByName(begin)
    deltas = deltas.groupBy(*labels, "slot").agg(*[F.sum(c).alias(f"_d_{c}") for c in names])
    held = along(deltas, labels, "slot", BLOCK_STEPS, sums={c: f"_d_{c}" for c in names}, following="until")
    before = {c: F.col(c) - F.col(f"_d_{c}") for c in names}
    if period is not None:
        held = held.filter(F.col("slot").between(first, last)).withColumn(
            "until", F.when(F.col("until") <= last, F.col("until"))
        )
        before = {c: F.when(F.col("slot") > first, v) for c, v in before.items()}
    return held.select(*labels, "slot", "until", *names, *[v.alias(f"{c}_before") for c, v in before.items()])


def gauge_changes(
    samples: DataFrame, labels: Sequence[str], step: timedelta, period: tuple[datetime, datetime]
) -> DataFrame:
    """(labels, slot, until, value, value_before): the last sample at every tick of the period, as ``window_changes``.

    ``samples``: labels, ts, seq (breaks ties), value. A series begins with its first sample.
    """
    size = int(step.total_seconds())
    first, last = _slot_of(period[0], step), _slot_of(period[1], step)
    slot = F.greatest(F.ceil(F.unix_micros("ts") / F.lit(size * 1_000_000)).cast("long"), F.lit(first))
    per_slot = samples.withColumn("slot", slot).filter(F.col("slot") <= last)
    per_slot = per_slot.groupBy(*labels, "slot").agg(F.max_by("value", F.struct("ts", "seq")).alias("value"))
    return along(per_slot, labels, "slot", BLOCK_STEPS, previous={"value_before": "value"}, following="until")


def sliding_increase(
    events: DataFrame,
    labels: Sequence[str],
    window: timedelta,
    step: timedelta,
    amount: Column | None = None,
) -> DataFrame:
    """(labels, tick, increase) at every ``step``, over the ``window`` before the tick.

    The ticks between two changes are listed last of all. ``window`` is a whole number of steps. Ticks without
    events in their window are absent.
    """
    size = int(step.total_seconds())
    changes = window_changes(events, labels, window, step, {"increase": F.lit(1) if amount is None else amount})
    ticks = F.explode(F.sequence("slot", F.col("until") - 1)).alias("_at")
    listed = changes.filter("events > 0").select(*labels, ticks, "increase")
    return listed.select(*labels, F.timestamp_seconds(F.col("_at") * size).alias("tick"), "increase")


def success_ratio(events: DataFrame) -> DataFrame:
    """Share of successes per stage against its target."""
    targets = F.create_map(*[F.lit(x) for kv in SUCCESS_TARGETS.items() for x in kv])
    return (
        events.groupBy("stage")
        .agg(F.count(F.lit(1)).alias("total"), F.count_if("ok").alias("good"))
        .withColumn("ratio", F.col("good") / F.nullif("total", F.lit(0)))
        .withColumn("target", F.try_element_at(targets, F.col("stage")))
        .withColumn("meets_target", F.col("ratio") >= F.col("target"))
    )


def feeds_erroring(fetch_logs: DataFrame, since: datetime, until: datetime) -> DataFrame:
    at = F.col("created_at")
    return fetch_logs.filter(
        (F.col("status") == "error") & (at > F.lit(since)) & (at <= F.lit(until))
    ).agg(F.countDistinct("feed_url").alias("feeds_erroring"))


def top_feeds_by_errors(fetch_logs: DataFrame, top: int) -> DataFrame:
    return (
        fetch_logs.filter(F.col("status") == "error")
        .groupBy("feed_url", fetch_error_type(F.col("message")).alias("error_type"))
        .agg(F.count(F.lit(1)).alias("errors"))
        .orderBy(F.col("errors").desc_nulls_last(), F.col("feed_url").asc_nulls_last(), "error_type")
        .limit(top)
    )


def _minute(c: str) -> Column:
    return F.date_trunc("minute", F.col(c))


def funnel_per_minute(
    fetch_logs: DataFrame, articles: DataFrame, summary_logs: DataFrame, webhook_logs: DataFrame
) -> DataFrame:
    """Per minute: items fetched, new, saved, summarized, delivered.

    Each log is reduced to minutes before the union, so the union holds minutes, not events.
    """
    stages = ("fetched", "new_found", "saved", "summarized", "delivered")

    def part(df: DataFrame, at: str, values: dict[str, Column]) -> DataFrame:
        aggs = [F.coalesce(values.get(s, F.lit(0)), F.lit(0)).cast("long").alias(s) for s in stages if s in values]
        per_minute = df.groupBy(_minute(at).alias("minute")).agg(*aggs)
        return per_minute.select(
            "minute", *[F.col(s) if s in values else F.lit(0).cast("long").alias(s) for s in stages]
        )

    parts = [
        part(fetch_logs, "created_at", {"fetched": F.sum("articles_found"), "new_found": F.sum("new_articles")}),
        part(articles, "created_at", {"saved": F.count(F.lit(1))}),
        part(summary_logs, "created_at", {"summarized": F.count_if(F.col("status") == "success")}),
        part(webhook_logs, "created_at", {"delivered": F.count_if(delivery_ok(F.col("response_code")))}),
    ]
    union = reduce(DataFrame.unionByName, parts)
    return union.groupBy("minute").agg(*[F.sum(s).alias(s) for s in stages])


def error_rate_by_type(
    fetch_logs: DataFrame, summary_logs: DataFrame, webhook_logs: DataFrame, save_logs: DataFrame, bucket: str = "hour"
) -> DataFrame:
    """(bucket, source, error_type, errors) over every failure mode."""
    code = F.col("response_code")

    def part(df: DataFrame, source: str, kind: Column) -> DataFrame:
        return (
            df.groupBy(F.date_trunc(bucket, F.col("created_at")).alias("bucket"), kind.alias("error_type"))
            .agg(F.count(F.lit(1)).alias("errors"))
            .select("bucket", F.lit(source).alias("source"), "error_type", "errors")
        )

    return reduce(
        DataFrame.unionByName,
        [
            part(fetch_logs.filter(F.col("status") == "error"), "fetch", fetch_error_type(F.col("message"))),
            part(summary_logs.filter(F.col("status") == "retry_failed"), "summary", F.lit("api_call_failed")),
            part(webhook_logs.filter(~delivery_ok(code)), "delivery", delivery_error_class(code)),
            part(save_logs.filter(F.col("status") == "save_failed"), "save", F.lit("save_failed")),
        ],
    )


def daily_ingestion(save_logs: DataFrame, now: datetime, days: int = 30) -> DataFrame:
    """Saved and failed per day for the last ``days`` days; days without events show zeros."""
    spark = save_logs.sparkSession
    first, last = (now - timedelta(days=days - 1)).date(), now.date()
    calendar = spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("day"))
    day = F.to_date("created_at")
    counts = (
        save_logs.filter(day.between(F.lit(first), F.lit(last)))
        .groupBy(day.alias("day"))
        .agg(
            F.count_if(F.col("status") == "processed").alias("saved"),
            F.count_if(F.col("status") == "save_failed").alias("failed"),
        )
    )
    return calendar.join(counts, "day", "left").fillna(0, ["saved", "failed"])
