"""Alert rules over metric samples.

Samples are (metric, series, tick, value): one row per series and evaluation tick. Windows over them
order the ticks of one series, so their size follows the time span, not the number of events. Changes
are (metric, series, tick, until, value, before): a row where the value changes, and none for quiet ticks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions.time import rfc3339
from storyloom.functions.urls import delivery_error_class
from storyloom.operators.metrics import delivery_ok, fetch_error_type, gauge_changes, window_changes
from storyloom.operators.ordering import along

BLOCK_TICKS = 100_000


@dataclass(frozen=True)
class Rule:
    """``hold``: how long the condition must last before the alert fires."""

    name: str
    metric: str
    operator: str
    threshold: float
    severity: str
    description: str
    hold: timedelta = timedelta(0)
    labels: dict[str, str] = field(default_factory=dict)


# The standard rules.
STANDARD_RULES = (
    Rule("rss_fetch_failure_rate_high", "rate(rss_fetch_errors_total[5m])", "gt", 0.1, "warning",
         "RSS fetch failure rate is too high", timedelta(minutes=2)),
    Rule("circuit_breaker_open", "circuit_breaker_state{open}", "gt", 0.0, "critical",
         "Circuit breaker is open", timedelta(minutes=1)),
    Rule("discord_webhook_failure_rate_high", "rate(discord_webhook_errors_total[5m])", "gt", 0.05, "warning",
         "Discord webhook failure rate is too high", timedelta(minutes=2)),
    Rule("summary_api_failure_rate_high", "rate(summary_api_errors_total[5m])", "gt", 0.1, "warning",
         "Summary API failure rate is too high", timedelta(minutes=2)),
    Rule("database_connection_issues", "database_connections{open}", "lt", 1.0, "critical",
         "Database connection issues detected", timedelta(minutes=1)),
    Rule("high_http_error_rate", "http_error_ratio[5m]", "gt", 0.1, "warning",
         "High HTTP error rate detected", timedelta(minutes=3)),
    Rule("no_new_articles_found", "increase(new_articles_found_total[1h])", "eq", 0.0, "warning",
         "No new articles found in the last hour", timedelta(hours=1)),
    Rule("daily_article_processing_low", "increase(articles_processed_total[1d])", "lt", 5.0, "warning",
         "Daily article processing count is below threshold (less than 5 articles processed in the last day)",
         timedelta(hours=6)),
)
VOLUME_RULES = (
    Rule("DailyArticleProcessingLow", "increase(articles_processed_total[1d])", "lt", 5.0, "warning",
         "Daily article processing count is below threshold", timedelta(hours=6)),
    Rule("NoArticlesProcessedToday", "increase(articles_processed_total[1d])", "eq", 0.0, "critical",
         "No articles processed today", timedelta(hours=3)),
    Rule("ArticleDatabaseGrowthStalled", "increase(articles_processed_total[2d])", "eq", 0.0, "critical",
         "Article database growth has stalled", timedelta(hours=1)),
)
FIRING, RESOLVED = "firing", "resolved"
EMBED_COLORS = {FIRING: 15158332, RESOLVED: 3066993}
ATTACHMENT_COLORS = {FIRING: "danger", RESOLVED: "good"}


def _rule_literal(r: Rule) -> Column:
    values = {
        "rule": r.name,
        "metric": r.metric,
        "operator": r.operator,
        "threshold": float(r.threshold),
        "severity": r.severity,
        "description": r.description,
        "hold_seconds": int(r.hold.total_seconds()),
    }
    parts = [F.lit(v).cast("long") if k == "hold_seconds" else F.lit(v) for k, v in values.items()]
    return F.struct(*[p.alias(k) for k, p in zip(values, parts, strict=True)])


def condition(operator: Column, value: Column, threshold: Column) -> Column:
    """Unknown operators never hold."""
    holds = (
        F.when(operator == "gt", value > threshold)
        .when(operator == "lt", value < threshold)
        .when(operator == "eq", value == threshold)
        .when(operator == "ne", value != threshold)
    )
    return F.coalesce(holds, F.lit(False))


def on_ticks(
    samples: DataFrame, labels: Sequence[str], series: DataFrame, start: datetime, end: datetime, step: timedelta
) -> DataFrame:
    """Fill absent ticks with zero: (labels, tick, increase) for every series and tick of the period."""
    seconds = int(step.total_seconds())
    ticks = F.sequence(F.unix_seconds(F.lit(start)), F.unix_seconds(F.lit(end)), F.lit(seconds).cast("long"))
    grid = series.select(*labels).distinct().withColumn("_at", F.explode(ticks))
    grid = grid.select(*labels, F.timestamp_seconds("_at").alias("tick"))
    filled = grid.join(samples, [*labels, "tick"], "left")
    return filled.select(*labels, "tick", F.coalesce("increase", F.lit(0)).alias("increase"))


def evaluate(samples: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Every sample against every rule of its metric. The rules are configuration and travel as literals."""
    mine = F.filter(F.array(*[_rule_literal(r) for r in rules]), lambda r: r["metric"] == F.col("metric"))
    ruled = samples.withColumn("_rule", F.explode(mine))
    fields = ["rule", "operator", "threshold", "severity", "description", "hold_seconds"]
    return ruled.select(*samples.columns, *[f"_rule.{f}" for f in fields]).withColumn(
        "firing", condition(F.col("operator"), F.col("value"), F.col("threshold"))
    )


def value_changes(
    changes: DataFrame, metric: str, series: Column, value: Callable[[Callable[[str], Column]], Column], step: timedelta
) -> DataFrame:
    """(metric, series, tick, until, value, before) of ``metrics.window_changes`` or ``gauge_changes``.

    ``value`` makes a rule's value of the measures, which it looks up by name; it is NULL where there is none.
    """
    size = int(step.total_seconds())
    return changes.select(
        F.lit(metric).alias("metric"),
        series.alias("series"),
        F.timestamp_seconds(F.col("slot") * size).alias("tick"),
        F.timestamp_seconds(F.col("until") * size).alias("until"),
        value(F.col).cast("double").alias("value"),
        value(lambda name: F.col(f"{name}_before")).cast("double").alias("before"),
    )


def evaluate_changes(changes: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``evaluate`` of values that hold from ``tick`` until the next row, with ``was``: whether the rule held before.

    Rows tell their own past, so that edges need no look at other rows, and quiet ticks need no rows.
    """
    was = condition(F.col("operator"), F.col("before"), F.col("threshold"))
    return evaluate(changes, rules).withColumn("was", was)


def held_changes(evaluated: DataFrame, end: datetime, step: timedelta) -> DataFrame:
    """``held_alerts`` of ``evaluate_changes``: computed between the edges of a series, for ticks up to ``end``."""
    size = int(step.total_seconds())
    # Seconds of edges, in blocks of some ten years of minutes.
    edges = evaluated.filter(F.col("firing") != F.col("was")).withColumn("_at", F.unix_seconds("tick"))
    paired = along(edges, ["rule", "series"], "_at", 60 * BLOCK_TICKS, following="_ends")
    due = F.ceil(F.col("hold_seconds") / size) * size + F.col("_at")
    last = F.coalesce(F.col("_ends") - size, F.unix_seconds(F.lit(end)))
    return paired.filter(F.col("firing") & (due <= last)).select(
        "rule",
        "series",
        "severity",
        F.col("tick").alias("pending_since"),
        F.timestamp_seconds(due).alias("fired_at"),
        F.timestamp_seconds("_ends").alias("ended_at"),
    )


def standard_changes(
    fetch_logs: DataFrame,
    saves: DataFrame,
    summary_logs: DataFrame,
    webhook_logs: DataFrame,
    requests: DataFrame,
    breakers: DataFrame,
    connections: DataFrame,
    period: tuple[datetime, datetime],
    step: timedelta,
) -> DataFrame:
    """The series that ``STANDARD_RULES`` watch, as changes.

    Logs are those of ``metrics.counter_metrics``; ``saves``: created_at, status; ``requests``: created_at,
    status_code; ``breakers``: name, ts, seq, state; ``connections``: ts, seq, value (open connections). A series
    has all labels of its counter, and begins with the period.
    """
    minutes, seconds = timedelta(minutes=5), 300.0

    def events(df: DataFrame, labels: dict[str, Column], when: Column | None = None, **measures: Column) -> DataFrame:
        rows = df if when is None else df.filter(when)
        return rows.select(
            F.col("created_at").alias("ts"),
            *[c.alias(n) for n, c in labels.items()],
            *[c.alias(n) for n, c in measures.items()],
        )

    def counted(df: DataFrame, metric: str, labels: list[str], window: timedelta, value, **measures: Column) -> DataFrame:
        changes = window_changes(df, labels, window, step, measures, df, period)
        return value_changes(changes, metric, F.concat_ws("/", *labels), value, step)

    def rate(get) -> Column:
        return get("n") / F.lit(seconds)

    def increase(get) -> Column:
        return get("n")

    def ratio(get) -> Column:
        return F.when(get("total") > 0, get("bad") / get("total"))

    def gauge(samples: DataFrame, metric: str, labels: list[str]) -> DataFrame:
        changes = gauge_changes(samples, labels, step, period)
        return value_changes(changes, metric, F.concat_ws("/", *labels), lambda get: get("value"), step)

    one = F.lit(1)
    failed = F.col("status") == "error"
    code = F.col("response_code")
    feed = {"feed_url": F.col("feed_url")}
    parts = [
        counted(
            events(fetch_logs, {**feed, "error_type": fetch_error_type(F.col("message"))}, failed),
            "rate(rss_fetch_errors_total[5m])", ["feed_url", "error_type"], minutes, rate, n=one,
        ),
        counted(
            events(webhook_logs, {"error_type": delivery_error_class(code)}, ~delivery_ok(code)),
            "rate(discord_webhook_errors_total[5m])", ["error_type"], minutes, rate, n=one,
        ),
        counted(
            events(summary_logs, {"model": F.col("model")}, F.col("status") == "retry_failed"),
            "rate(summary_api_errors_total[5m])", ["model"], minutes, rate, n=one,
        ),
        counted(
            events(requests, {}, bad=(~F.col("status_code").between(200, 299)).cast("long")),
            "http_error_ratio[5m]", [], minutes, ratio, bad=F.col("bad"), total=one,
        ),
        counted(
            events(fetch_logs, feed, F.col("status") == "success", new=F.col("new_articles")),
            "increase(new_articles_found_total[1h])", ["feed_url"], timedelta(hours=1), increase, n=F.col("new"),
        ),
        counted(
            events(saves, {}, F.col("status") == "processed"),
            "increase(articles_processed_total[1d])", [], timedelta(days=1), increase, n=one,
        ),
        gauge(
            breakers.select("name", "ts", "seq", (F.col("state") == "open").cast("double").alias("value")),
            "circuit_breaker_state{open}", ["name"],
        ),
        gauge(connections, "database_connections{open}", []),
    ]
    return reduce(DataFrame.unionByName, parts)


def _per_series():
    return Window.partitionBy("rule", "series").orderBy("tick")


def transitions(evaluated: DataFrame) -> DataFrame:
    """Edges only: a row when an alert starts firing and a row when it is resolved.

    Rows of ``evaluate_changes`` tell what was before; those of ``evaluate`` are compared with the tick before.
    """
    before = F.coalesce(F.lag("firing").over(_per_series()), F.lit(False))
    before = F.col("was") if "was" in evaluated.columns else before
    return (
        evaluated.withColumn("_before", before)
        .filter(F.col("firing") != F.col("_before"))
        .select(
            "rule",
            "series",
            "severity",
            F.when(F.col("firing"), FIRING).otherwise(RESOLVED).alias("status"),
            "tick",
            "value",
            "threshold",
            "description",
        )
    )


def episodes(evaluated: DataFrame) -> DataFrame:
    """One row per firing period; ``ends_at`` is NULL while it lasts."""
    nxt = F.lead("tick").over(_per_series())
    edges = transitions(evaluated)
    return (
        edges.withColumn("ends_at", nxt)
        .filter(F.col("status") == FIRING)
        .select("rule", "series", "severity", F.col("tick").alias("starts_at"), "ends_at", "value", "threshold")
    )


def held_alerts(evaluated: DataFrame) -> DataFrame:
    """Alerts whose condition held for the rule's ``hold``: when it began, fired and ended."""
    w = _per_series()
    starts = F.when(F.col("firing") & ~F.coalesce(F.lag("firing").over(w), F.lit(False)), F.col("tick"))
    state = evaluated.withColumn("next_tick", F.lead("tick").over(w)).withColumn("_start", starts)
    islands = state.withColumn(
        "pending_since", F.last("_start", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ).filter("firing")
    held = F.unix_seconds("tick") - F.unix_seconds("pending_since")
    due = F.when(held >= F.col("hold_seconds"), F.col("tick"))
    last = F.struct("tick", "next_tick")
    return (
        islands.groupBy("rule", "series", "severity", "pending_since")
        .agg(F.min(due).alias("fired_at"), F.max(last)["next_tick"].alias("ended_at"))
        .filter(F.col("fired_at").isNotNull())
    )


def _field(name_key: str, flag_key: str, name: str, value: Column) -> Column:
    parts = {flag_key: F.lit(True), name_key: F.lit(name), "value": value}
    return F.struct(*[parts[k].alias(k) for k in sorted(parts)])


def _fields(name_key: str, flag_key: str) -> Column:
    values = {
        "Status": F.col("status"),
        "Severity": F.col("severity"),
        "Value": F.format_string("%.2f", F.col("value")),
        "Threshold": F.format_string("%.2f", F.col("threshold")),
    }
    return F.array(*[_field(name_key, flag_key, n, v) for n, v in values.items()])


def _by_status(values: dict) -> Column:
    return F.when(F.col("status") == RESOLVED, values[RESOLVED]).otherwise(values[FIRING])


def alert_payloads(alerts: DataFrame) -> DataFrame:
    """Both message formats per alert edge. ``alerts``: rule, status, severity, description, value,
    threshold, starts_at."""
    title = F.concat(F.lit("Alert: "), F.col("rule"))
    embed = F.struct(
        _by_status(EMBED_COLORS).alias("color"),
        F.col("description").alias("description"),
        _fields("name", "inline").alias("fields"),
        rfc3339(F.col("starts_at")).alias("timestamp"),
        title.alias("title"),
    )
    attachment = F.struct(
        _by_status(ATTACHMENT_COLORS).alias("color"),
        _fields("title", "short").alias("fields"),
        F.col("description").alias("text"),
        title.alias("title"),
        F.unix_seconds("starts_at").alias("ts"),
    )
    return alerts.select(
        "*",
        F.to_json(F.struct(F.array(embed).alias("embeds"))).alias("embed_payload"),
        F.to_json(F.struct(F.array(attachment).alias("attachments"))).alias("attachment_payload"),
    )


def edges_with_start(evaluated: DataFrame) -> DataFrame:
    """Alert edges where a resolved row carries the start time and value of the alert it ends."""
    w = _per_series()
    fired = F.col("status") == FIRING
    edges = transitions(evaluated)
    return edges.withColumn("starts_at", F.when(fired, F.col("tick")).otherwise(F.lag("tick").over(w))).withColumn(
        "value", F.when(fired, F.col("value")).otherwise(F.lag("value").over(w))
    )
