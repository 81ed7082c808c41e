"""Counters, rates, histograms, alerts and breaker replays over the logs."""

from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from storyloom.operators import admission, alerts, breaker, metrics, stats
from storyloom.plans import derived as d
from storyloom.plans.registry import query

L = "TIMESTAMP '2024-01-31 00:00:00'"
A = "TIMESTAMP '2025-07-15 14:30:00'"
DAY = timedelta(days=1)
OK_CODE = "coalesce(response_code BETWEEN 200 AND 299, false)"

EVENTS_SQL = f"""SELECT created_at AS ts, 'fetch' AS stage, status = 'success' AS ok, duration_ms / 1000 AS seconds
      FROM fetch_logs
    UNION ALL SELECT created_at, 'summary', status = 'success', duration_ms / 1000 FROM summary_logs
    UNION ALL SELECT created_at, 'delivery', {OK_CODE}, latency_ms / 1000 FROM webhook_logs
    UNION ALL SELECT created_at, 'save', status = 'processed', NULL FROM save_logs"""


def stage_events(spark, sf):
    return (
        metrics.fetch_events(d.fetch_logs(spark, sf))
        .unionByName(metrics.summary_events(d.summary_logs(spark, sf)))
        .unionByName(metrics.delivery_events(d.webhook_logs(spark, sf)))
        .unionByName(metrics.save_events(d.save_logs(spark, sf)))
    )


def _family_sql(metric: str, labels: dict[str, str], source: str, where: str = "true", amount: str = "count(*)") -> str:
    keys = list(labels)
    cols = []
    for i in range(2):
        name, value = (keys[i], labels[keys[i]]) if i < len(keys) else ("", "''")
        cols += [f"'{name}' AS label_{i + 1}", f"{value} AS value_{i + 1}"]
    return f"SELECT '{metric}' AS metric, {', '.join(cols)}, {amount}::DOUBLE AS total FROM {source} WHERE {where} GROUP BY ALL"


_STATUS2 = "CASE WHEN status = 'success' THEN 'success' ELSE 'error' END"
_CLASS = (
    "CASE WHEN response_code IS NULL THEN 'network_error' WHEN response_code BETWEEN 400 AND 499 THEN 'client_error' "
    "ELSE 'server_error' END"
)
COUNTERS_SQL = " UNION ALL ".join(
    [
        _family_sql(
            "rss_fetch_total",
            {"feed_url": "feed_url", "status": "CASE message WHEN 'Circuit breaker is open' THEN 'circuit_breaker_open' ELSE status END"},
            "fetch_logs",
        ),
        _family_sql(
            "rss_fetch_errors_total", {"feed_url": "feed_url", "error_type": "error_type"}, "failed_fetches",
        ),
        _family_sql(
            "new_articles_found_total", {"feed_url": "feed_url"}, "fetch_logs", "status = 'success'",
            "sum(new_articles)",
        ),
        _family_sql("articles_processed_by_feed_total", {"feed_url": "feed_url", "status": "status"}, "admission"),
        _family_sql(
            "articles_filtered_pre_cutoff_total", {"feed_url": "feed_url"}, "admission",
            "status = 'skipped_before_cutoff'",
        ),
        _family_sql(
            "articles_processed_post_cutoff_total", {"feed_url": "feed_url"}, "admission",
            "status IN ('skipped_duplicate', 'processed')",
        ),
        _family_sql("articles_processed_total", {"status": "'success'"}, "admission", "status = 'processed'"),
        _family_sql(
            "summary_api_requests_total", {"model": "model", "status": _STATUS2}, "summary_logs", "status <> 'failed'"
        ),
        _family_sql(
            "summary_api_errors_total", {"model": "model", "error_type": "'api_call_failed'"}, "summary_logs",
            "status = 'retry_failed'",
        ),
        _family_sql(
            "summarization_requests_processed_total", {"model": "model", "status": _STATUS2}, "summary_logs",
            "status <> 'retry_failed'",
        ),
        _family_sql(
            "discord_webhook_requests_total", {"status": f"CASE WHEN {OK_CODE} THEN 'success' ELSE 'error' END"},
            "webhook_logs",
        ),
        _family_sql("discord_webhook_errors_total", {"error_type": _CLASS}, "webhook_logs", f"NOT {OK_CODE}"),
        _family_sql(
            "discord_webhook_errors_total", {"error_type": "'max_retries_exceeded'"}, "webhook_logs",
            f"NOT {OK_CODE} AND attempt = 3",
        ),
    ]
)


@query("counter_metrics", COUNTERS_SQL)
def _(spark, sf):
    statuses = admission.admission_status(d.items(spark, sf), d.stored_articles(spark, sf), d.CUTOFF, d.INITIATION)
    return metrics.counter_metrics(
        d.fetch_logs(spark, sf), statuses, d.summary_logs(spark, sf), d.webhook_logs(spark, sf)
    )


def _histogram_sql(source: str, seconds: str, labels: str, bounds) -> str:
    names = [f"{b:g}" for b in bounds]
    les = ", ".join(f"('{n}', {b}::DOUBLE)" for n, b in zip(names, bounds, strict=True))
    return f"""SELECT {labels}, le, count({seconds}) FILTER (WHERE {seconds} <= bound) AS n
        FROM {source}, (VALUES {les}, ('+Inf', 'infinity'::DOUBLE)) AS b(le, bound) GROUP BY ALL"""


@query(
    "latency_histogram",
    _histogram_sql("fetch_logs", "(duration_ms / 1000)", "feed_url, status", metrics.DEFAULT_BOUNDS),
)
def _(spark, sf):
    logs = d.fetch_logs(spark, sf)
    return metrics.latency_histogram(logs, F.col("duration_ms") / 1000, ["feed_url", "status"], metrics.DEFAULT_BOUNDS)


@query(
    "latency_histogram_summary",
    _histogram_sql("summary_logs", "(duration_ms / 1000)", "model, status", metrics.SUMMARY_BOUNDS),
)
def _(spark, sf):
    logs = d.summary_logs(spark, sf)
    return metrics.latency_histogram(logs, F.col("duration_ms") / 1000, ["model", "status"], metrics.SUMMARY_BOUNDS)


@query(
    "latency_histogram_delivery",
    _histogram_sql(
        f"(SELECT latency_ms, CASE WHEN {OK_CODE} THEN 'success' ELSE 'error' END AS status FROM webhook_logs)",
        "(latency_ms / 1000)", "status", metrics.WEBHOOK_BOUNDS,
    ),
)
def _(spark, sf):
    status = F.when(metrics.delivery_ok(F.col("response_code")), "success").otherwise("error")
    logs = d.webhook_logs(spark, sf).withColumn("status", status)
    return metrics.latency_histogram(logs, F.col("latency_ms") / 1000, ["status"], metrics.WEBHOOK_BOUNDS)


@query(
    "latency_histogram_processing",
    _histogram_sql(
        f"(SELECT model, duration_ms, {_STATUS2} AS status FROM summary_logs WHERE status <> 'retry_failed')",
        "(duration_ms / 1000)", "model, status", metrics.PROCESSING_BOUNDS,
    ),
)
def _(spark, sf):
    status = F.when(F.col("status") == "success", "success").otherwise("error")
    logs = d.summary_logs(spark, sf).filter(F.col("status") != "retry_failed").withColumn("status", status)
    return metrics.latency_histogram(logs, F.col("duration_ms") / 1000, ["model", "status"], metrics.PROCESSING_BOUNDS)


@query(
    "histogram_totals",
    """SELECT feed_url, status, count(duration_ms) AS observations, sum(duration_ms)::BIGINT AS total_ms
       FROM fetch_logs GROUP BY 1, 2""",
)
def _(spark, sf):
    return metrics.histogram_totals(d.fetch_logs(spark, sf), "duration_ms", ["feed_url", "status"])


@query(
    "gauges",
    """SELECT event_type, arg_max(value, (ts, event_id)) AS value, max(ts) AS ts FROM events GROUP BY 1""",
)
def _(spark, sf):
    samples = d.base(spark, sf, "events").select("event_type", "ts", F.col("event_id").alias("seq"), "value")
    return metrics.gauges(samples, ["event_type"])


def _feed_events(spark, sf):
    return d.fetch_logs(spark, sf).select("feed_url", F.col("created_at").alias("ts"), "status", "new_articles")


@query(
    "increase",
    f"""SELECT feed_url, status, count(*) AS increase FROM fetch_logs
        WHERE created_at > {L} - INTERVAL 1 DAY AND created_at <= {L} GROUP BY 1, 2""",
)
def _(spark, sf):
    return metrics.increase(_feed_events(spark, sf), ["feed_url", "status"], d.LOG_NOW, DAY)


@query(
    "increase_amount",
    f"""SELECT feed_url, sum(new_articles)::BIGINT AS increase FROM fetch_logs
        WHERE created_at > {L} - INTERVAL 7 DAY AND created_at <= {L} GROUP BY 1""",
)
def _(spark, sf):
    return metrics.increase(_feed_events(spark, sf), ["feed_url"], d.LOG_NOW, 7 * DAY, F.col("new_articles"))


@query(
    "rate",
    """WITH last AS (SELECT max(created_at) AS t FROM fetch_logs)
       SELECT status, count(*) / 300.0::DOUBLE AS rate FROM fetch_logs, last
       WHERE created_at > t - INTERVAL 5 MINUTE AND created_at <= t GROUP BY 1""",
)
def _(spark, sf):
    events = _feed_events(spark, sf)
    now = events.agg(F.max("ts")).first()[0]  # the five minutes before the last fetch
    return metrics.rate(events, ["status"], now.astimezone(timezone.utc))


SLIDING_SQL = """SELECT {labels}, t AS tick, count(*) AS increase FROM {source} JOIN
    (SELECT unnest(generate_series({start}, {end}, INTERVAL {step})) AS t) ON ts > t - INTERVAL {size} AND ts <= t
    GROUP BY ALL"""


@query(
    "sliding_increase",
    SLIDING_SQL.format(
        labels="status", source="(SELECT status, created_at AS ts FROM fetch_logs)",
        start="TIMESTAMP '2023-12-30'", end="TIMESTAMP '2024-02-03'", step="1 HOUR", size="1 DAY",
    ),
)
def _(spark, sf):
    return metrics.sliding_increase(_feed_events(spark, sf), ["status"], DAY, timedelta(hours=1))


@query(
    "increase_changes",
    """WITH ev AS (SELECT status, created_at AS ts, new_articles AS v,
           make_timestamp((ceil(epoch_us(created_at) / 30e6) * 30000000)::BIGINT) AS t FROM fetch_logs),
         ticks AS (SELECT DISTINCT status, t FROM ev UNION SELECT status, t + INTERVAL 7 DAY FROM ev)
       SELECT k.status, k.t AS tick, lead(k.t) OVER (PARTITION BY k.status ORDER BY k.t) AS until,
         count(ts) AS events, coalesce(sum(v), 0)::BIGINT AS increase
       FROM ticks k LEFT JOIN ev ON ev.status = k.status AND ts > k.t - INTERVAL 7 DAY AND ts <= k.t GROUP BY 1, 2""",
)
def _(spark, sf):
    # Seven days at every half minute: 20 160 ticks a window.
    amount = {"increase": F.col("new_articles")}
    step = timedelta(seconds=30)
    changes = metrics.window_changes(_feed_events(spark, sf), ["status"], 7 * DAY, step, amount)
    at = {c: F.timestamp_seconds(F.col(c) * 30) for c in ("slot", "until")}
    return changes.select("status", at["slot"].alias("tick"), at["until"].alias("until"), "events", "increase")


@query(
    "success_ratio",
    f"""SELECT stage, count(*) AS total, count(*) FILTER (WHERE ok) AS good, count(*) FILTER (WHERE ok) / count(*) AS ratio,
          CASE stage WHEN 'fetch' THEN 0.97::DOUBLE WHEN 'save' THEN 0.98::DOUBLE ELSE 0.99::DOUBLE END AS target,
          count(*) FILTER (WHERE ok) / count(*) >= CASE stage WHEN 'fetch' THEN 0.97::DOUBLE WHEN 'save'
            THEN 0.98::DOUBLE ELSE 0.99::DOUBLE END AS meets_target
        FROM ({EVENTS_SQL}) GROUP BY 1""",
)
def _(spark, sf):
    return metrics.success_ratio(stage_events(spark, sf))


P95_SQL = f"""WITH ev AS (SELECT * FROM ({EVENTS_SQL}) WHERE ts > {L} - INTERVAL 1 DAY AND ts <= {L}
      AND seconds IS NOT NULL),
    bounds AS ({' UNION ALL '.join(f"SELECT '{s}' AS stage, unnest([{', '.join(map(str, b))}]::DOUBLE[]) AS b"
                                   for s, b in metrics.STAGE_BOUNDS.items())}),
    cum AS (SELECT stage, b, count(*) FILTER (WHERE seconds <= b) AS n, count(*) AS total
      FROM ev JOIN bounds USING (stage) GROUP BY 1, 2),
    steps AS (SELECT stage, b, n, total * 0.95::DOUBLE AS want, lag(b, 1, 0) OVER w AS pb, lag(n, 1, 0) OVER w AS pn
      FROM cum WINDOW w AS (PARTITION BY stage ORDER BY b))
    SELECT stage, coalesce(arg_min(pb + (b - pb) * ((want - pn) / (n - pn)), b) FILTER (WHERE n >= want), max(b))
      AS p95_seconds FROM steps GROUP BY 1"""


@query("latency_p95", P95_SQL)
def _(spark, sf):
    return metrics.latency_p95(stage_events(spark, sf), d.LOG_NOW, DAY)


@query(
    "feeds_erroring",
    f"""SELECT count(DISTINCT feed_url) AS feeds_erroring FROM fetch_logs
        WHERE status = 'error' AND created_at > {L} - INTERVAL 2 HOUR AND created_at <= {L}""",
)
def _(spark, sf):
    return metrics.feeds_erroring(d.fetch_logs(spark, sf), d.LOG_NOW - timedelta(hours=2), d.LOG_NOW)


@query(
    "funnel_per_minute",
    f"""SELECT date_trunc('minute', t) AS minute, sum(a)::BIGINT AS fetched, sum(b)::BIGINT AS new_found,
          sum(c)::BIGINT AS saved, sum(e)::BIGINT AS summarized, sum(f)::BIGINT AS delivered FROM (
          SELECT created_at AS t, articles_found AS a, new_articles AS b, 0 AS c, 0 AS e, 0 AS f FROM fetch_logs
          UNION ALL SELECT created_at, 0, 0, 1, 0, 0 FROM articles
          UNION ALL SELECT created_at, 0, 0, 0, CAST(status = 'success' AS INTEGER), 0 FROM summary_logs
          UNION ALL SELECT created_at, 0, 0, 0, 0, CAST({OK_CODE} AS INTEGER) FROM webhook_logs) GROUP BY 1""",
)
def _(spark, sf):
    return metrics.funnel_per_minute(
        d.fetch_logs(spark, sf), d.articles(spark, sf), d.summary_logs(spark, sf), d.webhook_logs(spark, sf)
    )


@query(
    "error_rate_by_type",
    f"""SELECT date_trunc('hour', created_at) AS bucket, source, error_type, count(*) AS errors FROM (
          SELECT created_at, 'fetch' AS source, error_type FROM failed_fetches
          UNION ALL SELECT created_at, 'summary', 'api_call_failed' FROM summary_logs WHERE status = 'retry_failed'
          UNION ALL SELECT created_at, 'delivery', {_CLASS} FROM webhook_logs WHERE NOT {OK_CODE}
          UNION ALL SELECT created_at, 'save', 'save_failed' FROM save_logs WHERE status = 'save_failed') GROUP BY ALL""",
)
def _(spark, sf):
    return metrics.error_rate_by_type(
        d.fetch_logs(spark, sf), d.summary_logs(spark, sf), d.webhook_logs(spark, sf), d.save_logs(spark, sf)
    )


DAILY_SQL = """SELECT day::DATE AS day, count(*) FILTER (WHERE status = 'processed') AS saved,
         count(*) FILTER (WHERE status = 'save_failed') AS failed
       FROM (SELECT unnest(generate_series(DATE '2025-06-16', DATE '2025-07-15', INTERVAL 1 DAY)) AS day)
       LEFT JOIN save_logs ON created_at::DATE = day::DATE GROUP BY 1"""


@query("daily_ingestion", DAILY_SQL)
def _(spark, sf):
    return metrics.daily_ingestion(d.save_logs(spark, sf), d.ARTICLE_NOW)


# -- alerts -------------------------------------------------------------

RULES = (
    alerts.Rule("fetch_errors_high", "fetch_errors[6h]", "gt", 3.0, "warning", "many fetch errors", timedelta(hours=2)),
    alerts.Rule("fetch_errors_none", "fetch_errors[6h]", "eq", 0.0, "info", "no fetch errors", timedelta(hours=12)),
    alerts.Rule("fetch_errors_some", "fetch_errors[6h]", "ne", 0.0, "info", "fetch errors seen"),
    alerts.Rule("fetch_errors_odd", "fetch_errors[6h]", "between", 0.0, "info", "unknown operator never fires"),
)
T0, T1 = datetime(2024, 1, 1, tzinfo=timezone.utc), d.LOG_NOW

SAMPLES_SQL = """SELECT g.feed_url AS series, g.t AS tick, count(e.ts)::DOUBLE AS value FROM
    (SELECT feed_url, t FROM (SELECT DISTINCT feed_url FROM fetch_logs),
      (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 1 HOUR)) AS t)) g
    LEFT JOIN (SELECT feed_url, created_at AS ts FROM fetch_logs WHERE status = 'error') e
      ON e.feed_url = g.feed_url AND e.ts > g.t - INTERVAL 6 HOUR AND e.ts <= g.t GROUP BY ALL"""
EVAL_SQL = f"""SELECT rule, severity, description, threshold, hold, series, tick, value,
    CASE op WHEN 'gt' THEN value > threshold WHEN 'eq' THEN value = threshold WHEN 'ne' THEN value <> threshold
      ELSE false END AS firing
    FROM ({SAMPLES_SQL}), (VALUES ('fetch_errors_high', 'gt', 3.0::DOUBLE, 'warning', 'many fetch errors', 2),
      ('fetch_errors_none', 'eq', 0.0, 'info', 'no fetch errors', 12),
      ('fetch_errors_some', 'ne', 0.0, 'info', 'fetch errors seen', 0),
      ('fetch_errors_odd', 'between', 0.0, 'info', 'unknown operator never fires', 0))
      AS r(rule, op, threshold, severity, description, hold)"""
EDGES_SQL = f"""SELECT * FROM (SELECT *, coalesce(lag(firing) OVER (PARTITION BY rule, series ORDER BY tick), false)
    AS was FROM ({EVAL_SQL})) WHERE firing <> was"""


def _samples(spark, sf):
    errors = _feed_events(spark, sf).filter(F.col("status") == "error")
    grown = metrics.sliding_increase(errors, ["feed_url"], timedelta(hours=6), timedelta(hours=1))
    full = alerts.on_ticks(grown, ["feed_url"], _feed_events(spark, sf), T0, T1, timedelta(hours=1))
    return full.select(
        F.lit("fetch_errors[6h]").alias("metric"),
        F.col("feed_url").alias("series"),
        "tick",
        F.col("increase").cast("double").alias("value"),
    )


def _changes(spark, sf):
    """The same samples without a row for each quiet tick."""
    feeds, hour = _feed_events(spark, sf), timedelta(hours=1)
    errors = feeds.filter(F.col("status") == "error")
    grown = metrics.window_changes(errors, ["feed_url"], timedelta(hours=6), hour, {"n": F.lit(1)}, feeds, (T0, T1))
    return alerts.value_changes(grown, "fetch_errors[6h]", F.col("feed_url"), lambda get: get("n"), hour)


@query("alert_eval", f"SELECT rule, series, tick, value, firing FROM ({EVAL_SQL})")
def _(spark, sf):
    return alerts.evaluate(_samples(spark, sf), RULES).select("rule", "series", "tick", "value", "firing")


@query(
    "alert_transitions",
    f"""SELECT rule, series, severity, CASE WHEN firing THEN 'firing' ELSE 'resolved' END AS status, tick, value,
        threshold, description FROM ({EDGES_SQL})""",
)
def _(spark, sf):
    return alerts.transitions(alerts.evaluate_changes(_changes(spark, sf), RULES))


@query(
    "alert_episodes",
    f"""SELECT rule, series, severity, starts_at, ends_at, value, threshold FROM (SELECT *, tick AS starts_at,
        lead(tick) OVER (PARTITION BY rule, series ORDER BY tick) AS ends_at FROM ({EDGES_SQL})) WHERE firing""",
)
def _(spark, sf):
    return alerts.episodes(alerts.evaluate_changes(_changes(spark, sf), RULES))


@query(
    "alert_for",
    f"""SELECT rule, series, severity, min(tick) AS pending_since,
          min(tick) + to_hours(CASE rule WHEN 'fetch_errors_high' THEN 2 WHEN 'fetch_errors_none' THEN 12 ELSE 0 END)
            AS fired_at,
          CASE WHEN max(tick) < {L} THEN max(tick) + INTERVAL 1 HOUR END AS ended_at
        FROM (SELECT *, tick - to_hours(row_number() OVER (PARTITION BY rule, series ORDER BY tick)) AS island
          FROM ({EVAL_SQL}) WHERE firing) GROUP BY rule, series, severity, hold, island
        HAVING max(tick) - min(tick) >= to_hours(CAST(hold AS BIGINT))""",
)
def _(spark, sf):
    return alerts.held_changes(alerts.evaluate_changes(_changes(spark, sf), RULES), T1, timedelta(hours=1))


@query(
    "alert_payload",
    f"""SELECT rule, series, status, starts_at,
          '{{"embeds":[{{"color":' || CASE WHEN status = 'firing' THEN '15158332' ELSE '3066993' END
          || ',"description":"' || description || '","fields":[{{"inline":true,"name":"Status","value":"' || status
          || '"}},{{"inline":true,"name":"Severity","value":"' || severity
          || '"}},{{"inline":true,"name":"Value","value":"' || printf('%.2f', value)
          || '"}},{{"inline":true,"name":"Threshold","value":"' || printf('%.2f', threshold)
          || '"}}],"timestamp":"' || strftime(starts_at, '%Y-%m-%dT%H:%M:%SZ') || '","title":"Alert: ' || rule
          || '"}}]}}' AS embed_payload,
          '{{"attachments":[{{"color":"' || CASE WHEN status = 'firing' THEN 'danger' ELSE 'good' END
          || '","fields":[{{"short":true,"title":"Status","value":"' || status
          || '"}},{{"short":true,"title":"Severity","value":"' || severity
          || '"}},{{"short":true,"title":"Value","value":"' || printf('%.2f', value)
          || '"}},{{"short":true,"title":"Threshold","value":"' || printf('%.2f', threshold)
          || '"}}],"text":"' || description || '","title":"Alert: ' || rule || '","ts":'
          || epoch(starts_at)::BIGINT || '}}]}}' AS attachment_payload
        FROM (SELECT rule, series, severity, description, threshold, CASE WHEN firing THEN 'firing' ELSE 'resolved' END
          AS status, CASE WHEN firing THEN tick ELSE lag(tick) OVER w END AS starts_at,
          CASE WHEN firing THEN value ELSE lag(value) OVER w END AS value
          FROM ({EDGES_SQL}) WINDOW w AS (PARTITION BY rule, series ORDER BY tick))""",
)
def _(spark, sf):
    edges = alerts.edges_with_start(alerts.evaluate_changes(_changes(spark, sf), RULES))
    columns = ["rule", "series", "status", "starts_at", "embed_payload", "attachment_payload"]
    return alerts.alert_payloads(edges).select(*columns)


VOLUME_SQL = """WITH ticks AS (SELECT 'success' AS series,
      unnest(generate_series(TIMESTAMP '2025-05-25', TIMESTAMP '2025-07-20', INTERVAL 1 HOUR)) AS t),
    s AS (SELECT series, t, count(a.ts) FILTER (WHERE a.ts > t - INTERVAL 1 DAY) AS d1, count(a.ts) AS d2
      FROM ticks k LEFT JOIN (SELECT created_at AS ts FROM save_logs WHERE status = 'processed') a
        ON a.ts > t - INTERVAL 2 DAY AND a.ts <= t GROUP BY ALL),
    f AS (SELECT 'DailyArticleProcessingLow' AS rule, series, t, 6 AS hold FROM s WHERE d1 < 5
      UNION ALL SELECT 'NoArticlesProcessedToday', series, t, 3 FROM s WHERE d1 = 0
      UNION ALL SELECT 'ArticleDatabaseGrowthStalled', series, t, 1 FROM s WHERE d2 = 0)
    SELECT rule, series, min(t) AS pending_since, min(t) + to_hours(CAST(hold AS BIGINT)) AS fired_at
    FROM (SELECT *, t - to_hours(row_number() OVER (PARTITION BY rule, series ORDER BY t)) AS island FROM f)
    GROUP BY rule, series, hold, island HAVING max(t) - min(t) >= to_hours(CAST(hold AS BIGINT))"""


@query("alert_volume", VOLUME_SQL)
def _(spark, sf):
    # One series over all feeds, as the counter has no feed label. The period begins before the first article.
    saved = d.save_logs(spark, sf).withColumn("status", F.when(F.col("status") == "processed", "success"))
    every = saved.select(F.lit("success").alias("status"))
    events = saved.filter(F.col("status").isNotNull()).select("status", F.col("created_at").alias("ts"))
    period, hour = (datetime(2025, 5, 25, tzinfo=timezone.utc), datetime(2025, 7, 20, tzinfo=timezone.utc)), timedelta(hours=1)

    def changes(days):
        grown = metrics.window_changes(events, ["status"], days * DAY, hour, {"n": F.lit(1)}, every, period)
        metric = f"increase(articles_processed_total[{days}d])"
        return alerts.value_changes(grown, metric, F.col("status"), lambda get: get("n"), hour)

    evaluated = alerts.evaluate_changes(changes(1).unionByName(changes(2)), alerts.VOLUME_RULES)
    return alerts.held_changes(evaluated, period[1], hour).select("rule", "series", "pending_since", "fired_at")


# -- circuit breakers ---------------------------------------------------


def _attempts(spark, sf):
    """Fetch attempts per feed, at a tenth of the logged gaps so that timeouts matter."""
    squeezed = F.timestamp_micros(F.expr("unix_micros(created_at) div 10"))
    return d.fetch_logs(spark, sf).select(
        F.col("feed_url").alias("name"), squeezed.alias("ts"), F.col("id").alias("seq"),
        (F.col("status") == "success").alias("ok"),
    )


BREAKER_SQL = """WITH RECURSIVE ev AS MATERIALIZED (SELECT feed_url AS name, epoch_us(created_at) // 10 AS us,
      id AS seq, status = 'success' AS ok, row_number() OVER (PARTITION BY feed_url ORDER BY created_at, id) AS rn
      FROM fetch_logs),
    run(name, rn, us, seq, ok, allowed, before, state, f, s, fail_us, trip) AS (
      SELECT name, 0::BIGINT, 0::BIGINT, 0::BIGINT, true, true, 'closed', 'closed', 0, 0, NULL::BIGINT, false
        FROM ev WHERE rn = 1
      UNION ALL
      SELECT name, rn, us, seq, ok, allowed, before,
        CASE WHEN NOT allowed THEN 'open' WHEN NOT ok THEN CASE WHEN mode = 'half_open' OR f0 + 1 >= 3 THEN 'open'
          ELSE mode END WHEN mode = 'half_open' AND s0 + 1 >= 2 THEN 'closed' ELSE mode END,
        CASE WHEN NOT allowed THEN f0 WHEN NOT ok THEN f0 + 1 WHEN mode = 'half_open' AND s0 + 1 < 2 THEN f0 ELSE 0 END,
        CASE WHEN NOT allowed THEN s0 WHEN NOT ok THEN 0 WHEN mode = 'half_open' AND s0 + 1 < 2 THEN s0 + 1 ELSE 0 END,
        CASE WHEN allowed AND NOT ok THEN us ELSE fail_us END,
        allowed AND NOT ok AND (mode = 'half_open' OR f0 + 1 >= 3)
      FROM (SELECT e.*, r.state AS before, r.fail_us, NOT (r.state = 'open' AND e.us - r.fail_us <= 120000000) AS allowed,
          CASE WHEN r.state = 'open' THEN 'half_open' ELSE r.state END AS mode,
          CASE WHEN r.state = 'closed' AND e.us - r.fail_us > 300000000 THEN 0 ELSE r.f END AS f0,
          CASE WHEN r.state = 'open' THEN 0 ELSE r.s END AS s0
        FROM run r JOIN ev e ON e.name = r.name AND e.rn = r.rn + 1))
    SELECT name, make_timestamp(us) AS ts, seq, ok, allowed, before AS state_before, state AS state_after, trip
    FROM run WHERE rn > 0"""


@query("breaker_replay", BREAKER_SQL)
def _(spark, sf):
    return breaker.breaker_replay(_attempts(spark, sf))


@query("breaker_trips", f"SELECT name, count(*) FILTER (WHERE trip) AS trips FROM ({BREAKER_SQL}) GROUP BY 1")
def _(spark, sf):
    return metrics.breaker_trip_counts(breaker.breaker_replay(_attempts(spark, sf)))


@query(
    "breaker_states",
    f"""SELECT name, state, CASE WHEN state = s THEN 1.0 ELSE 0.0 END::DOUBLE AS value
        FROM (SELECT name, arg_max(state_after, (ts, seq)) AS s FROM ({BREAKER_SQL}) GROUP BY 1),
          unnest(['closed', 'half_open', 'open']) AS u(state)""",
)
def _(spark, sf):
    return breaker.breaker_states(breaker.breaker_replay(_attempts(spark, sf)))


@query(
    "breaker_health",
    f"""SELECT count(*) AS breakers, count(*) FILTER (WHERE s = 'open') AS open_breakers,
          CASE WHEN count(*) FILTER (WHERE s = 'open') > 0 THEN 'degraded' ELSE 'healthy' END AS status
        FROM (SELECT name, arg_max(state_after, (ts, seq)) AS s FROM ({BREAKER_SQL}) GROUP BY 1)""",
)
def _(spark, sf):
    states = breaker.breaker_states(breaker.breaker_replay(_attempts(spark, sf)))
    return stats.breaker_health(states.filter("value = 1"))


# -- the standard rules ---------------------------------------------------

WEEK = (datetime(2024, 1, 8, tzinfo=timezone.utc), datetime(2024, 1, 15, tzinfo=timezone.utc))
FIVE = timedelta(minutes=5)
# Every series on a grid of five minutes with its counts per step (or last value), then windows over the grid.
STANDARD_SQL = f"""WITH RECURSIVE replayed AS MATERIALIZED ({BREAKER_SQL}),
    grid AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-08', TIMESTAMP '2024-01-15', INTERVAL 5 MINUTE)) AS t),
    raw AS (
      SELECT 'fetch' AS m, concat_ws('/', feed_url, error_type) AS series, created_at AS ts, 1 AS a, 0 AS b FROM failed_fetches
      UNION ALL SELECT 'delivery', {_CLASS}, created_at, 1, 0 FROM webhook_logs WHERE NOT {OK_CODE}
      UNION ALL SELECT 'summary', model, created_at, 1, 0 FROM summary_logs WHERE status = 'retry_failed'
      UNION ALL SELECT 'http', '', created_at, CASE WHEN response_code BETWEEN 200 AND 299 THEN 0 ELSE 1 END, 1
        FROM webhook_logs WHERE response_code IS NOT NULL
      UNION ALL SELECT 'new', feed_url, created_at, new_articles, 0 FROM fetch_logs WHERE status = 'success'
      UNION ALL SELECT 'saved', '', created_at - INTERVAL 525 DAY, 1, 0 FROM save_logs WHERE status = 'processed'),
    steps AS (SELECT m, series, make_timestamp((ceil(epoch_us(ts) / 300e6) * 300000000)::BIGINT) AS t, sum(a) AS a, sum(b) AS b
      FROM raw GROUP BY ALL),
    wide AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-06', TIMESTAMP '2024-01-15', INTERVAL 5 MINUTE)) AS t),
    dense AS (SELECT s.m, s.series, w.t, coalesce(a, 0) AS a, coalesce(b, 0) AS b
      FROM (SELECT DISTINCT m, series FROM raw) s CROSS JOIN wide w LEFT JOIN steps x ON x.m = s.m AND x.series = s.series AND x.t = w.t),
    sums AS (SELECT *, sum(a) OVER (PARTITION BY m, series ORDER BY t ROWS 11 PRECEDING) AS hour,
      sum(a) OVER (PARTITION BY m, series ORDER BY t ROWS 287 PRECEDING) AS day FROM dense),
    gauges AS (
      SELECT 'breaker' AS m, name AS series, make_timestamp(epoch_us(ts) * 10) AS ts, seq, state_after = 'open' AS bad FROM replayed
      UNION ALL SELECT 'connections', '', ts, event_id, event_id % 50 = 0 FROM events),
    last AS (SELECT g.m, g.series, k.t, arg_max(bad, (ts, seq)) AS bad
      FROM (SELECT m, series, bad, ts, seq, greatest(TIMESTAMP '2024-01-08',
              make_timestamp((ceil(epoch_us(ts) / 300e6) * 300000000)::BIGINT)) AS t FROM gauges) g JOIN grid k ON k.t = g.t GROUP BY ALL),
    filled AS (SELECT s.m, s.series, k.t, last_value(bad IGNORE NULLS) OVER (PARTITION BY s.m, s.series ORDER BY k.t) AS bad
      FROM (SELECT DISTINCT m, series FROM gauges) s CROSS JOIN grid k LEFT JOIN last l ON l.m = s.m AND l.series = s.series AND l.t = k.t),
    state AS (
      SELECT CASE m WHEN 'fetch' THEN 'rss_fetch_failure_rate_high' WHEN 'delivery' THEN 'discord_webhook_failure_rate_high'
          WHEN 'summary' THEN 'summary_api_failure_rate_high' WHEN 'http' THEN 'high_http_error_rate'
          WHEN 'new' THEN 'no_new_articles_found' ELSE 'daily_article_processing_low' END AS rule, series, t,
        CASE m WHEN 'fetch' THEN a / 300.0::DOUBLE > 0.1::DOUBLE WHEN 'delivery' THEN a / 300.0::DOUBLE > 0.05::DOUBLE
          WHEN 'summary' THEN a / 300.0::DOUBLE > 0.1::DOUBLE WHEN 'http' THEN b > 0 AND a / b::DOUBLE > 0.1::DOUBLE
          WHEN 'new' THEN hour = 0 ELSE day < 5 END AS firing,
        CASE m WHEN 'new' THEN 60 WHEN 'saved' THEN 360 ELSE 5 END AS hold FROM sums JOIN grid USING (t)
      UNION ALL SELECT CASE m WHEN 'breaker' THEN 'circuit_breaker_open' ELSE 'database_connection_issues' END, series, t,
        coalesce(bad, false), 5 FROM filled)
    SELECT rule, series, min(t) AS pending_since, min(t) + to_minutes(hold) AS fired_at,
      CASE WHEN max(t) < TIMESTAMP '2024-01-15' THEN max(t) + INTERVAL 5 MINUTE END AS ended_at
    FROM (SELECT *, t - to_minutes(5 * row_number() OVER (PARTITION BY rule, series ORDER BY t)) AS island
      FROM state WHERE firing) GROUP BY rule, series, hold, island HAVING max(t) - min(t) >= to_minutes(hold)"""


@query("standard_alerts", STANDARD_SQL)
def _(spark, sf):
    # Articles of 2025 are moved into the week; delivery attempts stand for API requests, events for pool samples.
    saves = d.save_logs(spark, sf).withColumn("created_at", F.col("created_at") - F.expr("INTERVAL 525 DAY"))
    requests = d.webhook_logs(spark, sf).select("created_at", F.col("response_code").alias("status_code"))
    replayed = breaker.breaker_replay(_attempts(spark, sf))
    breakers = replayed.select(
        "name", F.timestamp_micros(F.unix_micros("ts") * 10).alias("ts"), "seq", F.col("state_after").alias("state")
    )
    pool = F.when(F.col("event_id") % 50 == 0, 0.0).otherwise(5.0)
    connections = d.base(spark, sf, "events").select("ts", F.col("event_id").alias("seq"), pool.alias("value"))
    changes = alerts.standard_changes(
        d.fetch_logs(spark, sf), saves, d.summary_logs(spark, sf), d.webhook_logs(spark, sf),
        requests.filter(F.col("status_code").isNotNull()), breakers, connections, WEEK, FIVE,
    )
    held = alerts.held_changes(alerts.evaluate_changes(changes, alerts.STANDARD_RULES), WEEK[1], FIVE)
    return held.select("rule", "series", "pending_since", "fired_at", "ended_at")
