"""Admission, inserts, upserts, updates and delivery logs."""

from datetime import timedelta

from pyspark.sql import functions as F

from storyloom.operators import admission, merge, notify, summarize, tables
from storyloom.operators.ordering import number_rows
from storyloom.plans import derived as d
from storyloom.plans.registry import query
from storyloom.session import shared_folder
from storyloom.sources.tables import read_table

A = "TIMESTAMP '2025-07-15 14:30:00'"
STATUSES = "SELECT feed_url, item_no, link, published, status FROM admission"
ITEM = ["feed_url", "item_no", "link", "published"]


def _statuses(spark, sf):
    return admission.admission_status(d.items(spark, sf), d.stored_articles(spark, sf), d.CUTOFF, d.INITIATION)


@query("admission_status", STATUSES)
def _(spark, sf):
    return _statuses(spark, sf).select(*ITEM, "status")


@query(
    "date_cutoff",
    f"""SELECT feed_url, item_no, link, published FROM items
        WHERE published >= {A} - INTERVAL 100 DAY AND published >= {A} - INTERVAL 200 DAY""",
)
def _(spark, sf):
    return admission.date_cutoff(d.items(spark, sf), d.CUTOFF, d.INITIATION).select(*ITEM)


@query(
    "first_per_url",
    """SELECT feed_url, item_no, link, published FROM items QUALIFY
       row_number() OVER (PARTITION BY link ORDER BY published NULLS LAST, feed_url NULLS FIRST, item_no) = 1""",
)
def _(spark, sf):
    return admission.first_per_url(d.items(spark, sf)).select(*ITEM)


@query(
    "dedup_anti",
    """SELECT feed_url, item_no, link, published FROM items
       WHERE link IS NULL OR link NOT IN (SELECT url FROM stored_articles) QUALIFY
       row_number() OVER (PARTITION BY link ORDER BY published NULLS LAST, feed_url NULLS FIRST, item_no) = 1""",
)
def _(spark, sf):
    return admission.dedup_anti(d.items(spark, sf), d.stored_articles(spark, sf)).select(*ITEM)


@query(
    "chronological_items",
    """SELECT feed_url, item_no, published, row_number() OVER (PARTITION BY feed_url
         ORDER BY published NULLS LAST, item_no) AS position
       FROM (SELECT coalesce(feed_url, '') AS feed_url, item_no, published FROM items)""",
)
def _(spark, sf):
    # Items of no feed are numbered together.
    rows = d.items(spark, sf).select(F.coalesce("feed_url", F.lit("")).alias("feed_url"), "item_no", "published")
    return number_rows(rows, ["feed_url"], [F.col("published").asc_nulls_last(), F.col("item_no")], out="position")


RUN_SQL = """SELECT item_no % 6 AS run, feed_url, count(*) AS articles_found,
       count(*) FILTER (WHERE status = 'processed') AS new_articles FROM admission GROUP BY 1, 2"""


def _run_statuses(spark, sf):
    """Items as found by six runs over the feeds."""
    return _statuses(spark, sf).withColumn("run", F.col("item_no") % 6)


@query("feed_run_summary", RUN_SQL)
def _(spark, sf):
    return admission.feed_run_summary(_run_statuses(spark, sf))


@query(
    "fetch_log_append",
    f"""SELECT f.run, f.feed_url, f.status, f.message, f.duration_ms,
          CAST(CASE WHEN f.status = 'success' THEN coalesce(r.articles_found, 0) ELSE 0 END AS INTEGER) AS articles_found,
          CAST(CASE WHEN f.status = 'success' THEN coalesce(r.new_articles, 0) ELSE 0 END AS INTEGER) AS new_articles,
          {A} AS created_at
        FROM (SELECT *, id % 6 AS run FROM fetch_logs) f LEFT JOIN ({RUN_SQL}) r
          ON r.run = f.run AND r.feed_url = f.feed_url""",
)
def _(spark, sf):
    fetches = d.fetch_logs(spark, sf).select("id", (F.col("id") % 6).alias("run"), "feed_url", "status", "message", "duration_ms")
    return admission.fetch_log_rows(_run_statuses(spark, sf), fetches, d.ARTICLE_NOW)


INSERT_COLUMNS = (
    "id", "url", "title", "full_content", "publish_date", "feed_url", "content_hash", "posted_to_discord", "fetch_time",
)
INSERT_SQL = f"""WITH fresh AS (SELECT * FROM admission WHERE status = 'processed'),
        top AS (SELECT max(id) AS m FROM stored_articles)
        SELECT id, url, title, full_content, publish_date, feed_url, content_hash, posted_to_discord, fetch_time
          FROM stored_articles
        UNION ALL SELECT m + row_number() OVER (ORDER BY published, feed_url NULLS FIRST, link), link, title,
          description, published, feed_url, sha256(title || link || description), false, {A} FROM fresh, top"""


def _admitted_rows(spark, sf):
    passing = admission.admitted(d.items(spark, sf), d.CUTOFF, d.INITIATION)
    return admission.as_articles(passing.withColumn("content", F.col("description")), d.ARTICLE_NOW)


@query("article_insert_ignore", INSERT_SQL)
def _(spark, sf):
    order = [F.col("publish_date").asc_nulls_last(), F.col("feed_url").asc_nulls_first()]
    merged = tables.insert_ignore(d.stored_articles(spark, sf), _admitted_rows(spark, sf), order, ["publish_date", "feed_url"])
    return merged.select(*INSERT_COLUMNS)


def _merged(spark, sf, stored, apply):
    """``stored`` written by day, merged into by ``apply(path, schema)``, and read again."""
    path = shared_folder(spark, "articles-by-day")
    merge.write_table(stored, path)
    apply(path, stored.schema)
    return read_table(spark, path, stored.schema)


@query("merge_insert_ignore", INSERT_SQL)
def _(spark, sf):
    rows = _admitted_rows(spark, sf)
    # No admitted row is without a date, so NULLs first holds for the feeds.
    order = [F.col("publish_date"), F.col("feed_url")]
    merged = _merged(
        spark, sf, d.stored_articles(spark, sf),
        lambda path, schema: merge.merge_insert_ignore(spark, path, schema, rows, order, d.ARTICLE_NOW),
    )
    return merged.select(*INSERT_COLUMNS)


def _incoming(spark, sf):
    """Every article again, partly NULL, then once more with other parts NULL: a batch in two passes."""
    arts = d.articles(spark, sf)
    doc = F.col("id") - 1

    def one_pass(k):
        def some(c):
            return F.when((doc + k) % 3 != 0, F.col(c)).alias(c)

        return arts.select(
            F.concat(F.lit(f"v{k} "), "title").alias("title"),
            "url",
            some("publish_date"),
            F.when((doc + k) % 2 == 0, F.lit(f"summary {k}")).alias("summary"),
            some("full_content"),
            F.lit(d.ARTICLE_NOW + timedelta(minutes=k)).cast("timestamp").alias("fetch_time"),
            (doc % 5 == k).alias("posted_to_discord"),
            "feed_url",
            some("content_hash"),
            some("fetch_duration_ms"),
            (F.col("id") + k * 1_000_000_000).alias("batch_no"),
        )

    return one_pass(0), one_pass(1)


def _pass_sql(k: int) -> str:
    def some(c):
        return f"CASE WHEN (id - 1 + {k}) % 3 <> 0 THEN {c} END AS {c}"

    return f"""SELECT 'v{k} ' || title AS title, url, {some('publish_date')},
        CASE WHEN (id - 1 + {k}) % 2 = 0 THEN 'summary {k}' END AS summary, {some('full_content')},
        {A} + INTERVAL {k} MINUTE AS fetch_time, (id - 1) % 5 = {k} AS posted_to_discord, feed_url,
        {some('content_hash')}, {some('fetch_duration_ms')}, id AS n FROM articles"""


UPSERT_COLUMNS = (
    "id", "url", "title", "publish_date", "summary", "full_content", "fetch_time", "posted_to_discord",
    "feed_url", "content_hash", "fetch_duration_ms", "story_cluster_id", "created_at", "updated_at",
)


def _upsert_sql(incoming: str) -> str:
    keep = ", ".join(
        f"coalesce(n.{c}, o.{c}) AS {c}"
        for c in ("publish_date", "summary", "full_content", "feed_url", "content_hash", "fetch_duration_ms")
    )
    return f"""WITH n AS ({incoming}), top AS (SELECT max(id) AS m FROM stored_articles),
        gone AS (SELECT url, row_number() OVER (ORDER BY n) AS rn FROM n
          WHERE url NOT IN (SELECT url FROM stored_articles))
        SELECT coalesce(o.id, (SELECT m FROM top) + rn) AS id, url, n.title, {keep}, n.fetch_time,
          n.posted_to_discord, o.story_cluster_id, coalesce(o.created_at, {A}) AS created_at, {A} AS updated_at
        FROM n LEFT JOIN stored_articles o USING (url) LEFT JOIN gone USING (url)"""


def _merge_upserted(spark, sf, rows):
    merged = _merged(
        spark, sf, d.stored_articles(spark, sf),
        lambda path, schema: merge.merge_upsert(spark, path, schema, rows, d.ARTICLE_NOW),
    )
    return merged.select(*UPSERT_COLUMNS)


@query("article_upsert", _upsert_sql(_pass_sql(0)))
def _(spark, sf):
    rows, _ = _incoming(spark, sf)
    return tables.upsert(d.stored_articles(spark, sf), rows, d.ARTICLE_NOW).select(*UPSERT_COLUMNS)


@query("merge_upsert", _upsert_sql(_pass_sql(0)))
def _(spark, sf):
    return _merge_upserted(spark, sf, _incoming(spark, sf)[0])


BATCH_SQL = (
    _upsert_sql(
        f"""SELECT b.url, b.title, b.fetch_time, b.posted_to_discord, a.n, """
        + ", ".join(
            f"coalesce(b.{c}, a.{c}) AS {c}"
            for c in ("publish_date", "summary", "full_content", "feed_url", "content_hash", "fetch_duration_ms")
        )
        + f" FROM ({_pass_sql(0)}) a JOIN ({_pass_sql(1)}) b USING (url)"
    )
)


@query("merge_batch_upsert", BATCH_SQL)
def _(spark, sf):
    first, second = _incoming(spark, sf)
    return _merge_upserted(spark, sf, first.unionByName(second))


@query("article_batch_upsert", BATCH_SQL)
def _(spark, sf):
    first, second = _incoming(spark, sf)
    batch = first.unionByName(second)
    return tables.upsert(d.stored_articles(spark, sf), batch, d.ARTICLE_NOW).select(*UPSERT_COLUMNS)


@query(
    "batch_fold",
    f"""SELECT b.url, b.title, b.fetch_time, b.posted_to_discord, coalesce(b.summary, a.summary) AS summary,
          coalesce(b.publish_date, a.publish_date) AS publish_date FROM ({_pass_sql(0)}) a JOIN ({_pass_sql(1)}) b
          USING (url)""",
)
def _(spark, sf):
    first, second = _incoming(spark, sf)
    folded = tables.fold_batch(first.unionByName(second), "batch_no")
    return folded.select("url", "title", "fetch_time", "posted_to_discord", "summary", "publish_date")


@query(
    "article_convert",
    f"""SELECT title, url, publish_date, nullif(coalesce(summary, ''), '') AS full_content,
          nullif(coalesce(feed_url, ''), '') AS feed_url, content_hash,
          CASE WHEN fetch_duration_ms > 0 THEN fetch_duration_ms END AS fetch_duration_ms, {A} AS fetch_time
        FROM articles""",
)
def _(spark, sf):
    structs = d.articles(spark, sf).select(
        "title",
        "url",
        F.col("publish_date").alias("published_at"),
        F.coalesce("summary", F.lit("")).alias("content"),
        F.coalesce("feed_url", F.lit("")).alias("feed_url"),
        "content_hash",
        (F.coalesce("fetch_duration_ms", F.lit(0)).cast("long") * 1_000_000).alias("fetch_duration_ns"),
    )
    return tables.convert_articles(structs, d.ARTICLE_NOW).select(
        "title", "url", "publish_date", "full_content", "feed_url", "content_hash", "fetch_duration_ms", "fetch_time"
    )


UPDATES_SQL = "SELECT id * 2 AS id, 'new ' || id AS summary FROM articles"


def _updates(spark, sf):
    """New summaries for every second id; the upper half names no stored row."""
    return d.articles(spark, sf).select(
        (F.col("id") * 2).alias("id"), F.concat(F.lit("new "), F.col("id").cast("string")).alias("summary")
    )


KEYED_SQL = f"""SELECT a.id, a.url, coalesce(u.summary, a.summary) AS summary,
          CASE WHEN u.id IS NULL THEN a.updated_at ELSE {A} END AS updated_at
        FROM articles a LEFT JOIN ({UPDATES_SQL}) u USING (id)"""


@query("merge_update", KEYED_SQL)
def _(spark, sf):
    rows = _merged(
        spark, sf, d.articles(spark, sf),
        lambda path, schema: merge.merge_update(
            spark, path, schema, _updates(spark, sf), "id", ["summary"], d.ARTICLE_NOW
        ),
    )
    return rows.select("id", "url", "summary", "updated_at")


@query("keyed_update", KEYED_SQL)
def _(spark, sf):
    rows = tables.keyed_update(d.articles(spark, sf), _updates(spark, sf), "id", ["summary"], d.ARTICLE_NOW)
    return rows.select("id", "url", "summary", "updated_at")


@query("unmatched_updates", f"SELECT id, summary FROM ({UPDATES_SQL}) WHERE id NOT IN (SELECT id FROM articles)")
def _(spark, sf):
    return tables.unmatched_updates(d.articles(spark, sf), _updates(spark, sf), "id")


@query(
    "table_counts",
    """SELECT 'articles' AS table_name, count(*) AS record_count FROM articles
       UNION ALL SELECT 'webhook_logs', count(*) FROM webhook_logs
       UNION ALL SELECT 'discord_error_logs', count(*) FROM webhook_logs
         WHERE response_code IS NULL OR response_code NOT BETWEEN 200 AND 299
       UNION ALL SELECT 'summary_logs', count(*) FROM summary_logs""",
)
def _(spark, sf):
    return tables.table_counts(
        {
            "articles": d.articles(spark, sf),
            "webhook_logs": d.webhook_logs(spark, sf),
            "discord_error_logs": notify.delivery_errors(_attempts(spark, sf)),
            "summary_logs": d.summary_logs(spark, sf),
        }
    )


@query(
    "cascade_delete",
    """SELECT id, article_id, attempt FROM webhook_logs WHERE article_id IN (SELECT id FROM stored_articles)""",
)
def _(spark, sf):
    left = tables.cascade_delete(d.webhook_logs(spark, sf), d.stored_articles(spark, sf))
    return left.select("id", "article_id", "attempt")


# -- delivery logs ------------------------------------------------------


def _attempts(spark, sf):
    hook = F.concat(F.lit("https://chat.example.com/api/webhooks/"), "article_id", F.lit("/secret"))
    url = F.concat(F.lit("https://example.com/a/"), F.col("article_id").cast("string"))
    return d.webhook_logs(spark, sf).select(
        hook.alias("webhook_url"),
        url.alias("article_url"),
        "attempt",
        "response_code",
        "error_message",
        F.col("latency_ms").alias("duration_ms"),
        "created_at",
    )


@query(
    "delivery_error_append",
    """SELECT 'https://chat.example.com/api/webhooks/' || article_id || '/***TOKEN_HIDDEN***' AS webhook_url,
         'https://example.com/a/' || article_id AS article_url, coalesce(error_message, '') AS error_message,
         coalesce(response_code, 0) AS status_code, attempt AS retry_attempt, latency_ms AS duration_ms,
         CASE WHEN response_code IS NULL THEN 'network_error' WHEN response_code < 500 THEN 'client_error'
           ELSE 'server_error' END AS error_class, attempt >= 3 AS max_retries_exceeded, created_at
       FROM webhook_logs WHERE response_code IS NULL OR response_code NOT BETWEEN 200 AND 299""",
)
def _(spark, sf):
    return notify.delivery_errors(_attempts(spark, sf))


def _url_logs(spark, sf):
    doc = F.col("article_id") - 1
    url = F.concat(F.lit("https://src"), (doc % 20).cast("string"), F.lit(".example.com/a/"), doc.cast("string"))
    return d.webhook_logs(spark, sf).select("id", url.alias("url"), "response_code", "created_at")


@query(
    "log_by_url",
    """SELECT w.id, w.article_id, w.response_code, a.id IS NULL AS unknown_url
       FROM webhook_logs w LEFT JOIN articles a ON a.id = w.article_id""",
)
def _(spark, sf):
    known, unknown = notify.resolve_log_urls(_url_logs(spark, sf), d.articles(spark, sf))
    doc = F.regexp_extract("url", r"/a/(\d+)$", 1).cast("long") + 1
    return known.select("id", "article_id", "response_code", F.lit(False).alias("unknown_url")).unionByName(
        unknown.select("id", doc.alias("article_id"), "response_code", F.lit(True).alias("unknown_url"))
    )


NUMBERED_SQL = """SELECT id, article_id, CAST(row_number() OVER (PARTITION BY article_id ORDER BY created_at, id)
    + coalesce(m, 0) AS INTEGER) AS attempt FROM
    (SELECT event_id AS id, user_id % 40 + 1 AS article_id, ts AS created_at FROM events) n
    LEFT JOIN (SELECT article_id, max(attempt) AS m FROM webhook_logs GROUP BY 1) USING (article_id)"""


def _new_attempts(spark, sf):
    """All events as attempts on few articles: large groups to number."""
    return d.base(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        (F.col("user_id") % 40 + 1).alias("article_id"),
        F.col("ts").alias("created_at"),
    )


@query("attempt_numbering", NUMBERED_SQL)
def _(spark, sf):
    rows = notify.numbered_attempts(_new_attempts(spark, sf), d.webhook_logs(spark, sf))
    return rows.select("id", "article_id", "attempt")


@query("webhook_log_append", f"SELECT id, article_id, attempt FROM webhook_logs UNION ALL {NUMBERED_SQL}")
def _(spark, sf):
    logs = d.webhook_logs(spark, sf).select("id", "article_id", "attempt", "created_at")
    return notify.append_webhook_logs(logs, _new_attempts(spark, sf)).select("id", "article_id", "attempt")


# -- summaries and vectors ----------------------------------------------


@query(
    "pending_summary",
    r"""SELECT id, url FROM articles WHERE summary IS NULL
        AND regexp_replace(full_content, '^[\s\x{0085}\x{00A0}]+', '') <> ''""",
)
def _(spark, sf):
    return summarize.pending_summary(d.articles(spark, sf)).select("id", "url")


def _summary_attempts(spark, sf):
    return summarize.summary_attempts(summarize.pending_summary(d.articles(spark, sf)))


LEAD_SQL = r"""SELECT id, url, CASE WHEN s = '' THEN
      'Summary content was filtered out - please check model configuration'
      WHEN len(w) > 220 THEN array_to_string(w[1:200], ' ') || '...' ELSE s END AS summary
    FROM (SELECT *, string_split(s, ' ') AS w FROM (SELECT id, url, regexp_replace(trim(array_to_string(
        list_transform(regexp_extract_all(regexp_replace(full_content, '^\s+|\s+$', '', 'g'),
          '(?s).*?[.!?]\s+|.+')[1:3], lambda x: regexp_replace(x, '\s+$', '')), ' ')), '\s+', ' ', 'g') AS s
      FROM articles WHERE summary IS NULL AND regexp_replace(full_content, '\s+', '', 'g') <> ''))"""


LOG_SQL = """SELECT url AS article_url, 'lead-sentences' AS model, 'success' AS status, '' AS error_message,
         1 AS retry_attempt FROM articles WHERE summary IS NULL AND trim(full_content) <> ''"""


def _no_model(prompt: str, text: str) -> str:
    raise RuntimeError("a logged attempt must not be made again")


@query("summary_log_once", LOG_SQL)
def _(spark, sf):
    ledger, pending = shared_folder(spark, "summaries"), summarize.pending_summary(d.articles(spark, sf))
    summarize.summary_attempts_once(pending, ledger, slots=8).write.format("noop").mode("overwrite").save()
    again = summarize.summary_attempts_once(pending, ledger, _no_model, slots=8)
    return again.select("article_url", "model", "status", "error_message", "retry_attempt")


@query("summarize_pending", LEAD_SQL)
def _(spark, sf):
    return summarize.final_summaries(_summary_attempts(spark, sf))


@query("summary_log_append", LOG_SQL)
def _(spark, sf):
    return _summary_attempts(spark, sf).select("article_url", "model", "status", "error_message", "retry_attempt")


def _flaky(prompt: str, text: str) -> str:
    """Fails on texts of odd length: every attempt of theirs is logged."""
    if len(text) % 2:
        raise RuntimeError("model unavailable")
    return "fine"


@query(
    "retry_log",
    """SELECT id, CASE WHEN length(full_content) % 2 = 0 THEN 'success' WHEN n <= 3 THEN 'retry_failed'
         ELSE 'failed' END AS status, CASE WHEN n <= 3 THEN n ELSE 3 END AS retry_attempt,
         CASE WHEN length(full_content) % 2 = 0 THEN 'fine' WHEN n <= 3 THEN '' ELSE 'summary unavailable' END AS summary,
         CASE WHEN length(full_content) % 2 = 0 THEN '' ELSE 'model unavailable' END AS error_message
       FROM articles, (SELECT unnest([1, 2, 3, 4]) AS n)
       WHERE n = 1 OR length(full_content) % 2 = 1""",
)
def _(spark, sf):
    rows = summarize.summary_attempts(d.articles(spark, sf), _flaky, "flaky")
    return rows.select("id", "status", "retry_attempt", "summary", "error_message")
