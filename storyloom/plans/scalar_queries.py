"""Text, URL, time and payload functions applied to whole tables."""

from pyspark.sql import functions as F

from storyloom.functions import text as tx
from storyloom.functions import urls as ux
from storyloom.functions.html import extract_main_content, unwrap_feed_xml
from storyloom.functions.time import parse_feed_time, parse_multi_timestamp, rfc3339
from storyloom.operators import notify, reextract
from storyloom.plans import derived as d
from storyloom.plans.registry import query
from storyloom.session import shared_folder
from storyloom.sources.feeds import parse_feed_list, parse_feeds, parse_outcomes, solver_response
from storyloom.sources.pages import page_scan

WS = r"[\t\n\x0B\f\r \x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def trim_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def truncate_sql(x: str, n: int) -> str:
    """Byte truncation through hex digits, independent of the Spark expression."""

    def lead(i: int) -> str:
        return f"substr(hex(encode({x})), {2 * i + 1}, 2) NOT BETWEEN '80' AND 'BF'"

    cut = f"CASE WHEN {lead(n)} THEN {n} WHEN {lead(n - 1)} THEN {n - 1} WHEN {lead(n - 2)} THEN {n - 2} ELSE {n - 3} END"
    return f"CASE WHEN strlen({x}) <= {n} THEN {x} ELSE decode(unhex(substr(hex(encode({x})), 1, 2 * ({cut})))) END"


def truncate_words_sql(x: str, n: int) -> str:
    head = truncate_sql(x, n - 3)
    last = "strlen(regexp_extract(h, '(?s)^(.*) ', 1))"
    return (
        f"(SELECT CASE WHEN strlen({x}) <= {n} THEN {x} WHEN contains(h, ' ') AND {last} > {n // 2} "
        f"THEN regexp_extract(h, '(?s)^(.*) ', 1) || '...' ELSE h || '...' END FROM (SELECT {head} AS h))"
    )


@query(
    "sanitize_utf8",
    "SELECT doc_id, text AS clean FROM documents",
)
def _(spark, sf):
    # A byte that starts no character is put in front, in the middle and at the end of every text.
    raw, stray = F.encode("text", "UTF-8"), F.unhex(F.lit("E2"))
    mid = F.floor(F.length("text") / 2).cast("int")
    first, rest = F.encode(F.left("text", mid), "UTF-8"), F.encode(F.expr("substring(text, length(text) div 2 + 1)"), "UTF-8")
    dirty = F.when(F.col("doc_id") % 4 == 3, raw).otherwise(F.concat(stray, first, stray, rest, stray))
    return d.base(spark, sf, "documents").select("doc_id", tx.sanitize_utf8(dirty).alias("clean"))


@query(
    "safe_truncate",
    f"""SELECT doc_id, {truncate_sql('text', 400)} AS cut_400, {truncate_sql('text', 1001)} AS cut_1001,
        {truncate_sql('text', 10000)} AS cut_10000 FROM documents""",
)
def _(spark, sf):
    c = F.col("text")
    return d.base(spark, sf, "documents").select(
        "doc_id",
        tx.safe_truncate(c, 400).alias("cut_400"),
        tx.safe_truncate(c, 1001).alias("cut_1001"),
        tx.safe_truncate(c, 10000).alias("cut_10000"),
    )


@query(
    "content_hash",
    "SELECT id, sha256(coalesce(title,'') || coalesce(url,'') || coalesce(summary,'')) AS hash FROM articles",
)
def _(spark, sf):
    return d.articles(spark, sf).select(
        "id", tx.content_hash(F.col("title"), F.col("url"), F.col("summary")).alias("hash")
    )


def clean_sql(x: str) -> str:
    for tag in ("think", "thinking", "reason", "analysis"):
        x = rf"regexp_replace({x}, '(?is)<{tag}\s*>.*?</{tag}\s*>', '', 'g')"
        x = rf"regexp_replace({x}, '(?i)</?{tag}\s*>', '', 'g')"
    return trim_sql(rf"regexp_replace({x}, '\s+', ' ', 'g')")


@query(
    "clean_summary",
    f"""SELECT doc_id, CASE WHEN s = '' THEN 'Summary content was filtered out - please check model configuration'
        ELSE s END AS summary FROM (SELECT doc_id, {clean_sql('answer')} AS s FROM tagged_texts)""",
)
def _(spark, sf):
    return d.tagged_texts(spark, sf).select("doc_id", tx.clean_summary(F.col("answer")).alias("summary"))


def limit_sql(x: str, most: int, slack: int) -> str:
    return (
        f"(SELECT CASE WHEN len(w) > {most + slack} THEN array_to_string(w[1:{most}], ' ') || '...' ELSE {x} END "
        f"FROM (SELECT list_filter(regexp_split_to_array({x}, '{WS}+'), lambda v: v <> '') AS w))"
    )


@query(
    "limit_words",
    f"SELECT doc_id, {limit_sql('text', 200, 20)} AS standard, {limit_sql('text', 100, 0)} AS standalone FROM documents",
)
def _(spark, sf):
    c = F.col("text")
    return d.base(spark, sf, "documents").select(
        "doc_id",
        tx.limit_words(c).alias("standard"),
        tx.limit_words(c, tx.STANDALONE_MAX_WORDS, 0).alias("standalone"),
    )


@query(
    "truncate_words",
    f"""SELECT doc_id, {truncate_words_sql('text', 256)} AS cut_256, {truncate_words_sql('text', 300)} AS cut_300
        FROM documents""",
)
def _(spark, sf):
    c = F.col("text")
    return d.base(spark, sf, "documents").select(
        "doc_id", tx.truncate_words(c, 256).alias("cut_256"), tx.truncate_words(c, 300).alias("cut_300")
    )


@query(
    "mask_webhook_url",
    """SELECT id, CASE WHEN len(string_split(u, '/')) >= 7
          THEN regexp_replace(u, '[^/]*$', '***TOKEN_HIDDEN***') ELSE u END AS masked
       FROM (SELECT id, CASE WHEN id % 2 = 0 THEN 'https://chat.example.com/api/webhooks/' || id || '/token-' || id
          ELSE url END AS u FROM articles)""",
)
def _(spark, sf):
    hook = F.concat(F.lit("https://chat.example.com/api/webhooks/"), "id", F.lit("/token-"), "id")
    u = F.when(F.col("id") % 2 == 0, hook).otherwise(F.col("url"))
    return d.articles(spark, sf).select("id", ux.mask_webhook_url(u).alias("masked"))


@query(
    "feed_title",
    """SELECT page_id, url, string_split(CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3)
         ELSE url END, '/')[1] AS title FROM pages""",
)
def _(spark, sf):
    return d.base(spark, sf, "pages").select("page_id", "url", ux.feed_title(F.col("url")).alias("title"))


@query(
    "feed_excluded",
    """SELECT id, coalesce(contains(lower(feed_url), 'src1.example') OR contains(lower(feed_url), 'src4'), false)
         AS excluded FROM articles""",
)
def _(spark, sf):
    flag = ux.feed_excluded(F.col("feed_url"), ["SRC1.Example", "  ", " src4 "])
    return d.articles(spark, sf).select("id", flag.alias("excluded"))


@query(
    "challenge_status",
    """SELECT id, message, coalesce(try_cast(substr(message, 6) AS INTEGER) IN (403, 429, 503)
         OR try_cast(substr(message, 6) AS INTEGER) BETWEEN 520 AND 527, false) AS challenged FROM fetch_logs""",
)
def _(spark, sf):
    code = F.expr("try_cast(substring(message, 6) AS INT)")
    challenged = F.coalesce(ux.is_challenge_status(code), F.lit(False))
    return d.fetch_logs(spark, sf).select("id", "message", challenged.alias("challenged"))


@query(
    "error_class",
    """SELECT id, CASE WHEN response_code IS NULL THEN 'network_error' WHEN response_code BETWEEN 400 AND 499
         THEN 'client_error' WHEN response_code >= 500 THEN 'server_error' ELSE 'unknown' END AS error_class
       FROM webhook_logs""",
)
def _(spark, sf):
    return d.webhook_logs(spark, sf).select("id", ux.delivery_error_class(F.col("response_code")).alias("error_class"))


PROMPT_SQL = "'" + tx.SUMMARY_PROMPT.replace("%d", "200").split("%s")[0] + "'"


@query(
    "summary_prompt",
    f"""SELECT doc_id, {PROMPT_SQL} || {truncate_sql('text', 10000)}
          || CASE WHEN strlen(text) > 10000 THEN '...' ELSE '' END || chr(10) || chr(10) || 'Summary:' AS prompt
        FROM documents""",
)
def _(spark, sf):
    return d.base(spark, sf, "documents").select("doc_id", tx.summary_prompt(F.col("text")).alias("prompt"))


@query(
    "parse_multi_timestamp",
    """SELECT event_id, CASE event_id % 4
         WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN CAST(date_trunc('day', ts) AS TIMESTAMP)
         WHEN 2 THEN date_trunc('second', ts) ELSE TIMESTAMP '2025-05-31 00:00:00' END AS parsed FROM events""",
)
def _(spark, sf):
    ts, k = F.col("ts"), F.col("event_id") % 4
    text = (
        F.when(k == 0, rfc3339(ts))
        .when(k == 1, F.date_format(ts, "yyyy-MM-dd"))
        .when(k == 2, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
        .otherwise(F.date_format(ts, "dd/MM/yyyy"))
    )
    default = F.lit(d.CUTOFF.replace(month=5, day=31, hour=0, minute=0)).cast("timestamp")
    return d.base(spark, sf, "events").select("event_id", parse_multi_timestamp(text, default).alias("parsed"))


@query("parse_feed_time", "SELECT event_id, date_trunc('second', ts) AS parsed FROM events")
def _(spark, sf):
    ts, k = F.col("ts"), F.col("event_id") % 5
    shifted = F.timestamp_seconds(F.unix_seconds("ts") - 5 * 3600)
    text = (
        F.when(k == 0, F.concat(F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000")))
        .when(k == 1, F.concat(F.date_format(shifted, "EEE, d MMM yyyy HH:mm:ss"), F.lit(" EST")))
        .when(k == 2, F.concat(F.date_format(ts, "d MMM yyyy HH:mm:ss"), F.lit(" GMT")))
        .when(k == 3, rfc3339(ts))
        .otherwise(F.concat(F.date_format(shifted, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-05:00")))
    )
    return d.base(spark, sf, "events").select("event_id", parse_feed_time(text).alias("parsed"))


@query("rfc3339", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS text FROM events")
def _(spark, sf):
    return d.base(spark, sf, "events").select("event_id", rfc3339(F.col("ts")).alias("text"))


@query(
    "is_blank",
    f"SELECT id, coalesce({trim_sql('summary')}, '') = '' AS blank, {trim_sql('full_content')} AS trimmed FROM articles",
)
def _(spark, sf):
    return d.articles(spark, sf).select(
        "id",
        tx.is_blank(F.col("summary")).alias("blank"),
        tx.trim_ws(F.col("full_content")).alias("trimmed"),
    )


@query("summary_fallback", "SELECT id, coalesce(summary, 'summary unavailable') AS summary FROM articles")
def _(spark, sf):
    return d.articles(spark, sf).select("id", tx.summary_or_fallback(F.col("summary")).alias("summary"))


# -- message payloads ---------------------------------------------------

# An article without feed or date is announced as coming from an unknown feed, now.
DETAILED_SQL = """SELECT id, url, title, summary, posted_to_discord,
    CASE WHEN publish_date IS NOT NULL THEN feed_url END AS feed_url,
    CASE WHEN feed_url IS NOT NULL AND publish_date IS NOT NULL THEN publish_date
      ELSE TIMESTAMP '2025-07-15 14:30:00' END AS publish_date FROM articles"""
ELIGIBLE_SQL = f"""SELECT * FROM ({DETAILED_SQL}) WHERE summary IS NOT NULL AND summary <> 'summary unavailable'
    AND NOT posted_to_discord AND NOT coalesce(contains(lower(feed_url), 'src4'), false)
    AND publish_date >= TIMESTAMP '2025-07-15 14:30:00' - INTERVAL 100 DAY
    AND trim(title) <> '' AND trim(url) <> ''"""


def payload_sql(where: str) -> str:
    q = "to_json"
    title, desc = truncate_words_sql("title", 256), truncate_words_sql("summary", 300)
    return f"""SELECT id, url, replace(replace(replace('{{"username":"storyloom","embeds":[{{"title":' || {q}({title})
        || ',"description":' || {q}({desc}) || ',"url":' || {q}(url)
        || ',"color":5793266,"timestamp":"' || strftime(publish_date, '%Y-%m-%dT%H:%M:%SZ')
        || '","footer":{{"text":"storyloom"}},"author":{{"name":"'
        || CASE WHEN feed_url IS NULL THEN 'Unknown Feed' ELSE string_split(feed_url, '/')[3] END || '"}}}}]}}',
        '&', '\\u0026'), '<', '\\u003c'), '>', '\\u003e') AS payload FROM ({where})"""


@query(
    "embed_payload",
    payload_sql(
        """SELECT * REPLACE (coalesce(publish_date, TIMESTAMP '2025-07-15 14:30:00') AS publish_date,
             coalesce(summary, 'no summary yet') AS summary) FROM articles"""
    ),
)
def _(spark, sf):
    # As announced: articles without a date count as of now.
    dated = {"publish_date": F.coalesce("publish_date", F.lit(d.ARTICLE_NOW).cast("timestamp"))}
    rows = d.articles(spark, sf).withColumns({**dated, "summary": F.coalesce("summary", F.lit("no summary yet"))})
    feed = F.when(F.col("feed_url").isNull(), ux.UNKNOWN_FEED).otherwise(ux.feed_title(F.col("feed_url")))
    payload = notify.message_json(F.col("title"), F.col("url"), F.col("summary"), F.col("publish_date"), feed)
    return rows.select("id", "url", payload.alias("payload"))


@query("payload_size_ok", f"SELECT id, strlen(payload) <= 2000 AS size_ok FROM ({payload_sql(ELIGIBLE_SQL)})")
def _(spark, sf):
    rows = notify.notify_eligible(d.articles(spark, sf), d.ARTICLE_NOW, d.CUTOFF, [" SRC4 ", ""])
    payload = notify.message_json(*[F.col(c) for c in ("title", "url", "summary", "publish_date", "feed_title")])
    return rows.select("id", notify.payload_size_ok(payload).alias("size_ok"))


@query("notify_eligible", f"SELECT id, url FROM ({ELIGIBLE_SQL})")
def _(spark, sf):
    return notify.notify_eligible(d.articles(spark, sf), d.ARTICLE_NOW, d.CUTOFF, [" SRC4 ", ""]).select("id", "url")


@query(
    "notification_sink",
    f"""SELECT id, url AS article_url, w AS webhook_url, payload, strlen(payload) <= 2000 AS size_ok
        FROM ({payload_sql(ELIGIBLE_SQL)}), unnest(['{d.WEBHOOKS[0]}', '{d.WEBHOOKS[1]}']) AS u(w)""",
)
def _(spark, sf):
    hooks = [*d.WEBHOOKS, " "]
    return notify.notification_payloads(d.articles(spark, sf), hooks, d.ARTICLE_NOW, d.CUTOFF, [" SRC4 ", ""])


def _answer(webhook_url: str, payload: str) -> int:
    return 204 if webhook_url.endswith("token-a") else 500


DELIVERY_SQL = f"""SELECT id, url AS article_url, hook AS webhook_url, n AS attempt,
          CASE WHEN strlen(payload) > 2000 THEN NULL WHEN hook LIKE '%token-a' THEN 204 ELSE 500 END::BIGINT
            AS response_code, strlen(payload) <= 2000 AND hook LIKE '%token-a' AS ok
        FROM ({payload_sql(ELIGIBLE_SQL)}), unnest(['{d.WEBHOOKS[0]}', '{d.WEBHOOKS[1]}']) AS u(hook),
          unnest([1, 2, 3]::BIGINT[]) AS t(n)
        WHERE n = 1 OR hook LIKE '%token-b' OR strlen(payload) > 2000"""


@query("notification_delivery", DELIVERY_SQL)
def _(spark, sf):
    payloads = notify.notification_payloads(d.articles(spark, sf), d.WEBHOOKS, d.ARTICLE_NOW, d.CUTOFF, ["src4"])
    return notify.deliver(payloads, _answer)


def _unreachable(webhook_url: str, payload: str) -> int:
    raise RuntimeError("a logged attempt must not be made again")


@query("notification_delivery_once", f"SELECT *, false AS in_doubt FROM ({DELIVERY_SQL})")
def _(spark, sf):
    ledger = shared_folder(spark, "deliveries")

    def sent(send):
        payloads = notify.notification_payloads(d.articles(spark, sf), d.WEBHOOKS, d.ARTICLE_NOW, d.CUTOFF, ["src4"])
        return notify.deliver_once(payloads, send, ledger, slots=8)

    sent(_answer).write.format("noop").mode("overwrite").save()
    return sent(_unreachable)


@query(
    "article_details",
    """SELECT w.id, 'https://src' || ((w.article_id - 1) % 20) || '.example.com/a/' || (w.article_id - 1) AS url,
         coalesce(a.feed_url, '') AS feed_url,
         CASE WHEN a.url IS NULL THEN 'Unknown Feed' ELSE string_split(a.feed_url, '/')[3] END AS feed_title,
         coalesce(a.publish_date, TIMESTAMP '2025-07-15 14:30:00') AS publish_date
       FROM webhook_logs w LEFT JOIN
         (SELECT * FROM articles WHERE feed_url IS NOT NULL AND publish_date IS NOT NULL) a ON a.id = w.article_id""",
)
def _(spark, sf):
    doc = F.col("article_id") - 1
    url = F.concat(F.lit("https://src"), (doc % 20).cast("string"), F.lit(".example.com/a/"), doc.cast("string"))
    requests = d.webhook_logs(spark, sf).select("id", url.alias("url"))
    return notify.article_details(requests, d.articles(spark, sf), d.ARTICLE_NOW)


# -- pages and feed documents -------------------------------------------


@query("page_scan", "SELECT url, html FROM page_fetches WHERE status = 200")
def _(spark, sf):
    return page_scan(d.page_fetches(spark, sf))


@query("extract_main_content", "SELECT page_id, body AS content FROM page_texts")
def _(spark, sf):
    return d.base(spark, sf, "pages").select("page_id", extract_main_content(F.col("html")).alias("content"))


@query("body_min_length", "SELECT page_id, strlen(content) >= 400 AS long_enough FROM page_contents")
def _(spark, sf):
    content = extract_main_content(F.col("html"))
    return d.base(spark, sf, "pages").select("page_id", reextract.body_long_enough(content).alias("long_enough"))


REEXTRACT_SQL = """SELECT f.page_id + 1 AS id, CASE WHEN status <> 200 THEN 'failed' WHEN strlen(content) < 400
      THEN 'skipped' ELSE 'updated' END AS outcome, content
    FROM page_fetches f JOIN page_contents c USING (page_id) WHERE f.url ILIKE '%example.com%'"""


@query(
    "reextract",
    f"""SELECT a.id, a.url, CASE WHEN outcome = 'updated' THEN content ELSE a.full_content END AS full_content,
          CASE WHEN outcome = 'updated' THEN NULL ELSE a.summary END AS summary,
          CASE WHEN outcome = 'updated' THEN TIMESTAMP '2025-07-15 14:30:00' ELSE a.updated_at END AS updated_at
        FROM page_articles a LEFT JOIN ({REEXTRACT_SQL}) r USING (id)""",
)
def _(spark, sf):
    arts = d.page_articles(spark, sf)
    outcomes = reextract.reextract_outcomes(arts, d.page_fetches(spark, sf), "Example.com")
    return reextract.reextract(arts, outcomes, d.ARTICLE_NOW)


@query("backfill_report", f"SELECT outcome, count(*) AS n FROM ({REEXTRACT_SQL}) GROUP BY 1")
def _(spark, sf):
    arts = d.page_articles(spark, sf)
    return reextract.backfill_report(reextract.reextract_outcomes(arts, d.page_fetches(spark, sf), "Example.com"))


@query(
    "feed_list",
    """SELECT 'https://' || source || '.example.com/feed?d=' || doc_id AS feed_url FROM documents
       WHERE doc_id % 3 <> 1""",
)
def _(spark, sf):
    url = F.concat(F.lit("https://"), "source", F.lit(".example.com/feed?d="), "doc_id")
    k = F.col("doc_id") % 3
    line = F.when(k == 0, url).when(k == 1, F.concat(F.lit("  # "), url)).otherwise(F.concat(F.lit("\t "), url, F.lit(" ")))
    lines = d.base(spark, sf, "documents").select(F.explode(F.array(line, F.lit("   "))).alias("value"))
    return parse_feed_list(lines)


def _escaped(c):
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def _element(name, text):
    """Nothing where the text is NULL."""
    return F.coalesce(F.concat(F.lit(f"<{name}>"), text, F.lit(f"</{name}>")), F.lit(""))


def _rss_date():
    return F.concat(F.date_format("publish_date", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))


def _rss_document(title, rest):
    return F.concat(
        F.lit('<?xml version="1.0"?><rss version="2.0"><channel><title>t</title><item><title>'),
        title, F.lit("</title><link> "), F.col("url"), F.lit(" </link>"), _element("pubDate", _rss_date()),
        F.lit("<description>"), _escaped(F.col("full_content")), F.lit("</description></item>"), rest,
    )


def _atom_document():
    return F.concat(
        F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><title>t</title><entry><title>'),
        _escaped(F.col("title")), F.lit('</title><link rel="self" href="x"/><link href="'), F.col("url"),
        F.lit('"/>'), _element("updated", rfc3339(F.col("publish_date"))), F.lit("<summary>"),
        _escaped(F.col("full_content")), F.lit("</summary></entry></feed>"),
    )


SECOND = "<item><title>second</title></item></channel></rss>"


def _feed_documents(spark, sf):
    """One landed feed document per article: RSS for even ids, Atom for odd ones."""
    rss = _rss_document(_escaped(F.col("title")), F.lit(SECOND))
    return d.articles(spark, sf).select("id", F.when(F.col("id") % 2 == 0, rss).otherwise(_atom_document()).alias("xml"))


@query(
    "feed_items",
    """SELECT CAST(id AS VARCHAR) AS feed_url, 0::BIGINT AS item_no, url AS link, trim(title) AS title,
         publish_date AS published, trim(full_content) AS description FROM articles
       UNION ALL SELECT CAST(id AS VARCHAR), 1, NULL, 'second', NULL, NULL FROM articles WHERE id % 2 = 0""",
)
def _(spark, sf):
    docs = _feed_documents(spark, sf)
    return parse_feeds(docs.select(F.col("id").cast("string").alias("feed_url"), "xml"))


def _feed_shapes(spark, sf):
    """A document per article: RSS, RSS 1.0, Atom, RSS with bare ampersands, RSS cut off in its second item, a page."""
    title, dated = _escaped(F.col("title")), rfc3339(F.col("publish_date"))
    rdf = F.concat(
        F.lit('<rdf:RDF xmlns:rdf="r" xmlns:dc="d"><channel><title>t</title></channel><item><title>'), title,
        F.lit("</title><link>"), F.col("url"), F.lit("</link>"), _element("dc:date", dated), F.lit("<description>"),
        _escaped(F.col("full_content")), F.lit("</description></item></rdf:RDF>"),
    )
    bare = _rss_document(F.concat(F.lit("Q & A, AT&T &eacute;: "), title), F.lit(SECOND))
    k = F.col("id") % 6
    xml = (
        F.when(k == 0, _rss_document(title, F.lit(SECOND)))
        .when(k == 1, rdf)
        .when(k == 2, _atom_document())
        .when(k == 3, bare)
        .when(k == 4, _rss_document(title, F.lit("<item><title>sec")))
        .otherwise(F.concat(F.lit("<html><body>"), _escaped(F.col("full_content")), F.lit("</body></html>")))
    )
    return d.articles(spark, sf).select(F.col("id").cast("string").alias("feed_url"), xml.alias("xml"))


@query(
    "feed_items_of_all_shapes",
    """SELECT CAST(id AS VARCHAR) AS feed_url, 0::BIGINT AS item_no, url AS link,
         CASE WHEN id % 6 = 3 THEN 'Q & A, AT&T é: ' || rtrim(title) ELSE trim(title) END AS title,
         publish_date AS published, trim(full_content) AS description FROM articles WHERE id % 6 <> 5
       UNION ALL SELECT CAST(id AS VARCHAR), 1, NULL, 'second', NULL, NULL FROM articles WHERE id % 6 IN (0, 3)""",
)
def _(spark, sf):
    return parse_feeds(_feed_shapes(spark, sf))


@query(
    "feed_outcomes",
    """SELECT CAST(id AS VARCHAR) AS feed_url, CASE WHEN id % 6 < 4 THEN 'success' ELSE 'error' END AS status,
         CASE WHEN id % 6 < 4 THEN '' ELSE 'parse_failed' END AS message,
         CASE id % 6 WHEN 0 THEN 2 WHEN 3 THEN 2 WHEN 5 THEN 0 ELSE 1 END AS articles_found FROM articles""",
)
def _(spark, sf):
    return parse_outcomes(_feed_shapes(spark, sf)).select("feed_url", "status", "message", "articles_found")


@query("feed_xml_unwrap", "SELECT id, md5(x) AS digest FROM (SELECT id, x FROM feed_docs)")
def _(spark, sf):
    xml, k = F.col("xml"), F.col("id") % 4
    escaped = F.replace(F.replace(F.replace(xml, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    shell = (
        F.when(k == 0, F.concat(F.lit("  \n"), xml, F.lit("\n")))
        .when(k == 1, F.concat(F.lit("<html><head><title>x</title></head><body><pre>"), escaped, F.lit("</pre></body></html>")))
        .when(k == 2, F.concat(F.lit("<html><body><div>"), escaped, F.lit("</div></body></html>")))
        .otherwise(
            F.concat(F.lit('<html><body><div id="webkit-xml-viewer-source-xml">'), xml, F.lit("</div><pre>p</pre></body></html>"))
        )
    )
    envelope = F.to_json(
        F.struct(
            F.lit("ok").alias("status"),
            F.lit("").alias("message"),
            F.struct(F.lit(200).alias("status"), shell.alias("response")).alias("solution"),
        )
    )
    landed = _feed_documents(spark, sf).select("id", envelope.alias("envelope"))
    shells = landed.select("id", solver_response(F.col("envelope")).alias("shell"))
    return shells.select("id", unwrap_feed_xml(F.col("shell")).alias("xml")).select("id", F.md5("xml").alias("digest"))

