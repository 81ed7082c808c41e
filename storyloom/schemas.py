"""Table contracts. Readers always pass these schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(n, t, null) for n, t, null in fields])


_L, _I, _S, _B, _TS = T.LongType(), T.IntegerType(), T.StringType(), T.BooleanType(), T.TimestampType()

ARTICLES = _struct(
    ("id", _L, False),
    ("title", _S, False),
    ("url", _S, False),
    ("publish_date", _TS, True),
    ("summary", _S, True),
    ("full_content", _S, True),
    ("fetch_time", _TS, True),
    ("posted_to_discord", _B, True),
    ("created_at", _TS, True),
    ("updated_at", _TS, True),
    ("feed_url", _S, True),
    ("content_hash", _S, True),
    ("fetch_duration_ms", _I, True),
    ("summary_embedding", T.ArrayType(T.FloatType()), True),
    ("story_cluster_id", _L, True),
)

WEBHOOK_LOGS = _struct(
    ("id", _L, False),
    ("article_id", _L, False),
    ("attempt", _I, False),
    ("response_code", _I, True),
    ("response_body", _S, True),
    ("latency_ms", _I, True),
    ("error_message", _S, True),
    ("created_at", _TS, True),
)

FETCH_LOGS = _struct(
    ("id", _L, True),
    ("feed_url", _S, False),
    ("status", _S, False),
    ("message", _S, True),
    ("duration_ms", _I, True),
    ("articles_found", _I, True),
    ("new_articles", _I, True),
    ("created_at", _TS, True),
)

SUMMARY_LOGS = _struct(
    ("id", _L, True),
    ("article_url", _S, False),
    ("model", _S, False),
    ("status", _S, False),
    ("summary", _S, True),
    ("error_message", _S, True),
    ("duration_ms", _I, False),
    ("retry_attempt", _I, False),
    ("created_at", _TS, False),
)

DELIVERY_ERROR_LOGS = _struct(
    ("id", _L, True),
    ("webhook_url", _S, False),
    ("article_url", _S, False),
    ("error_message", _S, False),
    ("status_code", _I, True),
    ("retry_attempt", _I, False),
    ("duration_ms", _I, False),
    ("created_at", _TS, False),
)

# One admitted-or-not feed entry. item_no is its place in the feed document.
ITEMS = _struct(
    ("feed_url", _S, True),
    ("item_no", _L, False),
    ("link", _S, True),
    ("title", _S, True),
    ("published", _TS, True),
    ("description", _S, True),
)
