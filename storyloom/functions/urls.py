"""URL and status-code expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mask text, challenge codes, delivery error classes.
HIDDEN_TOKEN = "***TOKEN_HIDDEN***"
MASK_MIN_PARTS = 7
CHALLENGE_CODES = (403, 429, 503)
CHALLENGE_RANGE = (520, 527)
UNKNOWN_FEED = "Unknown Feed"


def mask_webhook_url(url: Column) -> Column:
    """Hide the last path part (the token) of a webhook address."""
    parts = F.split(url, "/")
    head = F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/")
    return F.when(F.size(parts) >= MASK_MIN_PARTS, F.concat(head, F.lit("/" + HIDDEN_TOKEN))).otherwise(url)


def feed_title(feed_url: Column) -> Column:
    """Authority part of a feed address, port and user info included."""
    return F.regexp_extract(feed_url, r"(?s)^(?:.*?://)?([^/]*)", 1)


def feed_excluded(feed_url: Column, excluded: Sequence[str]) -> Column:
    needles = [e.strip().lower() for e in excluded if e.strip()]
    hit = F.lit(False)
    for needle in needles:
        hit = hit | F.contains(F.lower(feed_url), F.lit(needle))
    return F.coalesce(hit, F.lit(False))


def is_challenge_status(code: Column) -> Column:
    return code.isin(*CHALLENGE_CODES) | code.between(*CHALLENGE_RANGE)


def delivery_error_class(code: Column) -> Column:
    """Class of a failed delivery; no response code means the transport failed."""
    return (
        F.when(code.isNull(), "network_error")
        .when(code.between(400, 499), "client_error")
        .when(code >= 500, "server_error")
        .otherwise("unknown")
    )
