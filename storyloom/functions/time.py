"""Windows and timestamp parsing. Nothing here reads the clock."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# Days per digest range, corroboration window, RFC 822 zone offsets.
RANGE_DAYS = {"daily": 1, "weekly": 7, "monthly": 30, "quarterly": 90, "halfyearly": 182, "yearly": 365}
DEFAULT_RANGE = "daily"
CLUSTER_WINDOW_DAYS = 35
ZONE_OFFSETS = {
    "UT": "+0000", "UTC": "+0000", "GMT": "+0000", "Z": "+0000",
    "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500",
    "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700",
}


def range_or_default(name: str | None) -> str:
    return name if name in RANGE_DAYS else DEFAULT_RANGE


def digest_since(range_name: str | None, now: datetime) -> datetime:
    return now - timedelta(days=RANGE_DAYS[range_or_default(range_name)])


def digest_count_since(since: datetime, now: datetime, cluster_days: int) -> datetime:
    """Coverage is counted over the wider of the listing and the cluster window."""
    return min(since, now - timedelta(days=cluster_days)) if cluster_days > 0 else since


def days_before(now: Column, days: Column) -> Column:
    return now - F.make_dt_interval(days)


def digest_since_column(range_name: Column, now: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in RANGE_DAYS.items() for x in kv])
    return days_before(now, F.coalesce(F.try_element_at(table, range_name), F.lit(RANGE_DAYS[DEFAULT_RANGE])))


def digest_count_since_column(since: Column, now: Column, cluster_days: Column) -> Column:
    return F.when(cluster_days > 0, F.least(since, days_before(now, cluster_days))).otherwise(since)


def parse_multi_timestamp(text: Column, default: Column) -> Column:
    """RFC 3339, then a plain date, then date and time without zone, else the default."""
    return F.coalesce(
        F.when(
            text.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d([.,]\d+)?(Z|[+-]\d\d:\d\d)$"),
            F.try_to_timestamp(F.replace(text, F.lit(","), F.lit("."))),
        ),
        F.when(text.rlike(r"^\d{4}-\d\d-\d\d$"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))),
        F.when(
            text.rlike(r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d$"),
            F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")),
        ),
        default,
    )


def parse_feed_time(text: Column) -> Column:
    """RFC 822 or RFC 3339 feed dates as UTC instants; zone names use fixed offsets, unknown ones none.

    Days may be named, months long or short, years of two digits (69 and later: last century), and blanks
    hyphens.
    """
    plain = F.regexp_replace(F.trim(text), r"^[A-Za-z]+,?\s+(?=\d)", "")
    plain = F.regexp_replace(plain, r"^(\d{1,2})[- ]([A-Za-z]{3})[a-z]*\.?[- ](\d{2}|\d{4})(?= )", "$1 $2 $3")
    plain = F.regexp_replace(plain, r"^(\d{1,2} [A-Za-z]{3}) (69|[7-9]\d)(?= )", "$1 19$2")
    plain = F.regexp_replace(plain, r"^(\d{1,2} [A-Za-z]{3}) (\d\d)(?= )", "$1 20$2")
    for name, offset in ZONE_OFFSETS.items():
        plain = F.regexp_replace(plain, rf"\s{name}$", f" {offset}")
    plain = F.regexp_replace(plain, r"(?<=\d) [A-Z]{3,5}$", " +0000")
    rfc822 = F.when(
        plain.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4} \d\d:\d\d(:\d\d)? [+-]\d{4}$"),
        F.coalesce(
            F.try_to_timestamp(plain, F.lit("d MMM yyyy HH:mm:ss Z")),
            F.try_to_timestamp(plain, F.lit("d MMM yyyy HH:mm Z")),
        ),
    )
    iso = F.when(plain.rlike(r"^\d{4}-\d\d-\d\d([T ].*)?$"), F.try_to_timestamp(plain))
    return F.coalesce(rfc822, iso)


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssXXX")
