"""Joining many rows to one row per key when a few keys hold most of the rows.

Adaptive execution splits skewed partitions of a join only while both sides are plain shuffles. It
cannot when the other side was just grouped by the same key, so those joins spread hot keys here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key with more than this share of all rows is hot, so there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 1 / 200
TRACKED = 10_000
# Rows of a hot key go to groups of about this share of the table each; those of no key to NULL_GROUPS.
GROUP_SHARE = 1 / 1024
NULL_GROUPS = 64


def hot_keys(rows: DataFrame, key: str) -> DataFrame:
    """(key, _groups): the hot keys of ``rows`` and how many groups to deal each of them to.

    One small pass with mergeable counters, no shuffle of the rows.
    """
    top = rows.agg(
        F.expr(f"approx_top_k(`{key}`, {int(1 / HOT_SHARE)}, {TRACKED})").alias("_top"),
        F.count(F.lit(1)).alias("_n"),
    )
    found = top.select("_n", F.explode("_top").alias("_t"))
    groups = F.ceil(F.col("_t.count") / (F.col("_n") * GROUP_SHARE)).cast("int")
    return found.filter(F.col("_t.count") > F.col("_n") * HOT_SHARE).select(
        F.col("_t.item").alias(key), groups.alias("_groups")
    )


def lookup_join(rows: DataFrame, lookup: DataFrame, key: str, spread_by: Sequence[str]) -> DataFrame:
    """Left join of ``rows`` to ``lookup`` (one row per key).

    Rows of a hot key are dealt to groups by the hash of ``spread_by``, the more the more rows it has, and
    the key's one lookup row is copied to each of them. NULL keys match nothing and are dealt out as well.
    """
    hot = F.broadcast(hot_keys(rows, key).filter(F.col(key).isNotNull()))  # at most 1 / HOT_SHARE rows
    groups = F.coalesce("_groups", F.when(F.col(key).isNull(), NULL_GROUPS).otherwise(1))
    dealt = F.pmod(F.xxhash64(*spread_by), groups).cast("int")
    left = rows.join(hot, key, "left").withColumn("_group", dealt).drop("_groups")
    copies = F.sequence(F.lit(0), F.coalesce("_groups", F.lit(1)) - 1)
    right = lookup.join(hot, key, "left").withColumn("_group", F.explode(copies)).drop("_groups")
    return left.join(right, [key, "_group"], "left").drop("_group")
