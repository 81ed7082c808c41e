"""Table writes as whole-frame merges: insert-or-ignore, upsert, keyed update, cascade, append."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.operators.ordering import SLICE_ROWS, number_rows

# How an upsert treats each column.
OVERWRITTEN = ("title", "fetch_time", "posted_to_discord")
KEPT_IF_NULL = ("publish_date", "summary", "full_content", "feed_url", "content_hash", "fetch_duration_ms")
INCOMING = (
    "title", "url", "publish_date", "summary", "full_content",
    "fetch_time", "posted_to_discord", "feed_url", "content_hash", "fetch_duration_ms",
)


def convert_articles(items: DataFrame, now: datetime) -> DataFrame:
    """Feed structs to table rows: empty values become NULL, nanoseconds become milliseconds.

    Input: title, url, published_at, content, feed_url, content_hash, fetch_duration_ns.
    """
    at = F.lit(now).cast("timestamp")
    ms = F.expr("fetch_duration_ns div 1000000").cast("int")
    return items.select(
        "title",
        "url",
        F.col("published_at").alias("publish_date"),
        F.lit(None).cast("string").alias("summary"),
        F.nullif("content", F.lit("")).alias("full_content"),
        at.alias("fetch_time"),
        F.lit(False).alias("posted_to_discord"),
        F.nullif("feed_url", F.lit("")).alias("feed_url"),
        F.nullif("content_hash", F.lit("")).alias("content_hash"),
        F.when(F.col("fetch_duration_ns") > 0, ms).alias("fetch_duration_ms"),
        at.alias("created_at"),
        at.alias("updated_at"),
    )


def _max_id(df: DataFrame) -> int:
    return df.agg(F.max("id")).first()[0] or 0


def with_new_ids(
    rows: DataFrame,
    existing: DataFrame,
    order: Sequence[Column],
    slice_rows: int = SLICE_ROWS,
    narrow: Sequence[str] | None = None,
) -> DataFrame:
    """Give ``rows`` the ids that follow the highest stored one. ``order`` must be total.

    ``narrow`` names the columns that ``order`` is made of, the first of which tells rows apart. Only they are
    numbered then, a slice at a time, and the rows, which may hold whole texts, meet their ids in a join.
    """
    numbered = number_rows(rows if narrow is None else rows.select(*narrow), [], order, out="_no", slice_rows=slice_rows)
    given = F.col("_no") + F.lit(_max_id(existing))
    if narrow is None:
        return numbered.withColumn("id", given).drop("_no")
    ids = numbered.select(F.col(narrow[0]).alias("_key"), given.alias("id"))
    return rows.drop("id").join(ids, F.col(narrow[0]).eqNullSafe(F.col("_key"))).drop("_key")


def new_by_url(articles: DataFrame, incoming: DataFrame, order: Sequence[Column]) -> DataFrame:
    """First incoming row per url, in ``order``, among urls not stored yet."""
    w = Window.partitionBy("url").orderBy(*order)
    first = incoming.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
    return first.join(articles.select("url"), "url", "left_anti")


def insert_ignore(
    articles: DataFrame, incoming: DataFrame, order: Sequence[Column], order_cols: Sequence[str] | None = None
) -> DataFrame:
    """The table after inserting, with rows of already stored urls left alone.

    With ``order_cols``, the columns that ``order`` is made of, new rows are numbered by these alone.
    """
    fresh = new_by_url(articles, incoming, order)
    narrow = None if order_cols is None else ["url", *[c for c in order_cols if c != "url"]]
    rows = with_new_ids(fresh, articles, [*order, F.col("url")], narrow=narrow)
    return articles.unionByName(rows.select(*articles.columns))


def fold_batch(incoming: DataFrame, order_col: str) -> DataFrame:
    """One row per url with the effect of applying the rows one by one in ``order_col``.

    Aggregates combine before the shuffle, so a url repeated very often costs one row per task.
    """
    position = F.col(order_col)

    def last(c: str) -> Column:
        return F.max_by(c, position)

    def last_known(c: str) -> Column:
        return F.max_by(c, F.when(F.col(c).isNotNull(), position))

    return incoming.groupBy("url").agg(
        *[last(c).alias(c) for c in OVERWRITTEN],
        *[last_known(c).alias(c) for c in KEPT_IF_NULL],
        F.min(order_col).alias(order_col),
    )


def upsert(articles: DataFrame, incoming: DataFrame, now: datetime, order_col: str = "batch_no") -> DataFrame:
    """The table after upserting by url; ``incoming`` may repeat urls.

    Stored rows keep id, creation time, vector and cluster. New rows are numbered in batch order.
    """
    batch = fold_batch(incoming, order_col)
    fresh = batch.join(articles.select("url"), "url", "left_anti")
    fresh = with_new_ids(fresh, articles, [F.col(order_col)], narrow=["url", order_col])
    return updated_rows(articles, batch, now).unionByName(inserted_rows(fresh, articles.schema, now))


def updated_rows(articles: DataFrame, batch: DataFrame, now: datetime) -> DataFrame:
    """Stored rows with what ``batch`` (one row a url) says of theirs."""
    at = F.lit(now).cast("timestamp")
    old = articles.alias("o")
    new = batch.withColumn("_hit", F.lit(True)).alias("n")
    merged = old.join(new, "url", "left")
    hit = F.col("n._hit").isNotNull()
    updated = []
    for c in articles.columns:
        if c == "url":
            updated.append(F.col("url"))
        elif c in OVERWRITTEN:
            updated.append(F.when(hit, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
        elif c in KEPT_IF_NULL:
            updated.append(F.coalesce(f"n.{c}", f"o.{c}").alias(c))
        elif c == "updated_at":
            updated.append(F.when(hit, at).otherwise(F.col("o.updated_at")).alias(c))
        else:
            updated.append(F.col(f"o.{c}"))
    return merged.select(*updated)


def inserted_rows(fresh: DataFrame, schema: T.StructType, now: datetime) -> DataFrame:
    """New rows (with id) as rows of the table: created now, without vector and cluster."""
    at = F.lit(now).cast("timestamp")
    given = {*INCOMING, "id"}
    inserted = []
    for field in schema:
        if field.name in given:
            inserted.append(F.col(field.name))
        elif field.name in ("created_at", "updated_at"):
            inserted.append(at.alias(field.name))
        else:
            inserted.append(F.lit(None).cast(field.dataType).alias(field.name))
    return fresh.select(*inserted)


def keyed_update(
    table: DataFrame,
    updates: DataFrame,
    key: str,
    set_columns: Sequence[str],
    now: datetime | None = None,
    fixed: Mapping[str, Column] | None = None,
) -> DataFrame:
    """UPDATE ... WHERE key matches; ``fixed`` sets constants.

    A key that ``updates`` repeats takes the largest of its rows, so the table keeps its number of rows.
    """
    fixed = dict(fixed or {})
    if now is not None and "updated_at" in table.columns:
        fixed["updated_at"] = F.lit(now).cast("timestamp")
    # Grouped by the key that the join needs anyway: no further shuffle.
    folded = updates.groupBy(key).agg(F.max(F.struct(F.lit(True).alias("_hit"), *set_columns)).alias("_new"))
    new = folded.select(key, *[F.col(f"_new.{c}").alias(f"_new_{c}") for c in set_columns], F.col("_new._hit").alias("_hit"))
    hit = F.col("_hit").isNotNull()
    out = []
    for c in table.columns:
        if c in set_columns:
            out.append(F.when(hit, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c))
        elif c in fixed:
            out.append(F.when(hit, fixed[c]).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return table.join(new, key, "left").select(*out)


def unmatched_updates(table: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Updates that name no stored row; the status updates treat these as errors."""
    return updates.join(table.select(key), key, "left_anti")


def cascade_delete(child: DataFrame, parents: DataFrame, foreign_key: str = "article_id") -> DataFrame:
    """Child rows left once every row without a surviving parent is gone."""
    return child.join(parents.select(F.col("id").alias(foreign_key)), foreign_key, "left_semi")


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    counts = [
        df.agg(F.count(F.lit(1)).alias("record_count")).select(F.lit(name).alias("table_name"), "record_count")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def unique_violations(articles: DataFrame, key: str) -> DataFrame:
    """Values that break a uniqueness rule; NULLs never do."""
    return (
        articles.filter(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))
        .filter("n > 1")
        .select(F.lit(key).alias("key"), "value", "n", "first_id")
    )
