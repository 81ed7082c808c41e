"""Merges into a stored article table that read and write only what they change.

The table lies in folders by the day a row was created, which never changes. A merge finds the stored rows it meets
by a join of narrow columns, writes the folders of their days again (dynamic partition overwrite) and appends the
rest. Other days are neither read nor written, but for the key and the day of their rows. Every merge may be run again
after a failure at any point: stored rows get the same values once more, rows already inserted are met as stored.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.operators.ordering import SLICE_ROWS, number_rows
from storyloom.operators.tables import fold_batch, inserted_rows, keyed_update, updated_rows
from storyloom.session import durable
from storyloom.sources.tables import DAY, append

CREATED = "created_at"


def write_table(rows: DataFrame, path: str) -> None:
    """Begin (or go on with) a table that merges can be applied to."""
    append(rows, path, day_of=CREATED)


def _stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(T.StructType([*schema.fields, T.StructField(DAY, T.DateType())])).parquet(path)


def _on_days(stored: DataFrame, days: Sequence[date | None]) -> DataFrame:
    """Rows of ``days``, of which there are as many as the archive has at most; a plain list prunes the folders."""
    known = [d for d in days if d is not None]
    wanted = F.col(DAY).isin(known) if known else F.lit(False)
    return stored.filter(wanted | F.col(DAY).isNull() if None in days else wanted)


def _hits(stored: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, list[date | None]]:
    """Keys that are stored, and the days they lie in, from two columns of the table."""
    hits = durable(stored.select(key, DAY).join(keys.select(key), key, "left_semi"))
    return hits, [r[DAY] for r in hits.select(DAY).distinct().collect()]


def _overwrite_days(rows: DataFrame, path: str, days: Sequence[date | None]) -> None:
    if days:
        # Small days share tasks, and a large one is split.
        laid = rows.withColumn(DAY, F.to_date(CREATED)).hint("rebalance", DAY)
        laid.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(path)


def next_ids(rows: DataFrame, stored: DataFrame, order: Sequence[Column], slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(url, id): the ids after the highest stored one, in ``order``, which must be total. Only url and order are sorted."""
    places = [f"_o{i}" for i in range(len(order))]
    narrow = rows.select("url", *[o.alias(p) for o, p in zip(order, places, strict=True)])
    numbered = number_rows(narrow, [], [F.col(p).asc_nulls_first() for p in places], out="_no", slice_rows=slice_rows)
    last = stored.agg(F.max("id")).first()[0] or 0
    return numbered.select("url", (F.col("_no") + F.lit(last)).alias("id"))


def _new_rows(fresh: DataFrame, stored: DataFrame, order: Sequence[Column], now: datetime, schema: T.StructType) -> DataFrame:
    """``fresh`` (one row a url) as rows of the table with ids of their own, kept before anything is overwritten."""
    fresh = durable(fresh)
    return durable(inserted_rows(fresh.join(next_ids(fresh, stored, [*order, F.col("url")]), "url"), schema, now))


def merge_insert_ignore(
    spark: SparkSession, path: str, schema: T.StructType, incoming: DataFrame, order: Sequence[Column], now: datetime
) -> None:
    """Append the first row, in ``order`` (NULLs first), of every url that is not stored."""
    stored = _stored(spark, path, schema)
    place = F.struct(*order)  # NULLs come first in it, too
    first = incoming.groupBy("url").agg(F.min_by(F.struct(*[c for c in incoming.columns if c != "url"]), place).alias("_row"))
    fresh = first.join(stored.select("url"), "url", "left_anti").select("url", "_row.*")
    append(_new_rows(fresh, stored, order, now, schema), path, day_of=CREATED)


def merge_upsert(
    spark: SparkSession, path: str, schema: T.StructType, incoming: DataFrame, now: datetime, order_col: str = "batch_no"
) -> None:
    """Upsert by url; ``incoming`` may repeat urls. New rows are numbered in batch order.

    Stored rows keep id, creation time, vector and cluster.
    """
    batch = durable(fold_batch(incoming, order_col))
    stored = _stored(spark, path, schema)
    hits, days = _hits(stored, batch, "url")
    met = batch.join(hits.select("url"), "url", "left_semi")
    fresh = batch.join(hits.select("url"), "url", "left_anti")
    new = _new_rows(fresh, stored, [F.col(order_col)], now, schema)
    _overwrite_days(updated_rows(_on_days(stored, days).drop(DAY), met, now), path, days)
    append(new, path, day_of=CREATED)


def merge_update(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    updates: DataFrame,
    key: str,
    set_columns: Sequence[str],
    now: datetime | None = None,
    fixed: Mapping[str, Column] | None = None,
) -> None:
    """``tables.keyed_update`` on the days that hold a row of ``updates``."""
    stored = _stored(spark, path, schema)
    _, days = _hits(stored, updates, key)
    _overwrite_days(keyed_update(_on_days(stored, days).drop(DAY), updates, key, set_columns, now, fixed), path, days)
