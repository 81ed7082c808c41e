"""Numbering rows inside groups that may be far larger than one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.session import durable

SLICE_ROWS = 1_000_000


def order_slices(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], slice_rows: int = SLICE_ROWS, sort: bool = False
) -> tuple[DataFrame, int]:
    """Add ``_slice``: consecutive ranges of (keys, order) holding about ``slice_rows`` rows each.

    A hot key spreads over many slices. The ranged rows are checkpointed so that every use,
    and every retry, sees the same boundaries. With ``sort``, a slice's rows lie in order, too.
    Data that fits one slice is left as it is. Also returns the number of slices.
    """
    slices = -(-df.count() // slice_rows)
    if slices <= 1:
        return df.withColumn("_slice", F.lit(0)), 1
    ranged = df.repartitionByRange(slices, *[F.col(k) for k in keys], *order)
    if sort:
        ranged = ranged.sortWithinPartitions(*[F.col(k) for k in keys], *order)
    return durable(ranged.withColumn("_slice", F.spark_partition_id())), slices


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    out: str = "row_no",
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """``row_number`` per ``keys``, computed slice by slice plus the rows of earlier slices.

    ``order`` must be a total order within each key, and keys must not be NULL.
    """
    sliced, slices = order_slices(df, keys, order, slice_rows)
    here = [*keys, "_slice"]
    local = F.row_number().over(Window.partitionBy(*here).orderBy(*order)).cast("long")
    if slices == 1:
        return sliced.withColumn(out, local).drop("_slice")
    # One row per key and slice: a key's window holds at most as many rows as there are slices.
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(*here)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*here, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    )
    return (
        sliced.withColumn(out, local)
        .join(offsets, here)
        .withColumn(out, F.col(out) + F.col("_before"))
        .select(*df.columns, out)
    )


def along(
    rows: DataFrame,
    keys: Sequence[str],
    order: str,
    block: int,
    sums: Mapping[str, str] | None = None,
    previous: Mapping[str, str] | None = None,
    following: str | None = None,
) -> DataFrame:
    """``rows`` with what depends on the other rows of their keys, in the order of the whole number ``order``.

    ``sums`` (new column: summed column) runs up to and with the row, NULLs counting as 0, ``previous`` takes the row
    before's value, and ``following`` names a column for the next row's ``order``, NULL where there is no such row. ``order`` must
    tell the rows of a key apart. A key's rows are cut into blocks of ``block`` steps of ``order``, each a window of
    its own; sums, last values and first places are carried between blocks. Keys may be NULL.
    """
    sums, previous = dict(sums or {}), dict(previous or {})
    blocked = rows.withColumn("_block", F.floor(F.col(order) / block))
    inside = Window.partitionBy(*keys, "_block").orderBy(order)
    over_blocks = Window.partitionBy(*keys).orderBy("_block")
    totals = [F.sum(c).alias(f"_sum_{out}") for out, c in sums.items()]
    lasts = [F.max_by(F.struct(F.col(c).alias("v")), order).alias(f"_last_{out}") for out, c in previous.items()]
    blocks = blocked.groupBy(*keys, "_block").agg(F.min(order).alias("_first"), *totals, *lasts)
    carried = blocks.select(
        *[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)],
        F.col("_block").alias("_at_block"),
        F.lead("_first").over(over_blocks).alias("_next_first"),
        *[F.sum(f"_sum_{out}").over(over_blocks.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_sum_{out}") for out in sums],
        *[F.lag(f"_last_{out}").over(over_blocks).alias(f"_last_{out}") for out in previous],
    )
    local = blocked.select(
        "*",
        F.lead(order).over(inside).alias("_next"),
        *[F.sum(c).over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias(f"_here_{out}") for out, c in sums.items()],
        *[F.lag(F.struct(F.col(c).alias("v"))).over(inside).alias(f"_before_{out}") for out, c in previous.items()],
    )
    same = [F.col(k).eqNullSafe(F.col(f"_key_{i}")) for i, k in enumerate(keys)]
    joined = local.join(carried, reduce(Column.__and__, same, F.col("_block") == F.col("_at_block")))
    out = [F.coalesce("_next", "_next_first").alias(following)] if following else []
    return joined.select(
        *rows.columns,
        *[(F.coalesce(f"_sum_{o}", F.lit(0)) + F.coalesce(f"_here_{o}", F.lit(0))).alias(o) for o in sums],
        *[F.coalesce(f"_before_{o}", f"_last_{o}")["v"].alias(o) for o in previous],
        *out,
    )
