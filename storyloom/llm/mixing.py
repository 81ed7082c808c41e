"""Mixing sources to target weights: capped water-filling and seeded repetition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.llm.common import WORD, by_place

#: Slots that the fractional part of a source is cut into before single documents are looked at.
SLOTS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _draw(seed: int, *ids: Column) -> Column:
    """A seeded number of 0 to 2^32 - 1 for a row, the same on every run and in every engine with MD5."""
    key = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(i.cast("string"), F.lit("")) for i in ids])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), max_epochs: float = 3) -> DataFrame:
    """(source, source_size, target) for one row per source in ``sizes`` (source, source_size).

    Sources in code point order, null last, take ``weights`` in turn and share the whole size by them.
    A source stops at ``max_epochs`` times its size and the excess goes to the others by weight, again
    and again. That ends at the level L with sum(min(cap, weight x L)) = whole size. Going through the
    sources by the level at which each of them is full, all before the first that stays below its cap
    are full, so sums over that order give L. The table has one row per source, as many as there are
    sources and not rows, and is the only thing that is ordered as a whole.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    place = (F.row_number().over(by_name) - 1) % len(weights)
    weighed = sizes.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place + 1)).withColumn(
        "_cap", F.col("source_size") * F.lit(float(max_epochs))
    )
    everything = Window.partitionBy()
    by_level = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), F.col("source").cast("binary"))
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    weight_left = F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    at = F.row_number().over(by_level)
    reached = weighed.withColumn("_level", left / weight_left).withColumn("_at", at)
    open_level = F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct(F.col("_at"), F.col("_level")))
    level = F.min(open_level).over(everything)["_level"]
    return reached.withColumn("_found", level).select(
        "source",
        "source_size",
        F.when(F.col("_found").isNull(), F.col("_cap"))
        .otherwise(F.least(F.col("_cap"), F.col("_w") * F.col("_found")))
        .alias("target"),
    )


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, row, key): the first of two passes over the texts. Write it before ``mix`` reads it.

    ``row`` numbers the rows, so that equal rows stay apart; it is fixed once the table is written.
    ``key`` is a hash of the whole row, by which ``repeated`` finds it again.
    """
    rows, column = by_place(docs)
    return rows.select(
        column(id_col).cast("long").alias("doc_id"),
        column(source_col).cast("string").alias("source"),
        word_count(column(text_col).cast("string")).alias("size"),
        F.monotonically_increasing_id().alias("row"),
        F.xxhash64(*rows.columns).alias("key"),
    )


def mix(rows: DataFrame, weights: Sequence[float] = (1, 2, 3), max_epochs: float = 3, seed: int = 7) -> DataFrame:
    """``rows`` (doc_id, source, size, row, key) plus source_size, target and copies.

    Every row of a source is taken floor(target / source_size) times whole. What is missing to the target
    is taken once more from rows in the order of a seeded draw as long as they fit, and then from the one
    row left whose size is nearest to the rest, if that is nearer than none. The draw is cut into slots
    that are summed per source first: only the one slot in which the target falls is ordered row by row,
    so a source that holds a third of all rows costs no task more than 1/4096 of it.

    Nulls: a null source is one source, the last; a null id draws like an empty one. A source of no words
    has target 0 and no copies. Ties in the draw are ordered by id, size and row. No rows give no rows.
    Other columns of ``rows`` are left out.
    """
    rows = rows.select("doc_id", "source", "size", "row", "key")
    drawn = rows.withColumn("_draw", _draw(seed, F.col("doc_id"))).withColumn(
        "_slot", F.shiftright("_draw", 20).cast("int")
    )
    slots = drawn.groupBy("source", "_slot").agg(F.sum("size").alias("_slot_size"))
    sources = targets(slots.groupBy("source").agg(F.sum("_slot_size").alias("source_size")), weights, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    sources = sources.withColumn("_whole", F.least(whole, F.lit(int(max_epochs))).cast("int")).withColumn(
        "_missing", F.col("target") - F.col("_whole") * F.col("source_size")
    )
    earlier = Window.partitionBy("source").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    plan = (
        slots.withColumn("_before", F.coalesce(F.sum("_slot_size").over(earlier), F.lit(0)))
        .withColumnRenamed("source", "_s")
        .join(sources, F.col("_s").eqNullSafe(F.col("source")))
        .withColumn("_after", F.col("_before") + F.col("_slot_size"))
        .select(
            "_s", F.col("_slot").alias("_t"), "source_size", "target", "_whole", "_missing", "_before",
            # All of a slot is taken, none of it, or it is the one in which the target falls.
            F.when(F.col("_after") <= F.col("_missing"), 1).when(F.col("_before") >= F.col("_missing"), 0).alias("_all"),
        )
    )
    met = drawn.join(plan, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_slot") == F.col("_t")))
    met = met.drop("_s", "_t")
    order = [F.col(c).asc_nulls_last() for c in ("_draw", "doc_id", "size", "row")]
    within = (
        Window.partitionBy("source", "_slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    fits = F.col("_before") + F.sum("size").over(within) <= F.col("_missing")
    drawn_in = (
        met.filter(F.col("_all").isNotNull())
        .withColumn("_more", F.col("_all"))
        .unionByName(met.filter(F.col("_all").isNull()).withColumn("_more", fits.cast("int")))
    )
    # One row a source fills what the drawn rows leave open.
    gaps = drawn_in.groupBy("source").agg(
        (F.max("_missing") - F.sum(F.col("size") * F.col("_more"))).alias("_gap")
    )
    gaps = gaps.withColumnRenamed("source", "_s").filter(F.col("_gap") > 0)
    off = F.abs(F.col("size") - F.col("_gap"))
    fillers = (
        drawn_in.filter((F.col("_more") == 0) & (F.col("size") > 0))
        .join(gaps, F.col("source").eqNullSafe(F.col("_s")))
        .filter(off < F.col("_gap"))
        .groupBy("source")
        .agg(F.min(F.struct(off.alias("off"), "_draw", "doc_id", "row"))["row"].alias("row"))
        .select("row", F.lit(1).alias("_fill"))
    )
    more = F.col("_more") + F.coalesce("_fill", F.lit(0))
    return drawn_in.join(fillers, "row", "left").select(
        "doc_id", "source", "size", "row", "key", "source_size", "target",
        F.when(F.col("source_size") > 0, F.col("_whole") + more).otherwise(0).cast("int").alias("copies"),
    )


def repeated(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with every row as often as ``mixed`` says, in place of its copies.

    Equal rows are met as one, with the sum of their copies, so repeated rows do not multiply.
    """
    wanted = mixed.groupBy("doc_id", "key").agg(F.sum("copies").alias("_copies")).filter(F.col("_copies") > 0)
    rows, column = by_place(docs)
    keyed = rows.withColumn("_key", F.xxhash64(*rows.columns)).withColumn("_id", column(id_col).cast("long"))
    met = keyed.dropDuplicates(["_key", "_id"]).join(
        wanted, (F.col("_key") == F.col("key")) & F.col("_id").eqNullSafe(F.col("doc_id"))
    )
    copied = met.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return copied.select(*rows.columns).toDF(*docs.columns)
