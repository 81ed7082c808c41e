"""Substring search through a stored trigram table.

The table has a row per trigram and block of 64 consecutive ids: a bit for each id whose texts hold the trigram. A
search intersects the bits of all trigrams of its term, reads only the id ranges that are left, and tests the texts
there with the same pattern as a full scan. Bits may say too much, never too little, so texts can be replaced by
appending to the table. Terms without three literal characters in a row have no trigram and scan all texts.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.operators.listing import like_pattern, search_term

TEXT_COLUMNS = ("title", "summary", "full_content")
#: Ids of a block: the bits of a long.
BLOCK_IDS = 64
#: Ids of a folder of texts, and folders that trigrams are dealt to.
RANGE_IDS = 65_536
SLOTS = 64

_TRIGRAMS = "(?s)(?=(...))"


def id_range(ids: Column, range_ids: int = RANGE_IDS) -> Column:
    return F.floor(ids / F.lit(range_ids)).cast("long")


def _slot(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(SLOTS)).cast("int")


def trigram_bits(rows: DataFrame, columns: Sequence[str] = TEXT_COLUMNS) -> DataFrame:
    """(slot, gram, block, ids): which rows (by ``id``) of which block hold a trigram of small letters.

    Blocks are mostly whole within a task, which leaves one row of a trigram and block to shuffle.
    """
    found = [F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(_TRIGRAMS), F.lit(1)) for c in columns]
    grams = F.explode(F.array_distinct(F.flatten(F.array(*found))))
    block = F.floor(F.col("id") / BLOCK_IDS).cast("long")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("id", F.lit(BLOCK_IDS)).cast("int"))
    each = rows.select(grams.alias("gram"), block.alias("block"), bit.alias("bit"))
    return each.groupBy("gram", "block").agg(F.bit_or("bit").alias("ids")).select(_slot(F.col("gram")).alias("slot"), "gram", "block", "ids")


def write_index(
    rows: DataFrame, path: str, columns: Sequence[str] = TEXT_COLUMNS, mode: str = "append", range_ids: int = RANGE_IDS
) -> None:
    """Append ``rows`` (with ``id``) and their trigrams to the table at ``path``, or begin it anew.

    Ids must be new; ``replace_rows`` takes stored ones. Texts lie in folders of ``range_ids`` ids, trigrams sorted
    in folders by their hash, so that a search reads few row groups of them.
    """
    placed = rows.withColumn("id_range", id_range(F.col("id"), range_ids))
    # One writer a folder for each of the tasks that hold its ids.
    placed.repartition("id_range").sortWithinPartitions("id_range", "id").write.mode(mode).partitionBy("id_range").parquet(f"{path}/rows")
    bits = trigram_bits(rows, columns).repartitionByRange("slot", "gram", "block").sortWithinPartitions("slot", "gram", "block")
    bits.write.mode(mode).partitionBy("slot").parquet(f"{path}/grams")


def replace_rows(
    rows: DataFrame, path: str, columns: Sequence[str] = TEXT_COLUMNS, range_ids: int = RANGE_IDS
) -> None:
    """Put ``rows`` in place of stored ones with their ids. Only the folders that hold such ids are written again."""
    spark = rows.sparkSession
    schema = T.StructType([*rows.schema.fields, T.StructField("id_range", T.LongType())])
    new = rows.withColumn("id_range", id_range(F.col("id"), range_ids))
    touched = F.broadcast(new.select("id_range").distinct())  # at most one row a folder
    kept = spark.read.schema(schema).parquet(f"{path}/rows").join(touched, "id_range", "left_semi").join(new.select("id"), "id", "left_anti")
    trigram_bits(rows, columns).write.mode("append").partitionBy("slot").parquet(f"{path}/grams")
    whole = kept.unionByName(new).repartition("id_range").sortWithinPartitions("id_range", "id")
    whole.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("id_range").parquet(f"{path}/rows")


def literal_runs(pattern: str) -> list[str]:
    """The runs of literal characters between the wildcards of a LIKE pattern."""
    runs, at = [""], 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\" and at + 1 < len(pattern):
            at += 1
            runs[-1] += pattern[at]
        elif c in "%_":
            runs.append("")
        else:
            runs[-1] += c
        at += 1
    return [r for r in runs if r]


def pattern_trigrams(spark: SparkSession, pattern: str) -> list[str]:
    """Trigrams that every text like ``pattern`` holds, in the small letters that Spark itself makes."""
    small = spark.sql("SELECT lower(:p) AS p", {"p": pattern}).first()["p"]
    return sorted({run[i : i + 3] for run in literal_runs(small) for i in range(len(run) - 2)})


def candidates(spark: SparkSession, path: str, grams: Sequence[str]) -> DataFrame:
    """Ids whose texts may hold all of ``grams``."""
    wanted = F.col("slot").isin(*[_slot(F.lit(g)) for g in grams]) & F.col("gram").isin(*grams)
    stored = spark.read.schema("gram string, block long, ids long, slot int").parquet(f"{path}/grams")
    by_gram = stored.filter(wanted).groupBy("block", "gram").agg(F.bit_or("ids").alias("ids"))
    blocks = by_gram.groupBy("block").agg(F.bit_and("ids").alias("ids"), F.count(F.lit(1)).alias("n"))
    blocks = blocks.filter((F.col("n") == len(grams)) & (F.col("ids") != 0))
    places = F.explode(F.expr(f"filter(sequence(0, {BLOCK_IDS - 1}), i -> (shiftrightunsigned(ids, i) & 1) = 1)"))
    return blocks.select("block", places.alias("at")).select((F.col("block") * BLOCK_IDS + F.col("at")).alias("id"))


def like_rows(
    spark: SparkSession, path: str, schema: T.StructType, pattern: str, columns: Sequence[str], range_ids: int = RANGE_IDS
) -> DataFrame:
    """Stored rows with ``pattern``, in any letter case, in one of ``columns``."""
    stored = spark.read.schema(T.StructType([*schema.fields, T.StructField("id_range", T.LongType())])).parquet(f"{path}/rows")
    grams = pattern_trigrams(spark, pattern)
    if grams:
        ids = candidates(spark, path, grams)
        # At most one row a folder, which prunes the folders that are listed for the scan.
        ranges = ids.select(id_range(F.col("id"), range_ids).alias("id_range")).distinct()
        stored = stored.join(F.broadcast(ranges), "id_range", "left_semi").join(ids, "id", "left_semi")
    matches = reduce(Column.__or__, [F.col(c).ilike(pattern) for c in columns])
    return stored.filter(matches).select(*schema.fieldNames())


def indexed_search(
    spark: SparkSession, path: str, schema: T.StructType, q: str | None, range_ids: int = RANGE_IDS
) -> DataFrame:
    """The rows that ``listing.search`` finds in the table written to ``path``."""
    term = search_term(q)
    if term is None:
        return spark.read.schema(schema).parquet(f"{path}/rows")
    return like_rows(spark, path, schema, like_pattern(term), TEXT_COLUMNS, range_ids)


def indexed_url_match(
    spark: SparkSession, path: str, schema: T.StructType, pattern: str, range_ids: int = RANGE_IDS
) -> DataFrame:
    """(id, url) of urls with ``pattern``, from a table that was written with the trigrams of ``url``."""
    return like_rows(spark, path, schema, like_pattern(pattern), ["url"], range_ids).select("id", "url")
