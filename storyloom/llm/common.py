"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyloom.session import bound_batches, shared_folder

#: Words are maximal runs of anything but these six characters, which are also what ``bytes.split()``
#: and ``bytes.strip()`` take for white space.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only, found by exact spelling, whatever else ``df`` holds.

    Other columns may clash with these or with the columns an operator adds, also in all but case.
    """
    places = [df.columns.index(name) for name in names]
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))]).select(
        *[F.col(f"_{at}").alias(name) for at, name in zip(places, names, strict=True)]
    )


def by_place(df: DataFrame) -> tuple[DataFrame, Callable[[str], Column]]:
    """``df`` with columns c0, c1, ... and what finds them by the exact spelling of their old names."""
    names = df.columns
    return df.toDF(*[f"c{i}" for i in range(len(names))]), lambda name: F.col(f"c{names.index(name)}")


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string) of ``df``."""
    return pick(df, id_col, text_col).select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What gives back the memory that operators keep in a worker process from task to task.
_KEPT: list[Callable[[], None]] = []


def kept(clear: Callable[[], None]) -> None:
    """Name what clears a memory that outlasts its tasks."""
    _KEPT.append(clear)


def forget() -> None:
    """Give back what other operators keep in this worker process, before work that takes much memory itself."""
    for clear in _KEPT:
        clear()


def in_batches(
    df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str
) -> DataFrame:
    """``mapInArrow`` with batches bounded in bytes, since single texts may be very long."""
    bound_batches(df.sparkSession)
    return df.mapInArrow(work, schema)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, and safe when executors go."""
    path = f"{shared_folder(df.sparkSession, name)}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Delete the table that ``written`` made, once nothing is computed from it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.inputFiles()[0]).getParent()
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def row_key(*columns: Column) -> Column:
    """Ties results back to rows. Rows that share it by chance must be harmless to the caller."""
    return F.xxhash64(*columns)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(df: DataFrame, name: str) -> DataFrame:
    """The rows of a stored table with numbers from 0 without gaps: partitions begin where those before them end."""
    row = F.monotonically_increasing_id()
    placed = df.withColumn("_part", F.shiftright(row, 33)).withColumn("_row", row.bitwiseAND(F.lit((1 << 33) - 1)))
    # One row a partition.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    bases = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return placed.join(F.broadcast(bases), "_part").withColumn(name, F.col("_base") + F.col("_row")).select(*df.columns, name)
