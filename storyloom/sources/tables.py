"""Reading and appending the stored tables, Parquet optionally laid out by day."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY = "day"


def read_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    since: datetime | None = None,
    until: datetime | None = None,
) -> DataFrame:
    """A stored table. For one laid out by day, ``since`` and ``until`` skip the folders outside.

    The bounds are whole days; operators still apply their exact time filters. Rows without a date
    lie in no day and are left out once a bound is given.
    """
    df = spark.read.schema(schema).parquet(path)
    if since is not None:
        df = df.filter(F.col(DAY) >= F.to_date(F.lit(since)))
    if until is not None:
        df = df.filter(F.col(DAY) <= F.to_date(F.lit(until)))
    return df.select(*schema.fieldNames())


def append(df: DataFrame, path: str, day_of: str | None = None) -> None:
    """Append rows; with ``day_of`` they are laid out by the day of that column."""
    if day_of is None:
        df.write.mode("append").parquet(path)
    else:
        df.withColumn(DAY, F.to_date(day_of)).write.mode("append").partitionBy(DAY).parquet(path)
