from pyspark.sql import functions as F

from storyloom.operators.skew import GROUP_SHARE, hot_keys, lookup_join
from storyloom.operators.tables import with_new_ids


def rows(spark, n=6000):
    return spark.range(n).select(
        "id",
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("k"), "id")).alias("k"),
    )


def test_hot_keys_are_found_and_few(spark):
    assert [r.k for r in hot_keys(rows(spark), "k").filter("k is not null").collect()] == ["hot"]
    assert hot_keys(spark.range(5000).select(F.col("id").cast("string").alias("k")), "k").count() == 0


def test_lookup_join_equals_a_plain_left_join(spark):
    left = rows(spark)
    right = left.filter("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))
    right = right.filter((F.col("k") == "hot") | (F.col("top") % 2 == 0))
    got = lookup_join(left, right, "k", ["id"])
    want = left.join(right, "k", "left").select(*got.columns)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_a_hot_key_is_dealt_out_by_its_share(spark):
    found = hot_keys(rows(spark), "k").filter("k = 'hot'").first()
    assert abs(found["_groups"] - 1 / 3 / GROUP_SHARE) <= 2


def test_new_ids_follow_the_order_across_slices(spark):
    stored = spark.createDataFrame([(41,)], "id long")
    new = spark.range(500).select((F.col("id") * 7 % 500).alias("v"))
    got = {r.v: r.id for r in with_new_ids(new, stored, [F.col("v")], slice_rows=60).collect()}
    assert got == {v: 42 + v for v in range(500)}
