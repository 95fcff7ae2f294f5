"""Places and running totals over range-dealt parts against one window a group."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from keystrata.operators.ranks import ranked


def test_ranked_equals_one_window(spark):
    rows = spark.range(6000).select(F.when(F.col("id") % 10 < 7, "huge").when(F.col("id") % 10 == 8, F.lit(None)).otherwise(F.concat(F.lit("t"), F.col("id") % 97)).alias("g"), F.xxhash64("id").alias("k"), (F.col("id") % 13).alias("n"), F.col("id").alias("place_"))
    want = Window.partitionBy("g").orderBy("k")
    expected = rows.select("g", "k", "n", F.row_number().over(want).alias("place"), F.sum("n").over(want.rowsBetween(Window.unboundedPreceding, 0)).alias("total"))
    got = ranked(rows, ["g"], [F.col("k")], {"total": "n"})
    assert got.columns == ["g", "k", "n", "place_", "place", "total"]
    assert sorted(map(tuple, got.drop("place_").collect()), key=repr) == sorted(map(tuple, expected.collect()), key=repr)
    assert ranked(rows.limit(0), ["g"], [F.col("k")]).collect() == []


def test_a_huge_group_lies_in_many_parts(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(20_000).select(F.lit("t").alias("g"), F.col("id").alias("k"))
        parts = ranked(rows, ["g"], [F.col("k")])
        assert parts.count() == 20_000 and parts.agg(F.max("place"), F.countDistinct("place")).first() == (20_000, 20_000)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
