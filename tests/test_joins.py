import pytest
from patronvoice.operators.joins import lookup_join
from pyspark.sql import functions as F


@pytest.mark.parametrize("salts", [1, 16])
def test_hot_and_null_keys(spark, salts):
    left = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, F.lit(7)).otherwise(F.col("id")).alias("k"), "id"
    )
    right = spark.range(0, 3000, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v")).union(spark.sql("SELECT 7L, 70L"))
    got = lookup_join(left, right, ["k"], salts)
    want = left.join(right, "k", "left")
    assert sorted(got.columns) == sorted(want.columns)
    assert got.count() == 3000
    assert got.select(want.columns).exceptAll(want).isEmpty()


def test_null_keys_are_spread(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        left = spark.range(4000).select(F.lit(None).cast("bigint").alias("k"), "id")
        right = spark.range(10).select(F.col("id").alias("k"), F.col("id").alias("v"))
        sizes = lookup_join(left, right, ["k"]).withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes) > 1 and max(r["count"] for r in sizes) < 4000 * 0.6


def test_map_columns_are_carried(spark):
    left = spark.sql("SELECT 1L AS k, map('a', 1) AS m")
    assert lookup_join(left, spark.sql("SELECT 1L AS k, 2 AS v"), ["k"]).first()["v"] == 2
