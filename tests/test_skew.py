"""Joins with a hot key: same rows as a plain join, no task with most of them."""

from pyspark.sql import functions as F

from cityflux.operators import skew

HOT = 7


def tables(spark):
    i = F.col("id")
    big = spark.range(0, 30_000, 1, 8).select(
        F.when(i % 3 > 0, HOT).otherwise(i % 500).alias("k"), i.alias("row")
    )
    small = spark.range(0, 400).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    return big, small


def same(a, b):
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_same_rows(spark):
    big, small = tables(spark)
    for how in ("inner", "left"):
        got = skew.join_spread(big, small, ["k"], "row", how).select("k", "row", "v")
        same(got, big.join(small, "k", how).select("k", "row", "v"))


def test_hot_list_is_short(spark):
    big, _ = tables(spark)
    pieces = {r.k: r["_pieces"] for r in skew.hot_keys(big, ["k"]).collect()}
    assert pieces == {HOT: pieces[HOT]} and pieces[HOT] > 600


def test_hot_key_is_spread_over_tasks(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        big, small = tables(spark)
        joined = skew.join_spread(big, small, ["k"], "row").withColumn("p", F.spark_partition_id())
        sizes = [r["count"] for r in joined.groupBy("p").count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes) == 8 and max(sizes) < 2 * sum(sizes) / 8
