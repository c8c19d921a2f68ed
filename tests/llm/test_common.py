"""Joins that spread hot keys."""

from pyspark.sql import functions as F

from tidemark.llm.common import hot_keys, join_spread


def _tables(spark):
    rows = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 2500).alias("k"))
    return rows, rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("most"))


def test_join_spread_equals_a_join(spark):
    rows, keyed = _tables(spark)
    hot = hot_keys(keyed, "k", "n", most=4)
    assert [r.k for r in hot.collect()] == [-1]
    got, plain = join_spread(rows, keyed, "k", hot, ["id"], salts=16), rows.join(keyed, "k")
    assert got.columns == plain.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))


def test_rows_of_a_hot_key_meet_in_many_tasks(spark):
    rows, keyed = _tables(spark)
    before = {key: spark.conf.get(key) for key in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = join_spread(rows, keyed, "k", hot_keys(keyed, "k", "n", most=4), ["id"], salts=16).withColumn("task", F.spark_partition_id())
        shares = [r["count"] for r in joined.filter("k = -1").groupBy("task").count().collect()]
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert sum(shares) == 2000 and len(shares) > 1 and max(shares) < 1200


def test_hot_keys_are_bounded(spark):
    even = spark.range(5000).select(F.col("id").alias("k"), F.lit(7).alias("n"))
    assert hot_keys(even, "k", "n", most=100).count() == 0
    assert hot_keys(even.filter("k < 50"), "k", "n", most=100).count() == 50
    empty = even.filter("k < 0")
    assert hot_keys(empty, "k", "n").count() == 0
    assert join_spread(empty, empty.withColumnRenamed("n", "m"), "k", hot_keys(empty, "k", "n"), ["n"]).count() == 0
