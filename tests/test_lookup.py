"""Skewed joins: equal rows, missing keys, and what may be broadcast."""

from pyspark.sql import functions as F

from phrasewell.operators.lookup import numbered_copies, salted_join
from phrasewell.session import fits


def largest(df):
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def skewed(spark):
    """40,000 equal rows of one key, 10,000 without a key, 10,000 of other keys."""
    return spark.range(60_000).select(
        F.when(F.col("id") < 40_000, 1).when(F.col("id") >= 50_000, F.col("id")).alias("k"),
        F.when(F.col("id") < 50_000, F.lit("same")).otherwise(F.col("id").cast("string")).alias("x"),
    )


def test_equal_rows_and_missing_keys_are_spread(spark):
    table = spark.createDataFrame([(1, "one"), (50_001, "other"), (None, "never")], "k bigint, label string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = salted_join(skewed(spark), table, "k")
        assert largest(joined) < 2 * 60_000 / 20
        counts = {r.label: r["count"] for r in joined.groupBy("label").count().collect()}
        assert counts == {"one": 40_000, "other": 1, None: 19_999}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_copies_are_numbered(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), (None, 1), (None, 1), ("b", 2)], "x string, y int")
    assert sorted((r.x or "", r.n) for r in numbered_copies(df, "n").collect()) == [("", 0), ("", 1), ("a", 0), ("a", 1), ("b", 0)]


def test_nested_values_are_measured(spark):
    df = spark.range(100)
    assert fits(df.select(F.array(F.lit("x")).alias("v")), 10_000)
    for wide in (F.array_repeat(F.repeat(F.lit("x"), 1000), 10), F.array_repeat(F.array_repeat(F.lit(1.0), 100), 10), F.struct(F.repeat(F.lit("x"), 9000).alias("s")), F.create_map(F.lit("k"), F.repeat(F.lit("x"), 9000))):
        assert not fits(df.select(wide.alias("v")), 500_000)
