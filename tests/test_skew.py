import pytest
from conftest import rows
from pyspark.sql import functions as F

from parley.operators.skew import fits, lookup_join, salted_join


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_is_the_plain_join(spark, how):
    facts = spark.range(200).select((F.col("id") % 7 * (F.col("id") % 3)).alias("k"), "id")
    dim = spark.createDataFrame([(0, "a"), (2, "b"), (4, "c")], "k long, n string")
    assert rows(salted_join(facts, dim, ["k"], how), "id") == rows(facts.join(dim, "k", how), "id")
    assert rows(lookup_join(facts, dim, ["k"], how), "id") == rows(facts.join(dim, "k", how), "id")
    assert rows(lookup_join(facts, dim, ["k"], how, limit=1), "id") == rows(facts.join(dim, "k", how), "id")


def test_right_rows_cannot_be_kept(spark):
    with pytest.raises(ValueError):
        salted_join(spark.range(1), spark.range(1), ["id"], "full")


def test_fits(spark):
    assert fits(spark.range(5), 5) and not fits(spark.range(6), 5)


def test_hot_key_is_spread(spark):
    facts = spark.range(4000).select(F.lit(1).alias("k"), "id")
    dim = spark.createDataFrame([(1, "a")], "k int, n string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        sizes = salted_join(facts, dim, ["k"]).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", True)
    assert len(sizes) > 1 and sum(r["count"] for r in sizes) == 4000


def test_a_table_fits_by_rows_and_bytes(spark):
    df = spark.range(10).selectExpr("id", "repeat('x', 1000) AS s").selectExpr("*", "array(s, s) AS a", "struct(id AS i, s AS t) AS u", "array(id) AS n")
    assert fits(df, 10) and not fits(df, 9)
    assert fits(df, 10, 45_000) and not fits(df, 10, 39_000)
    assert fits(df.limit(0), 0)
