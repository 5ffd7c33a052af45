import random

from pyspark.sql import Window, functions as F

from parley.operators.ranks import ranked


def test_numbers_and_sums_equal_a_plain_window(spark):
    r = random.Random(3)
    data = [(r.choice([None, "a", "a", "a", "b"]), r.randrange(40), i, r.choice([None, 1, 2])) for i in range(3000)]
    df = spark.createDataFrame(data, "k string, v int, i int, x int").repartition(5)
    got = ranked(df, [F.desc("v"), "i"], "place", ["k"], size="n", total={"s": F.col("x")})
    w = Window.partitionBy("k").orderBy(F.desc("v"), "i")
    want = df.select("*", (F.row_number().over(w) - 1).cast("long").alias("place"),
                     F.count(F.lit(1)).over(Window.partitionBy("k")).alias("n"),
                     F.sum(F.coalesce("x", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_ties_of_the_first_column_are_split(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(200_000).select(F.lit(1).alias("count"), F.sha2(F.col("id").cast("string"), 256).alias("word"))
        got = ranked(df, [F.desc("count"), "word"], "rank").withColumn("_p", F.spark_partition_id())
        sorted_rows = df.repartitionByRange(F.desc("count"), "word").groupBy(F.spark_partition_id().alias("p")).count()
        sizes = [x["count"] for x in sorted_rows.collect()]
        assert len(sizes) == 4 and max(sizes) < 2 * 200_000 / 4
        assert got.agg(F.countDistinct("rank"), F.max("rank")).first() == (200_000, 199_999)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty_and_clashing_names(spark):
    df = spark.createDataFrame([], "k string, v int, _part int, _at int")
    assert ranked(df, ["v"], "rank", ["k"]).count() == 0
    df = spark.createDataFrame([("a", 2, 7, 8), ("a", 1, 5, 6)], "k string, v int, _part int, _at int")
    assert sorted(map(tuple, ranked(df, ["v"], "rank", ["k"]).collect())) == [("a", 1, 5, 6, 0), ("a", 2, 7, 8, 1)]
