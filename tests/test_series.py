import random

import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import Window as W, functions as F

from parley.operators.series import along, chunked, differs, neighbours


def expected(df):
    w = W.partitionBy("k").orderBy("t")
    up, on = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
    out = df.select(
        "*", (F.row_number().over(w) - 1).cast("long").alias("rk"), F.lag("v").over(w).alias("pv"), F.lead("v").over(w).alias("nv"),
        F.sum(F.coalesce("v", F.lit(0))).over(up).alias("sv"), F.last("v", True).over(up).alias("lv"),
        F.first("v", True).over(on).alias("fv"), F.max("v").over(up).alias("mv"),
        F.max("v").over(w.rowsBetween(W.unboundedPreceding, -1)).alias("bv"),
        F.when(~F.coalesce(F.lag(F.struct("l")).over(w)["l"].eqNullSafe(F.col("l")), F.lit(True)) & (F.row_number().over(w) > 1), 1).otherwise(0).alias("b"))
    return out.withColumn("run", F.sum("b").over(up)).drop("b")


def cut(df, most):
    v = F.col("v")
    return along(df, ["k"], ["t"], rows=most, rank="rk", lag={"pv": v}, lead={"nv": v}, total={"sv": v}, last={"lv": v},
                 first={"fv": v}, high={"mv": v}, high_before={"bv": v}, runs={"run": (F.col("l"), differs)})


@pytest.mark.parametrize("most", [1, 17, 10_000])
def test_chunks_give_what_a_whole_window_gives(spark, most):
    random.seed(most)
    data = [(k, t, random.choice([None, 1, 2, 2, 3]), random.choice(["a", "b"])) for k in (0, 1) for t in random.sample(range(300), 90)]
    df = spark.createDataFrame(data, "k long, t long, v long, l string")
    assert rows(cut(df, most), "k", "t") == rows(expected(df), "k", "t")


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(-40, 40), st.one_of(st.none(), st.integers(-5, 5)), st.sampled_from("ab")),
                min_size=1, max_size=30, unique_by=lambda r: r[:2]), st.integers(1, 9))
def test_any_series_in_any_chunks(spark, data, most):
    df = spark.createDataFrame(data, "k long, t long, v long, l string")
    assert rows(cut(df, most), "k", "t") == rows(expected(df), "k", "t")


def test_series_without_key(spark):
    df = spark.createDataFrame([(5, 1), (7, 2), (100, 3)], "t long, v long")
    out = along(df, [], ["t"], total={"s": F.col("v")}, rank="n", rows=1)
    assert rows(out, "t") == [(5, 1, 0, 1), (7, 2, 1, 3), (100, 3, 2, 6)]


@pytest.mark.parametrize("most", [1, 100])
def test_null_keys_and_rows_without_place(spark, most):
    df = spark.createDataFrame([(0, 1), (None, 2), (None, 3), (0, None)], "k long, t long")
    out = along(df, ["k"], ["t"], rank="n", total={"s": F.col("t")}, rows=most)
    assert rows(out, "k", "t") == [(None, 2, 0, 2), (None, 3, 1, 5), (0, None, 0, 0), (0, 1, 1, 1)]


def skewed(spark):
    """A third of all rows in one key, most of them within a burst inside a burst, with ties in the first column."""
    r = random.Random(9)
    hot = [(0, r.choice([r.randrange(10**12), 5 * 10**11 + r.randrange(1000), 5 * 10**11 + 500, 7])) for _ in range(3000)]
    cold = [(1 + i % 300, r.randrange(10**12)) for i in range(6000)]
    return spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(hot + cold)], "k long, t long, i long")


def test_chunks_are_bounded_on_skewed_times_and_counts(spark):
    df = skewed(spark).withColumn("_key", F.struct("k"))
    cut_ = chunked(df, "_key", ["t", "i"], 100)
    sizes = cut_.groupBy("_key", "_chunk").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("t", "i")).alias("lo"), F.max(F.struct("t", "i")).alias("hi"))
    found = sizes.orderBy("_key", "_chunk").collect()
    assert sum(r.n for r in found) == 9000 and max(r.n for r in found) <= 100
    hot = [r for r in found if r._key.k == 0]
    assert len(hot) < 400 and all(a.hi < b.lo for a, b in zip(hot, hot[1:]))  # few, and in order
    assert len([r for r in found if r._key.k == 5]) == 1  # a small key stays whole
    assert chunked(df, "_key", ["t", "i"], 3000) is None


def test_a_skewed_series_is_the_whole_windows(spark):
    df = skewed(spark)
    out = along(df, ["k"], ["t", "i"], rank="n", lag={"p": F.col("i")}, total={"s": F.col("i")}, rows=100)
    w = W.partitionBy("k").orderBy("t", "i")
    want = df.select("*", (F.row_number().over(w) - 1).cast("long").alias("n"), F.lag("i").over(w).alias("p"), F.sum("i").over(w).alias("s"))
    assert rows(out, "k", "t", "i") == rows(want, "k", "t", "i")


def test_one_scan_per_layer(spark, tmp_path):
    spark.range(100).selectExpr("id % 3 AS k", "id AS t").write.parquet(str(tmp_path / "x"))
    df = spark.read.parquet(str(tmp_path / "x"))
    for most, shuffles in ((0, 1), (10, None)):
        out = along(along(df, ["k"], ["t"], rank="n", rows=most), ["k"], ["n"], lag={"p": F.col("t")}, rows=most)
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial")[0]
        assert plan.count("FileScan parquet") == 1
        assert shuffles is None or plan.count("Exchange hashpartitioning") == shuffles


@pytest.mark.parametrize("span", [1, 2, 100])
def test_neighbours(spark, span):
    df = spark.createDataFrame([(k, i) for k in (0, 1) for i in range(5)], "k long, p long")
    out = neighbours(df, ["k"], "p", 1, F.col("p"), span=span)
    assert [r[2] for r in rows(out.filter("k = 1"), "p")] == [[0, 1], [0, 1, 2], [1, 2, 3], [2, 3, 4], [3, 4]]
