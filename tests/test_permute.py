import duckdb
import pytest
from pyspark.sql import functions as F

from parley.functions.permute import drawn, drawn_sql, permuted, permuted_sql


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_every_place_is_taken_once(spark, n):
    out = spark.range(n).select("id", permuted(F.col("id"), F.lit(n), 5).alias("a"), permuted(F.col("id"), F.lit(n), 5, F.lit(1)).alias("b"),
                                permuted(F.col("id"), F.lit(n), 6).alias("c")).collect()
    for column in "abc":
        assert sorted(r[column] for r in out) == list(range(n))
    if n >= 97:
        orders = {tuple(r[c] for r in out) for c in ("id", "a", "b", "c")}
        assert len(orders) == 4
        assert sum(r.a == r.id for r in out) < 10 and abs(sum((r.a - r.id) * (1 if r.id < n / 2 else -1) for r in out) / n / n) < 0.5


def test_spark_and_sql_agree(spark):
    n = 5000
    ours = spark.range(n).select("id", permuted(F.col("id"), F.lit(n), 9, F.col("id") % 1 + 4).alias("place"), drawn(F.col("id"), 7, 9).alias("d")).collect()
    sql = f"WITH RECURSIVE base AS (SELECT unnest(range({n})) AS id), {permuted_sql('base', 'id', str(n), 9, '4')} SELECT id, place, {drawn_sql('id', 7, 9)} FROM perm"
    assert sorted(map(tuple, ours)) == sorted(duckdb.sql(sql).fetchall())


def test_large_numbers(spark):
    n = 1 << 40
    out = spark.range(2000).select(permuted(F.col("id") * 524287, F.lit(n), 3).alias("x")).collect()
    found = {r.x for r in out}
    assert len(found) == 2000 and min(found) >= 0 and max(found) < n
    assert 0.45 < sum(x < n // 2 for x in found) / 2000 < 0.55
