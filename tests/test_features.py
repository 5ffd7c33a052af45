import math

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from parley.operators import features as ft

P = ["p"]


def test_confidence_keeps_nan(spark):
    df = spark.createDataFrame([(0.9,), (0.8,), (0.7,), (float("nan"),), (None,)], "confidence double")
    assert ft.confident(df).count() == 4


def test_finite(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.0), (2.0, float("nan"), 1.0), (3.0, 1.0, float("-inf"))], "a double, b double, c double")
    assert [r.a for r in ft.finite_rows(df, ["a", "b", "c"]).collect()] == [1.0]
    assert ft.finite_columns(df, ["a", "b", "c"]).columns == ["a"]


@pytest.mark.parametrize("n, windows", [(31, 0), (32, 0), (48, 1), (64, 2), (79, 2)])
def test_last_full_window_is_left_out(spark, n, windows):
    df = spark.range(n).select(F.lit(0).alias("p"), (F.col("id") * 3).alias("f"))
    out = ft.sliding_windows(df, P, ["f"]).groupBy("win").agg(F.count("*").alias("n"), F.min("f").alias("lo"))
    assert rows(out, "win") == [(w, 32, w * 48) for w in range(windows)]


def test_window_statistics(spark):
    x = np.random.default_rng(0).normal(size=48)
    df = spark.createDataFrame([(0, i, float(v), 1.0) for i, v in enumerate(x)], "p int, f long, x double, c double")
    r = ft.window_statistics(ft.sliding_windows(df, P, ["f"]), P, {"x": "x", "c": "c"}, "f").first()
    w = x[:32]
    d = w - w.mean()
    scaled = (w - w.min()) / (w.max() - w.min())
    prob = scaled / scaled.sum()
    want = {"mean": w.mean(), "std": w.std(), "mad": np.median(abs(w - np.median(w))), "max": w.max(), "min": w.min(),
            "energy": (w ** 2).mean(), "entropy": -sum(q * math.log(q) for q in prob if q > 0),
            "iqr": np.percentile(w, 75) - np.percentile(w, 25), "range": w.max() - w.min(),
            "skewness": (d ** 3).mean() / w.std() ** 3, "kurtosis": (d ** 4).mean() / w.var() ** 2 - 3}
    for name, value in want.items():
        assert r[f"{name}_x"] == pytest.approx(value), name
    assert (r.frame_in, r.frame_out) == (0, 31)
    assert r.entropy_c is None and r.skewness_c is None and r.kurtosis_c is None and r.std_c == 0


def test_window_votes(spark):
    w = spark.createDataFrame([(0, 0, 0, 2, 5.0, 5.0, 1.0, 1), (0, 1, 2, 3, 6.0, 6.0, 1.0, 1), (0, 2, 3, 4, 7.0, 7.0, 1.0, 0)],
                              "p int, win long, frame_in long, frame_out long, face_x double, face_y double, face_radius double, pred long")
    out = ft.window_votes(w, P).select("frame", "face_x", "pred", "is_nod")
    assert rows(out, "frame") == [(0, 5.0, 1, False), (1, 5.0, 1, False), (2, 5.0, 2, True), (3, 6.0, 1, False), (4, 7.0, 0, False)]


def test_smoothing_leaves_the_ends(spark):
    df = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate([0, 3, 6, 0])], "p int, i long, v double")
    assert [r.s for r in ft.moving_average(df, P, "i", "v", "s").orderBy("i").collect()] == [0.0, 3.0, 3.0, 0.0]
    flags = [1, 0, 0, 1, 0, 0, 1, 1, 1, 0]
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate(flags)], "p int, i long, v int")
    want = [flags[i] if i < 3 or i > 6 else int(sum(flags[i - 3:i + 4]) / 7 >= 0.5) for i in range(10)]
    assert [r.s for r in ft.majority(df, P, "i", "v", "s").orderBy("i").collect()] == want


def test_baseline_shift(spark):
    data = [(0, i, float(v), ok) for i, (v, ok) in enumerate([(1, True), (9, True), (2, True), (2, False), (3, True)])]
    out = ft.baseline_shift(spark.createDataFrame(data, "p int, i long, v double, ok boolean"), P, "v", "ok", 0.3, "s")
    assert [r.s for r in out.orderBy("i").collect()] == [0.0, 5.0, 0.0, 0.0, 1.0]  # base is the value at rank 1: 2


@pytest.mark.parametrize("values", [[1, 1, 1, 9], [5], [1, 2, 3, 4, 100], [2, 2]])
def test_medians(spark, values):
    df = spark.createDataFrame([(0, float(v)) for v in values], "p int, v double")
    assert ft.medians(df, P, ["v"]).first().v == np.median(values)


def test_interpolation_cuts_to_pixels_and_drops_ghosts(spark):
    df = spark.createDataFrame([(0, 1, 10, 0, 0, 0), (0, 4, 20, 0, 0, -5), (1, 2, 1, 1, 1, 1)], "p int, frame long, top int, right int, bottom int, left int")
    out = ft.interpolate_boxes(df, P, spark.createDataFrame([(0, 6), (1, 6)], "p int, n long"))
    assert [(r.frame, r.top, r.left, r.is_detected) for r in out.orderBy("frame").collect()] == [
        (0, None, None, False), (1, 10, 0, True), (2, 13, -1, False), (3, 16, -3, False), (4, 20, -5, True), (5, None, None, False)]
    assert {r.p for r in out.collect()} == {0}


def test_silent_ranges(spark):
    df = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate([-50, -50, -10, -50, -50, -50])], "p int, i long, db double")
    assert rows(ft.silent_ranges(df, P, "i", "db", -40.0, 3)) == [(0, 3, 5, 3)]


def test_blocks_and_permutations(spark):
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate([5, 2, 3, 2, 1])], "p int, i long, idx long")
    blocks = ft.index_blocks(df, P, "i", "idx")
    assert [r.block for r in blocks.orderBy("i").collect()] == [0, 1, 1, 2, 3]
    out = ft.permuted_blocks(blocks, P, "i", 10, 1).collect()
    orders = set()
    for s in range(10):
        mine = sorted((r.place, r.idx) for r in out if r["sample"] == s)
        assert [p for p, _ in mine] == list(range(5))
        seq = [v for _, v in mine]
        assert sorted(seq) == [1, 2, 2, 3, 5] and any(seq[j:j + 2] == [2, 3] for j in range(4))
        orders.add(tuple(seq))
    assert len(orders) > 1


def test_carry_known(spark):
    df = spark.createDataFrame([(0, 0, 1, False, "a"), (0, 1, 2, True, "b"), (0, 2, 3, False, "c")], "p int, f long, x int, seen boolean, label string")
    assert rows(ft.carry_known(df, P, "f", ["x"], "seen", "label").select("f", "x", "label"), "f") == [(0, None, "Unknown"), (1, 2, "b"), (2, 2, "Unknown")]
