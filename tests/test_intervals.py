import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from parley.operators import intervals as iv

I = "k long, id long, start_ms long, end_ms long"


def random_intervals(n, seed, top=100):
    random.seed(seed)
    return [(i % 2, i, s, s + random.randint(0, 30)) for i in range(n) for s in [random.randint(0, top)]]


def test_run_compaction_last_change_gives_an_empty_run(spark):
    df = spark.createDataFrame([(0, 1, "a"), (0, 2, "a"), (0, 5, "b"), (0, 6, "a")], "k long, t long, l string")
    assert rows(iv.compact_runs(df, ["k"], "t", "l"), "start") == [(0, "a", 1, 5), (0, "b", 5, 6), (0, "a", 6, 6)]


def test_run_merge_absorbs_gaps(spark):
    df = spark.createDataFrame([(0, 0, 1, 0, 5), (0, 1, 1, 9, 12), (0, 2, 2, 12, 13), (0, 3, 1, 20, 21)], "k long, o long, s int, start_ms long, end_ms long")
    out = iv.merge_runs(df, ["k"], "o", "s")
    assert rows(out.drop("run"), "start_ms") == [(0, 1, 0, 12, 2), (0, 2, 12, 13, 1), (0, 1, 20, 21, 1)]


@pytest.mark.parametrize("closed", [False, True])
def test_points_in_intervals(spark, closed):
    data = random_intervals(20, 1)
    points = [(k, t) for k in (0, 1) for t in range(0, 131)]
    out = iv.points_in_intervals(spark.createDataFrame(points, "k long, t long"), spark.createDataFrame(data, I), ["k"], "t", 7, closed=closed)
    want = sorted((k, t, i) for k, t in points for j, i, s, e in data if j == k and s <= t and (t <= e if closed else t < e))
    assert sorted((r.k, r.t, r.id) for r in out.collect()) == want


def test_points_without_interval_are_kept_on_request(spark):
    out = iv.points_in_intervals(spark.createDataFrame([(0, 1), (0, 50)], "k long, t long"),
                                 spark.createDataFrame([(0, 9, 0, 2)], I), ["k"], "t", 10, how="left")
    assert [(r.t, r.id) for r in out.orderBy("t").collect()] == [(1, 9), (50, None)]


def test_coverage(spark):
    data = random_intervals(25, 2)
    out = iv.coverage(spark.createDataFrame(data, I), ["k"])
    for k in (0, 1):
        mine = [(s, e) for j, _, s, e in data if j == k and e > s]
        cover = {t: sum(s <= t < e for s, e in mine) for t in range(140)}
        got = {t: r.active for r in out.filter(F.col("k") == k).collect() for t in range(r.start_ms, r.end_ms)}
        assert got == {t: n for t, n in cover.items() if n}


def test_contained_intervals_and_equal_ones_go(spark):
    data = random_intervals(40, 3, 60) + [(0, 900, 500, 510), (0, 901, 500, 510), (0, 902, 600, 610)]
    out = iv.without_contained(spark.createDataFrame(data, I), ["k"], "id")
    want = [a[1] for a in data if not any(b[0] == a[0] and b[1] != a[1] and b[2] <= a[2] and a[3] <= b[3] for b in data)]
    assert sorted(r.id for r in out.collect()) == sorted(want) and 902 in want and 900 not in want


def test_gaps_none_and_all_silent(spark):
    silent = spark.createDataFrame([(0, 2, 4), (0, 7, 10), (1, 0, 10)], "k long, start_ms long, end_ms long")
    length = spark.createDataFrame([(0, 10), (1, 10), (2, 10)], "k long, duration_ms long")
    assert rows(iv.gaps(silent, ["k"], length), "k", "start_ms") == [
        (0, "nonsilence", 0, 2), (0, "silence", 2, 4), (0, "nonsilence", 4, 7), (0, "silence", 7, 10),
        (1, "silence", 0, 10), (2, "nonsilence", 0, 10)]


def test_offset_map_start_and_end_traps(spark):
    kept = spark.createDataFrame([(0, 100, 110), (0, 200, 220)], "k long, start_ms long, end_ms long")
    times = spark.createDataFrame([(0, t) for t in (0, 9, 10, 29, 30)], "k long, t long")
    assert rows(iv.original_times(times, kept, ["k"], "t"), "t") == [(0, 0, 100), (0, 9, 109), (0, 10, 200), (0, 29, 219), (0, 30, 220)]


def test_centre_labels_advance_one_per_window(spark):
    changes = [(0, 0, 10, "a"), (0, 1, 11, "b"), (0, 2, 12, "c"), (0, 3, 99, "d")]
    centres = [3, 20, 21, 22, 23]
    out = iv.centre_labels(spark.createDataFrame([(0, i, c) for i, c in enumerate(centres)], "k long, i long, c long"),
                           spark.createDataFrame(changes, "k long, ord long, change long, speaker string"), ["k"], "i", "c")
    assert [r.speaker for r in out.orderBy("i").collect()] == ["a", "b", "c", "d", "d"]


def test_unknown_ends(spark):
    df = spark.createDataFrame([(0, 1, 5, 7)], "k long, speaker int, start_ms long, end_ms long")
    out = iv.with_unknown_ends(df, ["k"], spark.createDataFrame([(0, 9)], "k long, duration_ms long"))
    assert rows(out, "start_ms") == [(0, -1, 0, 5), (0, 1, 5, 7), (0, -1, 7, 9)]


def test_asof_strict(spark):
    left = spark.createDataFrame([(0, 5), (0, 4)], "k long, t long")
    right = spark.createDataFrame([(0, 5, "x"), (0, 1, "w")], "k long, u long, v string")
    assert rows(iv.asof(left, right, ["k"], "t", "u", ["v"]), "t") == [(0, 4, "w"), (0, 5, "x")]
    assert rows(iv.asof(left, right, ["k"], "t", "u", ["v"], strict=True), "t") == [(0, 4, "w"), (0, 5, "w")]


def _computed(spark, df):
    """The table, and a counter of how many of its rows were computed."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    return df.mapInPandas(count, df.schema), seen


def test_inputs_of_a_sweep_are_computed_once(spark):
    """Times, pieces, boxes and silences are looked at for their counts and then swept, but come from one pass over their input."""
    from parley.operators import features as ft

    times, n = _computed(spark, spark.createDataFrame([(1, 5), (1, 15), (1, 40)], "k long, t long"))
    kept, m = _computed(spark, spark.createDataFrame([(1, 10, 20), (1, 30, 45)], "k long, start_ms long, end_ms long"))
    got = iv.original_times(times, kept, ["k"], "t")
    assert got.columns == ["k", "t", "original"] and sorted(map(tuple, got.collect())) == [(1, 5, 15), (1, 15, 35), (1, 40, 45)]
    assert (n.value, m.value) == (3, 2)
    boxes, n = _computed(spark, spark.createDataFrame([(1, 1, 0, 0, 0, 0), (1, 3, 4, 4, 4, 4)], "k long, frame long, top int, right int, bottom int, left int"))
    grid = ft.interpolate_boxes(boxes, ["k"], spark.createDataFrame([(1, 5)], "k long, n long"))
    assert sorted((r.frame, r.top) for r in grid.collect() if r.top is not None) == [(1, 0), (2, 2), (3, 4)] and n.value == 2
    silent, n = _computed(spark, spark.createDataFrame([(1, 10, 20)], "k long, start_ms long, end_ms long"))
    gaps = iv.gaps(silent, ["k"], spark.createDataFrame([(1, 50)], "k long, duration_ms long"))
    assert sorted(map(tuple, iv.midpoint_splits(gaps, ["k"]).collect())) == [(1, 0.0, 15.0), (1, 15.0, 50.0)] and n.value == 1


def test_asof_keeps_columns_of_any_time_type(spark):
    """A time travels once where both sides have one type; the columns and their order are those of the left side."""
    right = spark.createDataFrame([(1, 2, "a"), (1, 6, "b")], "k long, at long, v string")
    for kind in ("long", "int"):
        left = spark.createDataFrame([(1, "x", 5, 7), (1, "y", 6, 8), (1, "z", 1, 9)], f"k long, name string, t {kind}, more long")
        got = iv.asof(left, right, ["k"], "t", "at", ["v"])
        assert got.dtypes == [*left.dtypes, ("v", "string")]
        assert sorted(map(tuple, got.collect())) == [(1, "x", 5, 7, "a"), (1, "y", 6, 8, "b"), (1, "z", 1, 9, None)]


def test_loudness_is_computed_once(spark, tmp_path):
    """The segments' loudest microphones are written before their runs are merged."""
    from datetime import datetime, timedelta

    from parley import plans

    data = [(i, datetime(2024, 1, 1) + timedelta(seconds=30 * i), 10 * (i % 3), "purchase" if i % 4 else "view", float(i % 50 + 1)) for i in range(200)]
    spark.createDataFrame(data, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = plans.load()[0]["speaker_by_loudness"](spark, str(tmp_path))
    assert got.count() > 0 and "FileScan" not in got._jdf.queryExecution().executedPlan().toString()
