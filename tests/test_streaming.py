import random

import pytest
from pyspark.sql import functions as F

from parley.operators import features as ft, replay as rp
from parley.streaming import stateful as st

START = "timestamp_seconds(1704067200 + frame * 60)"  # a frame a minute


def arriving(spark, df, path, files, shuffled=None):
    """The rows in several files, read one file per micro-batch, in the order of frames or shuffled."""
    data = df.orderBy("frame").collect()
    if shuffled is not None:
        random.Random(shuffled).shuffle(data)
    size = -(-len(data) // files)
    for i in range(files):
        part = spark.createDataFrame(data[i * size:(i + 1) * size], df.schema).withColumn("ts", F.expr(START))
        part.coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(spark.read.parquet(str(path)).schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def table(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()))


@pytest.mark.parametrize("shuffled, few", [(None, 4096), (5, 4096), (5, 3)])
def test_nods_in_a_stream_are_those_of_the_batch(spark, tmp_path, shuffled, few, monkeypatch):
    monkeypatch.setattr(st, "FEW", few)
    random.seed(1)
    df = spark.createDataFrame([(p, f, 0, random.choice([0, 3, 40]), 100) for p in (0, 1) for f in range(200)], "p long, frame long, x int, y int, height int")
    events = arriving(spark, df, tmp_path / "s", 4, shuffled)
    out = st.drain(lambda s: st.nod_stream(s, ["p"], slot_ms=1_200_000), events, spark, "test")
    cols = ["p", "frame", "x_movement", "y_movement", "gesture"]
    assert table(out, *cols) == table(rp.detect_nods(df, ["p"]), *cols)
    assert st.late_rows(out) == 0


def test_rows_behind_the_watermark_are_dropped_and_counted(spark, tmp_path):
    schema = "p long, frame long, x int, y int, height int"
    for frame in (0, 100, 103, 3, 106):  # 3 comes when 103 has moved the watermark to 93
        row = spark.createDataFrame([(0, frame, 0, 0, 100)], schema).withColumn("ts", F.expr(START))
        row.coalesce(1).write.mode("append").parquet(str(tmp_path / "s"))
    events = spark.readStream.schema(spark.read.parquet(str(tmp_path / "s")).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "s"))
    out = st.drain(lambda s: st.nod_stream(s, ["p"], k=1, late="10 minutes", slot_ms=60_000), events, spark, "test")
    assert sorted(r.frame for r in out.collect()) == [0, 100, 103, 106]
    assert st.late_rows(out) == 1


def test_rows_without_time_or_key_are_left_out(spark, tmp_path):
    schema = "p long, frame long, x int, y int, height int, ts timestamp"
    df = spark.createDataFrame([(0, 3, 0, 0, 100), (None, 6, 0, 0, 100), (1, 9, 0, 0, 100)], "p long, frame long, x int, y int, height int")
    df = df.withColumn("ts", F.when(F.col("frame") != 9, F.expr(START)))
    df.write.parquet(str(tmp_path / "s"))
    out = st.drain(lambda s: st.nod_stream(s, ["p"]), spark.readStream.schema(schema).parquet(str(tmp_path / "s")), spark, "test")
    assert [r.frame for r in out.collect()] == [3]


@pytest.mark.parametrize("shuffled", [None, 6])
def test_running_values_in_a_stream(spark, tmp_path, shuffled):
    random.seed(2)
    df = spark.createDataFrame([(p, f, random.uniform(-1, 11), random.random() < 0.7) for p in (0, 1) for f in range(60)], "p long, frame long, value double, success boolean")
    s = arriving(spark, df, tmp_path / "s", 3, shuffled)
    slot = 420_000
    got = {(r.p, r.frame): r.median for r in st.drain(lambda e: st.median_stream(e, ["p"], 10, 0.0, 10.0, slot_ms=slot), s, spark, "m").collect()}
    want = {(r.p, r.frame): r.median for r in rp.running_median(df, ["p"], "frame", "value", "success", 10, 0.0, 10.0).collect()}
    assert got == pytest.approx(want)
    got = {(r.p, r.frame): r.corrected for r in st.drain(lambda e: st.correction_stream(e, ["p"], slot_ms=slot), s, spark, "c").collect()}
    want = {(r.p, r.frame): r.corrected for r in rp.online_correction(df, ["p"], "frame", "value").collect()}
    assert got == pytest.approx(want)


def test_keys_share_a_group_and_its_timer(spark, tmp_path, monkeypatch):
    """The cost of a group and its timer does not come with every key; slots of few rows are worked on together."""
    monkeypatch.setattr(st, "GROUPS", 2)
    monkeypatch.setattr(st, "FEW", 5)
    monkeypatch.setattr(st, "MANY", 7)
    random.seed(4)
    df = spark.createDataFrame([(p, f"q{p % 3}", f, random.uniform(-1, 4)) for p in range(7) for f in range(20)], "p long, q string, frame long, value double")
    out = st.drain(lambda e: st.correction_stream(e, ["p", "q"], slot_ms=240_000), arriving(spark, df, tmp_path / "s", 1), spark, "g")
    got = {(r.p, r.q, r.frame): r.corrected for r in out.collect()}
    assert len(got) == out.count() == 140
    assert got == pytest.approx({(r.p, r.q, r.frame): r.corrected for r in rp.online_correction(df, ["p", "q"], "frame", "value").collect()})


@pytest.mark.parametrize("shuffled", [None, 7])
def test_carried_values_in_a_stream(spark, tmp_path, shuffled):
    random.seed(3)
    df = spark.createDataFrame([(0, f, float(f), random.random() < 0.4, "n") for f in range(30)], "p long, frame long, x double, seen boolean, label string")
    out = st.drain(lambda s: st.carry_stream(s, ["p"], ["x"], slot_ms=300_000), arriving(spark, df, tmp_path / "s", 4, shuffled), spark, "k")
    cols = ["frame", "x", "label"]
    key = lambda rows: sorted(map(str, rows))
    assert key(table_rows(out, cols)) == key(table_rows(ft.carry_known(df, ["p"], "frame", ["x"], "seen", "label"), cols))


def table_rows(df, cols):
    return map(tuple, df.select(*cols).collect())


def test_late_rows_are_dropped_from_the_panel_and_the_last_window_comes_out(spark, tmp_path):
    data = [("2024-01-01 00:01:00", "a"), ("2024-01-01 02:00:00", "a"), ("2024-01-01 02:01:00", "a"), ("2024-01-01 00:02:00", "late"), ("2024-01-01 05:00:00", "a")]
    for ts, label in data:
        row = spark.createDataFrame([(ts, 0, 10, label)], "t string, meeting long, time_ms long, label string")
        row.select(F.col("t").cast("timestamp").alias("ts"), "meeting", "time_ms", "label").coalesce(1).write.mode("append").parquet(str(tmp_path / "s"))
    schema = spark.read.parquet(str(tmp_path / "s")).schema
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "s"))
    utterances = spark.createDataFrame([(0, 4, 0, 50), (0, 5, 50, 90)], "meeting long, ord long, start_ms long, end_ms long")
    drained = st.drain(lambda s: st.live_panel(s, utterances, "1 hour", "10 minutes", 20), events, spark, "panel")
    assert sorted((r.start.hour, r.ord, r.label, r.n) for r in drained.collect()) == [(0, 4, "a", 1), (2, 4, "a", 2), (5, 4, "a", 1)]
    assert st.late_rows(drained) == 1
