import math

import pytest
from conftest import rows
from pyspark.sql import functions as F

from parley.functions import faces, texts, times, vectors as vx


def one(spark, column, **values):
    df = spark.range(1)
    for name, value in values.items():
        df = df.withColumn(name, F.lit(value))
    return df.select(column).first()[0]


@pytest.mark.parametrize("ms, text", [(0, "00:00:00"), (3_723_999, "01:02:03"), (86_400_000, "00:00:00")])
def test_hms_wraps_at_a_day(spark, ms, text):
    assert one(spark, times.hms(F.col("v")), v=ms) == text


@pytest.mark.parametrize("ms, text", [(4406, "0:04.406"), (35008, "0:35.8")])
def test_minute_clock_is_not_padded(spark, ms, text):
    assert one(spark, times.minute_clock(F.col("v")), v=ms) == text


def test_hour_clock(spark):
    assert one(spark, times.hour_clock(F.col("v")), v=3723.456) == "1:2:3.46"


def test_frames_and_ms_truncate(spark):
    assert one(spark, times.frame_to_ms(F.col("v"), 30), v=100) == 3333
    assert one(spark, times.ms_to_frame(F.col("v"), 30), v=3333) == 99


def test_box_rounds_half_even_and_roi_only_shifts(spark):
    df = spark.createDataFrame([(1, 3, 5, 7, None), (1, 3, 5, 7, (10, 20))], "t int, r int, b int, l int, roi struct<x:int,y:int>")
    out = df.select(faces.original_box(F.col("t"), F.col("r"), F.col("b"), F.col("l"), F.lit(2.0), F.lit(2.0), F.col("roi")).alias("o"))
    assert [tuple(r.o) for r in out.collect()] == [(0, 2, 2, 4), (21, 13, 25, 17)]


def test_distance_is_infinite_without_a_side(spark):
    assert one(spark, vx.distance(F.array(F.lit(0.0), F.lit(3.0)), F.array(F.lit(4.0), F.lit(0.0)))) == 5.0
    assert math.isinf(one(spark, vx.distance(F.array(F.lit(0.0)), F.lit(None).cast("array<double>"))))


def test_standardised(spark):
    got = one(spark, vx.standardised(F.array(F.lit(1.0), F.lit(3.0))))
    assert got == pytest.approx([-1 / 1.00001, 1 / 1.00001])


def test_emotion_first_maximum_wins(spark):
    scores = lambda v: F.array(*[F.lit(x) for x in v])
    assert one(spark, faces.emotion(scores([0, 0, 0, 9, 9, 0, 0]))) == "Positive"
    assert one(spark, faces.emotion(scores([0, 5, 0, 0, 0, 5, 0]))) == "Negative"


def test_normalised(spark):
    assert one(spark, texts.normalised(F.col("v")), v="ＡＢ-c\n3.14 и 10") == "abc0 и 0"


def test_transcript_marks(spark):
    assert one(spark, texts.without_marks(F.col("v")), v="「あ。」 い？;x…") == "あいx"


def test_kept_words(spark):
    df = spark.createDataFrame([(["あ", "ああ", "ア", "word", "stop"],)], "w array<string>")
    assert df.select(texts.kept_words(F.col("w"), ["stop"])).first()[0] == ["ああ", "word"]


def test_word_pairs(spark):
    df = spark.createDataFrame([(["b", "a", "c"],)], "w array<string>")
    assert [tuple(p) for p in df.select(texts.word_pairs(F.col("w"))).first()[0]] == [("a", "b"), ("b", "c"), ("a", "c")]


def test_parsers(spark):
    assert one(spark, texts.int_tuple(F.col("v")), v="(1, -2, 3)") == [1, -2, 3]
    assert one(spark, texts.float_list(F.col("v")), v="[ 1.5  2\n 3e-1]") == [1.5, 2.0, 0.3]
    assert one(spark, texts.numbers_of(F.col("v")), v="result10_2.csv") == [10, 2]


def test_mouth_aspect_ratio(spark):
    lips = "array(" + ",".join(f"named_struct('x',{x},'y',{y})" for x, y in [(0, 0), (1, 1), (2, 2), (3, 2), (4, 2)]) + ")"
    low = "array(" + ",".join(f"named_struct('x',{x},'y',{y})" for x, y in [(6, 0), (5, 0), (4, 0), (3, 0), (2, 0)]) + ")"
    got = spark.range(1).select(F.expr(lips).alias("t"), F.expr(low).alias("b")).select(faces.mouth_aspect_ratio(F.col("t"), F.col("b"))).first()[0]
    assert got == pytest.approx(2 / 6)
