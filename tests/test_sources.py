import json
import os

import pytest
from conftest import rows
from pyspark.sql import functions as F

from parley.operators.audio import mixed, trimmed
from parley.operators.sets import missing
from parley.sources import tables as tb


def test_bom_and_quotes(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_bytes(('﻿Order,Start time(HH:MM:SS),End time(HH:MM:SS),Text,Speaker,Start time(ms),End time(ms)\n'
                      '0,00:00:00,00:00:01,"a ""b"", c",1,0,1000\n1,00:00:01,00:00:02,,0,1000,2000\n').encode("utf-8"))
    out = tb.read_csv(spark, str(path), tb.TRANSCRIPT, columns=["Order", "Text", "Speaker"])
    assert rows(out, "Order") == [(0, 'a "b", c', 1), (1, None, 0)]


def test_person_comes_from_the_file_name(spark, tmp_path):
    head = "frame_number,time(ms),prediction,x,y,absolute_x,relative_x,x_movement,absolute_y,relative_y,y_movement,mouse opening,gesture,top,bottom,left,right,gesture_threshold\n"
    for name, frame in [("result2.csv", 1), ("result10.csv", 2), ("result3_1.csv", 3), ("other.csv", 9)]:
        (tmp_path / name).write_bytes((head + f"{frame},33,喜び,0,0,0,0,0,0,0,0.5,0.1,1,0,9,0,9,1\n").encode("shift_jis"))
    out = tb.read_person_series(spark, str(tmp_path))
    assert rows(out.select("person", "part", "frame_number", "prediction"), "person") == [(2, 0, 1, "喜び"), (3, 1, 3, "喜び"), (10, 0, 2, "喜び")]


def test_one_folder_per_meeting(spark, tmp_path):
    df = spark.createDataFrame([(m, i, f"t{m}{i}") for m in (0, 1) for i in range(3)], "meeting int, Order int, Text string")
    tb.write_csv(df, str(tmp_path / "o"), by=["meeting"], order=["Order"])
    assert sorted(p.name for p in (tmp_path / "o").iterdir() if p.is_dir()) == ["meeting=0", "meeting=1"]
    assert rows(tb.read_csv(spark, str(tmp_path / "o"), "Order INT, Text STRING, meeting INT").select("meeting", "Order", "Text"), "meeting", "Order") == rows(df, "meeting", "Order")


def test_printed_arrays_over_lines(spark, tmp_path):
    (tmp_path / "f.csv").write_text(',frame_number,location,is_detected,encoding\n0,3,[1 2 3 4],True,"[ 0.5 -1.\n 2e-1]"\n')
    assert rows(tb.read_faces(spark, str(tmp_path / "f.csv"))) == [(3, [1, 2, 3, 4], True, [0.5, -1.0, 0.2])]


def test_pose_headers_and_labels(spark, tmp_path):
    folder = tmp_path / "nod-folder"
    folder.mkdir()
    (folder / "nod-2.csv").write_text("frame, timestamp, confidence\n1, 0.5, 0.9\n")
    (folder / "other-10.csv").write_text("frame, timestamp, confidence\n2, 0.7, 0.3\n")
    assert tb.read_pose(spark, str(folder)).columns == ["frame", "timestamp", "confidence"]
    out = tb.read_labelled_pose(spark, str(folder))
    assert rows(out.select("file", "label", "confidence", "file_place"), "file_place") == [("nod-2.csv", 1, 0.9, 0), ("other-10.csv", 0, 0.3, 1)]


def test_run_parameters(spark, tmp_path):
    run = {"video_path": "v.mp4", "offset": 3, "result": {"ann": {"audio_path": "a.wav", "rgb": [1, 2, 3], "roi": [0, 1, 2, 3]},
                                                          "bo": {"audio_path": "b.wav", "rgb": [4, 5, 6], "roi": [4, 5, 6, 7]}}}
    (tmp_path / "p.json").write_text(json.dumps(run, indent=2))
    out = tb.read_run_parameters(spark, str(tmp_path / "p.json"))
    assert rows(out, "person") == [("v.mp4", 3, "ann", "a.wav", [1, 2, 3], [0, 1, 2, 3]), ("v.mp4", 3, "bo", "b.wav", [4, 5, 6], [4, 5, 6, 7])]
    tb.write_run_parameters(out, str(tmp_path / "back"))
    assert rows(tb.read_run_parameters(spark, str(tmp_path / "back"), lines=True), "person") == rows(out, "person")


def test_heading_lines_and_single_words_are_skipped(spark, tmp_path):
    (tmp_path / "l.txt").write_text("a,b\n見出し,x\nc\nd,e,f\n", encoding="utf-8")
    assert sorted(r.words for r in tb.read_lines(spark, str(tmp_path / "l.txt")).collect()) == [["a", "b"], ["d", "e", "f"]]


def test_split_text(spark, tmp_path):
    df = spark.createDataFrame([(0, "x"), (1, "y"), (0, "z")], "s int, t string")
    tb.write_split_text(df, str(tmp_path / "o"), ["t"], "s")
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "o/all")).collect()) == ["x", "y", "z"]
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "o/split/s=0")).collect()) == ["x", "z"]


def test_speaker_folders(spark, tmp_path):
    for folder in ("bea", "al", "cy"):
        os.makedirs(tmp_path / folder / "audio")
        (tmp_path / folder / "audio" / "1.wav").write_bytes(b"x")
    out = tb.speaker_files(spark, str(tmp_path))
    assert rows(out.select("folder", "speaker"), "speaker") == [("al", 0), ("bea", 1), ("cy", 2)]
    assert tb.speaker_files(spark, str(tmp_path), 2).count() == 2


def test_labelled_list(spark, tmp_path):
    (tmp_path / "l.txt").write_text("a/b/c/d/e.wav 3\nf.wav 4\n")
    assert rows(tb.read_labelled_list(spark, str(tmp_path / "l.txt"), "root"), "label") == [("root/a/b/c/d/e.wav", 3), ("root/f.wav", 4)]
    assert tb.read_labelled_list(spark, str(tmp_path / "l.txt"), tail=4).orderBy("label").first().file == "b/c/d/e.wav"


def test_parts_and_sampling(spark):
    a, b = spark.range(2), spark.range(3)
    assert rows(tb.concat_parts([a, b], "id"), "part", "id") == [(0, 0), (1, 0), (0, 1), (1, 1), (2, 1)]
    two = spark.range(10).selectExpr("0 AS k", "id").unionAll(spark.range(4).selectExpr("1 AS k", "id"))
    assert rows(tb.every_nth(two, ["k"], "id", 3), "k", "id") == [(0, 0), (0, 3), (0, 6), (0, 9), (1, 0), (1, 1), (1, 2), (1, 3)]


def test_schema(spark):
    out = tb.with_schema(spark.createDataFrame([("7", 1)], "`speaker class` string, `time(ms)` int"), tb.DIARIZATION)
    assert out.dtypes == [("time(ms)", "bigint"), ("speaker class", "int")]


def test_mix_is_as_long_as_the_first_microphone(spark):
    df = spark.createDataFrame([(0, 0, 0, 5), (0, 1, 0, 9), (0, 1, 1, 4), (0, 0, 1, -30), (0, 1, 2, 7)], "k int, mic int, t_ms long, amplitude int")
    assert rows(mixed(df, ["k"], 10), "t_ms") == [(0, 0, 10), (0, 1, -10)]
    assert rows(trimmed(df.filter("mic = 1"), 1, 3).select("t_ms", "amplitude"), "t_ms") == [(0, 4), (1, 7)]


def test_missing_labels(spark):
    df = spark.createDataFrame([(0, "a"), (0, "b"), (1, "c")], "k int, l string")
    assert rows(missing(df, ["k"], "l", ["a", "b", "c"]), "k", "l") == [(0, "c"), (1, "a"), (1, "b")]


def test_faces_written_by_several_tasks(spark, tmp_path):
    df = spark.createDataFrame([(i, [1, 2, 3, i], True, [0.5, float(i)]) for i in range(40)],
                               "frame_number long, location array<int>, is_detected boolean, encoding array<double>").repartition(4)
    tb.write_faces(df, str(tmp_path / "faces"))
    out = tb.read_faces(spark, str(tmp_path / "faces"))
    assert rows(out.select("frame_number", "location"), "frame_number") == [(i, [1, 2, 3, i]) for i in range(40)]
