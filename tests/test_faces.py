import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from parley.operators import faces as fc

VEC = "k long, frame long, vec long, encoding array<double>"


def gallery(spark, data):
    return spark.createDataFrame(data, "k long, person int, sample long, encoding array<double>")


def test_contested_vector_goes_to_the_last_person(spark):
    vectors = spark.createDataFrame([(0, 0, 1, [0.0, 0.0]), (0, 0, 2, [5.0, 0.0])], VEC)
    known = gallery(spark, [(0, 0, 0, [0.0, 0.0]), (0, 1, 1, [0.2, 0.0]), (0, 2, 2, [5.1, 0.0]), (0, 3, 3, [9.0, 0.0])])
    out = fc.gallery_match(vectors, known, ["k"], 0.35, 10)
    assert [(r.vec, r.person) for r in out.orderBy("vec").collect()] == [(1, 1), (2, 2)]


def test_unknown_meeting_claims_nothing(spark):
    vectors = spark.createDataFrame([(0, 0, 1, [0.0]), (1, 0, 2, [0.0])], VEC)
    out = fc.gallery_match(vectors, gallery(spark, [(0, 0, 0, [0.0])]), ["k"], 0.35, 10)
    assert [(r.k, r.vec) for r in out.collect()] == [(0, 1)]


@pytest.mark.parametrize("block", [2048, 3])
def test_distances_over_many_blocks(spark, block, monkeypatch):
    monkeypatch.setattr(fc, "BLOCK", block)
    rng = np.random.default_rng(1)
    v, g = rng.normal(size=(40, 4)), rng.normal(size=(25, 4))
    vectors = spark.createDataFrame([(0, i // 3, i, [float(x) for x in v[i]]) for i in range(40)], VEC)
    known = gallery(spark, [(0, i % 4, i, [float(x) for x in g[i]]) for i in range(25)])
    out = {(r.vec, r.person): r.distance for r in fc.person_distances(vectors, known, ["k"], 5).collect()}
    assert len(out) == 160
    for (i, p), d in out.items():
        assert d == pytest.approx(min(np.linalg.norm(v[i] - g[j]) for j in range(25) if j % 4 == p))


def test_reference_faces(spark):
    df = spark.createDataFrame([(0, 0, 0, 1, 50, [1.0]), (0, 0, 0, 2, 60, [2.0]), (0, 9, 30_000, 3, 50, [3.0]), (0, 1, 100, 4, 500, [4.0])],
                               "k long, frame long, time_ms long, vec long, face_x int, encoding array<double>")
    rois = spark.createDataFrame([(0, 7, 0, 100)], "k long, person int, roi_from int, roi_to int")
    assert [(r.frame, r.person, r["sample"]) for r in fc.reference_faces(df, rois, ["k"]).collect()] == [(0, 7, 1)]


def test_densest_first_and_overfull_frames_skipped(spark):
    data = [(0, f, 10 * f + i, [0.0]) for f, n in enumerate([1, 3, 2, 4]) for i in range(n)]
    out = fc.densest_faces(spark.createDataFrame(data, VEC), ["k"], 3, 4)
    assert sorted(r.vec for r in out.collect()) == [10, 11, 12, 20]


def test_clusters_take_all_vectors_and_as_many_persons_as_the_fullest_frame(spark):
    rng = np.random.default_rng(0)
    corners = [(0, 0), (0, 1), (1, 0), (1, 1), (3, 3), (3, 0)]
    # six faces in every third frame, four in the others; a second recording with one face a frame
    data, vec = [], 0
    for frame in range(30):
        for c in range(6 if frame % 3 == 0 else 4):
            data.append((0, frame, vec, [float(x + e) for x, e in zip(corners[c], rng.normal(scale=0.01, size=2))]))
            vec += 1
    data += [(1, f, 1000 + f, [float(f), 0.0]) for f in range(5)]
    out = fc.cluster_faces(spark.createDataFrame(data, VEC), ["k"], rows=32).collect()
    assert len(out) == len(data)
    found = {}
    for r in out:
        if r.k == 0:
            found.setdefault(tuple(round(x) for x in r.encoding), set()).add(r.person)
    assert len(found) == 6 and all(len(s) == 1 for s in found.values()) and len(set.union(*found.values())) == 6
    assert {r.person for r in out if r.k == 1} == {0}


def test_nearest_to_and_orientation(spark):
    df = spark.createDataFrame([(0, 0, 1, [0.0, 1.0]), (0, 0, 2, [3.0, 1.0])], VEC)
    assert rows(fc.nearest_to(df, spark.createDataFrame([("a", [0.0, 0.0]), ("b", [3.0, 0.0])], "name string, centre array<double>"), rows=1), "name") == [("a", 1, 1.0), ("b", 2, 1.0)]
    out = df.select(fc.nearest_orientation(F.col("encoding"), [[1.5, 1.0], [3.0, 1.0], [0.0, 1.0]]).alias("n"))
    assert [r.n for r in out.collect()] == [2, 1]
    tie = spark.createDataFrame([([1.0],)], "v array<double>").select(fc.nearest_orientation(F.col("v"), [[0.0], [2.0]])).first()[0]
    assert tie == 0


def test_speaker_distances(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(12, 3))
    df = spark.createDataFrame([(0, i, i, [float(x) for x in v[i]], i % 3) for i in range(12)], VEC + ", label int")
    for r in fc.speaker_distances(df, ["k"], "label").collect():
        a, b = v[r.speaker1::3], v[r.speaker2::3]
        assert r.distance == pytest.approx(np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2).mean()))
