import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.operators import clustering as cl

SCHEMA = "k string, id long, x array<double>"


def planted(groups, per, dims, noise, seed=0, key="a", start=0):
    r = np.random.default_rng(seed)
    centre = np.linalg.qr(r.normal(size=(dims, dims)))[0][:groups]
    return [(key, start + i, [float(v) for v in centre[i % groups] + r.normal(scale=noise, size=dims)]) for i in range(groups * per)]


def parts(found, name):
    out = {}
    for r in found:
        out.setdefault(r[name], set()).add(r.id)
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize("rows", [4096, 50])
def test_six_planted_speakers_are_found(spark, rows):
    data = planted(6, 60, 32, 0.08)
    found = cl.spectral(spark.createDataFrame(data, SCHEMA), ["k"], "id", "x", rows=rows).collect()
    assert {r.clusters for r in found} == {6} and len(found) == 360
    assert parts(found, "speaker") == sorted([i for i in range(360) if i % 6 == g] for g in range(6))
    assert {r.id: r.speaker for r in found if r.id < 6} == {i: i for i in range(6)}  # numbered by their first window


def test_more_windows_than_landmarks_uneven_speakers_several_recordings(spark):
    r = np.random.default_rng(4)
    sizes = [700, 150, 90]
    centre = np.linalg.qr(r.normal(size=(16, 16)))[0]
    data, truth = [], {}
    for g, n in enumerate(sizes):
        for _ in range(n):
            truth[len(data)] = g
            data.append(("big", len(data), [float(v) for v in centre[g] + r.normal(scale=0.06, size=16)]))
    data += planted(2, 20, 16, 0.05, 7, "small", 10_000)
    data += [("one", 20_000, [1.0] * 16), ("small", 30_000, None), ("small", 30_001, [float("nan")] * 16)]
    found = cl.spectral(spark.createDataFrame(data, SCHEMA), ["k"], "id", "x", landmarks=64, rows=200).collect()
    by = {k: {r.clusters for r in found if r.k == k and r.speaker is not None} for k in ("big", "small", "one")}
    assert by == {"big": {3}, "small": {2}, "one": {1}}
    label = {r.id: r.speaker for r in found if r.k == "big"}
    assert len({(truth[i], label[i]) for i in truth}) == 3
    assert {r.id for r in found if r.speaker is None} == {30_000, 30_001} and len(found) == len(data)


def test_bounds_of_the_number(spark):
    df = spark.createDataFrame(planted(4, 30, 16, 0.05), SCHEMA)
    assert {r.clusters for r in cl.spectral(df, ["k"], "id", "x", least=6, most=8).collect()} <= {6, 7, 8}
    assert {r.clusters for r in cl.spectral(df, ["k"], "id", "x", least=2, most=3).collect()} <= {2, 3}


def test_every_vector_is_at_its_nearest_centre(spark):
    r = np.random.default_rng(2)
    data = [(f"k{i % 2}", i, [float(v) for v in r.normal(size=5)]) for i in range(300)] + [("k0", 999, None)]
    df = spark.createDataFrame(data, SCHEMA)
    wanted = spark.createDataFrame([("k0", 3), ("k1", 5)], "k string, wanted int")
    found, centres = cl.kmeans(df, ["k"], "id", "x", wanted, rows=40, rounds=60)
    found, centres = found.collect(), centres.collect()
    assert len(found) == 301 and [r.cluster for r in found if r.id == 999] == [None]
    where = {(c.k, c.cluster): np.array(c.centre) for c in centres}
    assert sorted(where) == [("k0", c) for c in range(3)] + [("k1", c) for c in range(5)]
    x = {i: np.array(v) for _, i, v in data if v}
    for r_ in found:
        if r_.cluster is None:
            continue
        gaps = {c: np.linalg.norm(x[r_.id] - v) for (key, c), v in where.items() if key == r_.k}
        assert gaps[r_.cluster] == pytest.approx(min(gaps.values())) and r_.distance == pytest.approx(gaps[r_.cluster])
    for (key, c), v in where.items():
        own = [x[r_.id] for r_ in found if r_.k == key and r_.cluster == c]
        assert v == pytest.approx(np.mean(own, axis=0), abs=1e-6)


def test_corners_of_a_square_and_few_distinct_vectors(spark):
    r = np.random.default_rng(0)
    corners = [(0, 0), (0, 1), (1, 0), (1, 1)]
    data = [("a", i, [float(c + e) for c, e in zip(corners[i % 4], r.normal(scale=0.01, size=2))]) for i in range(80)]
    data += [("b", 100 + i, [float(i % 2), 0.0]) for i in range(10)]
    found, centres = cl.kmeans(spark.createDataFrame(data, SCHEMA), ["k"], "id", "x", 4, rows=16)
    found = found.collect()
    assert parts([f for f in found if f.k == "a"], "cluster") == sorted([i for i in range(80) if i % 4 == g] for g in range(4))
    assert parts([f for f in found if f.k == "b"], "cluster") == [[100, 102, 104, 106, 108], [101, 103, 105, 107, 109]]


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert cl.kmeans(df, ["k"], "id", "x", 3)[0].count() == 0
    assert cl.spectral(df, ["k"], "id", "x").count() == 0
