import numpy as np
from pyspark.sql import functions as F

from parley.operators import classify as cf


def windows(spark, recordings=10, per=60):
    """Label 1 inside a ring, which no straight line separates; two features tell it, three are noise, one has a gap."""
    r = np.random.default_rng(1)
    rows = []
    for k in range(recordings):
        for _ in range(per):
            x = r.uniform(-2, 2, size=2)
            rows.append((f"rec{k}", *map(float, x * 10), *map(float, r.normal(size=3)), None if len(rows) % per == 7 else 1.0, int(x @ x < 1.6)))
    return spark.createDataFrame(rows, "recording string, a double, b double, c double, d double, e double, gap double, label int")


def test_unseen_recordings_are_told_apart(spark):
    df = windows(spark).cache()
    squared = df.withColumns({"aa": F.col("a") ** 2, "bb": F.col("b") ** 2})
    model, report = cf.validated(squared, ["a", "b", "c", "d", "e", "gap", "aa", "bb"], "recording", keep=2, rounds=20)
    row = report.first()
    assert model.used == ["a", "b", "c", "d", "e", "aa", "bb"]  # a feature with a gap is dropped
    assert row.tp + row.tn + row.fp + row.fn in (60, 120, 180, 240) and row.accuracy > 0.9
    seen, unseen = (set(r.recording for r in part.select("recording").distinct().collect()) for part in cf.split_by_recording(df, "recording"))
    assert not seen & unseen and len(seen | unseen) == 10 and unseen


def test_random_features_follow_the_kernel(spark):
    from pyspark.ml.functions import array_to_vector, vector_to_array

    r = np.random.default_rng(0)
    x = r.normal(size=(30, 4))
    w, b = r.normal(scale=np.sqrt(2 / 4), size=(4, 4096)), r.uniform(0, 2 * np.pi, 4096)
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "i int, x array<double>")
    z = np.array([r[0] for r in df.orderBy("i").select(vector_to_array(cf.random_features(array_to_vector(F.col("x")), w, b))).collect()])
    kernel = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / 4)
    assert np.abs(z @ z.T - kernel).max() < 0.08


def test_one_label_or_none(spark):
    df = windows(spark)
    model = cf.train_nods(df.filter("label = 1"), ["a", "b"])
    assert [r[0] for r in cf.predict_nods(model, df).select("pred").distinct().collect()] == [1]
    assert cf.train_nods(df.limit(0), ["a", "b"]).constant == 0
