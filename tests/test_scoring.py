import itertools
import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from parley.operators import scoring as sc


def matched(spark, a, b):
    frame = lambda s: spark.createDataFrame([(0, i, x) for i, x in enumerate(s)], "k long, pos long, label int")
    return sc.sequence_match(sc.aligned(frame(a), frame(b), ["k"], "pos", "label"), ["k"], "label1", "label2").first()


@pytest.mark.parametrize("a, b, want", [([0, 0, 1, 2, 2], [3, 3, 4, 4, 1], 0.8), ([0, 0, 1, 2, 2], [3, 3, 4, 1, 1], 1.0), ([1, 1], [1, 2], 0.5)])
def test_sequence_match(spark, a, b, want):
    assert matched(spark, a, b).accuracy == matched(spark, b, a).accuracy == pytest.approx(want)


def test_sequences_of_unequal_length_are_an_error(spark):
    with pytest.raises(Exception, match="label of either sequence"):
        matched(spark, [1, 2, 3], [1, 2])


def test_best_assignment_against_all():
    rng = np.random.default_rng(1)
    for shape in [(1, 1), (3, 3), (4, 2), (2, 5)]:
        gain = rng.integers(0, 9, shape).astype(float)
        g = gain if shape[0] <= shape[1] else gain.T
        want = max(sum(g[i, p[i]] for i in range(len(g))) for p in itertools.permutations(range(g.shape[1]), len(g)))
        assert sc.best_assignment(gain) == want


def plain_errors(ans, heard):
    m = [[max(i, j) if not i or not j else 0 for j in range(len(heard) + 1)] for i in range(len(ans) + 1)]
    for i in range(1, len(ans) + 1):
        for j in range(1, len(heard) + 1):
            m[i][j] = m[i - 1][j - 1] if ans[i - 1] == heard[j - 1] else 1 + min(m[i - 1][j], m[i][j - 1], m[i - 1][j - 1])
    i, j, ins, dele, sub, hit = len(ans), len(heard), 0, 0, 0, 0
    while i or j:
        if i and j and m[i][j] == m[i - 1][j - 1] and ans[i - 1] == heard[j - 1]:
            i, j, hit = i - 1, j - 1, hit + 1
        elif j and m[i][j] == m[i][j - 1] + 1:
            j, ins = j - 1, ins + 1
        elif i and m[i][j] == m[i - 1][j] + 1:
            i, dele = i - 1, dele + 1
        else:
            i, j, sub = i - 1, j - 1, sub + 1
    return ins, dele, sub, hit


@pytest.mark.parametrize("strip", [512, 3, 1])
def test_error_counts(strip, monkeypatch):
    monkeypatch.setattr(sc, "KEPT_ROWS", strip)
    random.seed(strip)
    for _ in range(60):
        a, b = ([random.choice("abcd") for _ in range(random.randint(0, 12))] for _ in range(2))
        assert sc._edit_counts(a, b) == plain_errors(a, b)


def test_transcript_errors_and_distance(spark):
    data = [(["A", "b", "c"], ["a", "x", "c", "d"]), (["a"], []), (["é", "b"], ["e", "b"])]
    df = spark.createDataFrame(data, "ans array<string>, heard array<string>")
    out = sc.transcript_errors(df, "ans", "heard").withColumn("d", sc.word_distance(F.col("ans"), F.col("heard")))
    assert [(r["ins"], r["del"], r["sub"], r.correct, r.words, r.d) for r in out.collect()] == [(1, 0, 1, 2, 3, 2), (0, 1, 0, 0, 1, 1), (0, 0, 1, 1, 2, 1)]


def test_equal_error_rate(spark):
    data = [(0, 1, 0.9), (0, 1, 0.8), (0, 0, 0.7), (0, 1, 0.6), (0, 0, 0.5), (0, 0, 0.4)]
    r = sc.equal_error_rate(spark.createDataFrame(data, "k long, y int, s double"), ["k"], "y", "s").first()
    assert r.eer == pytest.approx(1 / 3) and r.threshold == pytest.approx(0.7)


def test_transition_bias(spark):
    df = spark.createDataFrame([(0, 0, "a"), (0, 1, "a"), (0, 2, "b"), (1, 0, "a")], "k long, pos long, l string")
    b = sc.transition_bias(df, ["k"], "pos", "l")
    assert rows(b, "k") == [(0, pytest.approx(2 / 3), 3), (1, 1.0, 1)]
    assert sc.merged_bias(b).first().bias == pytest.approx(3 / 4)


def sequences(spark):
    data = [(0, i, [0.0, 0.0], c) for i, c in enumerate("aba")] + [(1, i, [1.0, 1.0], c) for i, c in enumerate("abcb")]
    return spark.createDataFrame(data, "sequence_id long, pos long, embedding array<double>, cluster_id string")


def test_assembled_sequences(spark):
    out = sc.assembled(sequences(spark)).orderBy("place").collect()
    assert [r.place for r in out] == list(range(7))
    assert [r.embedding[0] for r in out] == [0.0] * 3 + [1.0] * 4
    assert [r.cluster_id for r in out] == ["0_a", "0_b", "0_a", "1_a", "1_b", "1_c", "1_b"]
    shuffled = sc.assembled(sequences(spark), seed=3).orderBy("place").collect()
    assert [r.place for r in shuffled] == list(range(7)) and sorted(r.cluster_id for r in shuffled) == sorted(r.cluster_id for r in out)


def test_unequal_vectors_are_an_error(spark):
    bad = sequences(spark).union(spark.createDataFrame([(2, 0, [1.0], "a")], sequences(spark).schema))
    with pytest.raises(ValueError):
        sc.assembled(bad)


def test_regrouped(spark):
    df = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (0, 2, 1)], "k long, pos long, label int")
    assert rows(sc.regrouped(df, ["k"], "pos", "label"), "pos") == [(0, 1, 0, 0, 3), (0, 2, 1, 0, 2), (0, 1, 2, 1, 3)]


def test_random_mixes(spark):
    out = sc.random_mixes(spark.range(300).withColumnRenamed("id", "u"), "u", 20, 1).collect()
    per = {}
    for r in out:
        per.setdefault(r["sample"], []).append(r["u"])
    assert len(per) == 20 and all(10 <= len(v) <= 19 and len(set(v)) == len(v) for v in per.values())
    few = sc.random_mixes(spark.range(4).withColumnRenamed("id", "u"), "u", 3, 1).collect()
    assert sorted(r["u"] for r in few if r["sample"] == 0) == [0, 1, 2, 3]


def test_classification_report(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0)], "y int, p int")
    r = sc.classification_report(df, "y", "p").first()
    assert (r.tp, r.fp, r.fn, r.tn, r.accuracy, r.precision, r.recall) == (1, 0, 1, 2, 0.75, 1.0, 0.5)


def test_characters_of_the_word_distance_beyond_the_surrogates(spark):
    text = lambda *points: F.decode(F.unhex(F.lit("".join(f"{p:08X}" for p in points))), "UTF-32")
    df = spark.range(1).select(F.levenshtein(text(0x10900, 0x10901, 0xE000), text(0x10901, 0xE000)).alias("d"), F.length(text(0x10900)).alias("n"))
    assert tuple(df.first()) == (1, 1)


def test_sequence_match_is_spread_over_tasks(spark):
    """Many short sequences are few bytes, but their matrices must not all be assigned in one task."""
    data = [(k, i, (i + k) % 3, "abcdefg"[(i * k) % (2 + k % 6)]) for k in range(200) for i in range(12)]
    df = spark.createDataFrame(data, "k long, i long, label1 int, label2 string")
    out = sc.sequence_match(df, ["k"], "label1", "label2")
    assert out.withColumn("part", F.spark_partition_id()).select("part").distinct().count() > 1
    want = {}
    for k in range(200):
        pairs = [(a, b) for key, _, a, b in data if key == k]
        many, few = sorted({b for _, b in pairs}), sorted({a for a, _ in pairs})
        few, many, pairs = (few, many, pairs) if len(few) <= len(many) else (many, few, [(b, a) for a, b in pairs])
        want[k] = max(sum(dict(zip(few, p))[a] == b for a, b in pairs) for p in itertools.permutations(many, len(few))) / 12
    assert {r.k: r.accuracy for r in out.collect()} == want


@pytest.mark.parametrize("shape", [(3, 4), (5, 5), (6, 6), (7, 3)])
def test_best_assignment_of_any_size(shape):
    gain = np.random.default_rng(sum(shape)).integers(0, 50, shape).astype(float)
    wide = gain if shape[0] <= shape[1] else gain.T
    want = max(sum(wide[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(wide.shape[1]), len(wide)))
    assert sc.best_assignment(gain) == want
