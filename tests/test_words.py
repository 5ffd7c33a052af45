import collections
import itertools
import random

import pyarrow as pa
import pytest
from conftest import rows
from pyspark.sql import functions as F

from parley.operators import graph, words as wd


def sentences(spark, lists):
    return spark.createDataFrame(list(enumerate(lists)), "id long, words array<string>")


def test_vocabulary_cut(spark):
    s = sentences(spark, [["a", "b", "c"], ["a", "b"], ["a", "d"], ["a"]])
    counts = wd.word_counts(s)
    spectrum = wd.count_spectrum(counts)
    assert rows(spectrum, "count") == [(1, 2, 2, 0.5), (2, 1, 3, 0.75), (4, 1, 4, 1.0)]
    assert wd.vocabulary_size(spectrum, 0) == 2 and wd.vocabulary_size(spectrum, 1) == 1 and wd.vocabulary_size(spectrum, 3) == 1
    assert rows(wd.ranked_words(counts, 3), "rank") == [("a", 4, 0), ("b", 2, 1), ("c", 1, 2)]
    assert rows(wd.top_words(counts, 2)) == [("a", 4), ("b", 2)]


def test_the_top_word_is_dropped_only_on_request(spark):
    s = sentences(spark, [["a", "b"], ["a"], ["a", "b", "c"]])
    counts = wd.word_counts(s)
    assert rows(wd.bag_of_words(s, ["id"], wd.ranked_words(counts, 2)), "id", "rank") == [(0, 0), (0, 1), (1, 0), (2, 0), (2, 1)]
    assert rows(wd.bag_of_words(s, ["id"], wd.ranked_words(counts, 2, drop_top=True)), "id") == [(0, 1), (2, 1)]
    assert rows(wd.cut_sentences(s, ["id"], wd.ranked_words(counts, 2, drop_top=True)), "id") == [(0, ["b"]), (2, ["b"])]


@pytest.mark.parametrize("block, buffer", [(512, 1 << 22), (4, 20), (1, 1)])
def test_pairs_and_jaccard(spark, block, buffer, monkeypatch):
    monkeypatch.setattr(wd, "PAIR_BLOCK", block)
    monkeypatch.setattr(wd, "PAIR_BUFFER", buffer)
    random.seed(1)
    lists = [random.sample("abcdefghijk", random.randint(1, 9)) for _ in range(40)]
    s = sentences(spark, lists)
    vocabulary = wd.ranked_words(wd.word_counts(s), 100)
    pairs = wd.pair_counts(wd.coded_sentences(s, ["id"], vocabulary))
    got = {(r.word1, r.word2): r for r in wd.jaccard(pairs, vocabulary).collect()}
    want = collections.Counter(tuple(sorted(p)) for l in lists for p in itertools.combinations(l, 2))
    member = collections.Counter(w for p, n in want.items() for w in p for _ in range(n))
    assert {k: r.intersection_count for k, r in got.items()} == dict(want)
    for (a, b), r in got.items():
        union = member[a] + member[b] - want[a, b]
        assert (r.count1, r.count2, r.union_count) == (member[a], member[b], union)
        assert r.jaccard_coefficient == pytest.approx(want[a, b] / union)


@pytest.mark.parametrize("group, first", [(1 << 22, 200_000), (3, 2)])
def test_pairs_tell_their_words(spark, group, first, monkeypatch):
    monkeypatch.setattr(wd, "PAIR_GROUP", group)
    monkeypatch.setattr(wd, "PAIR_BUFFER", 40)
    monkeypatch.setattr(wd, "BROADCAST_ROWS", first)
    monkeypatch.setattr(wd.fits, "__defaults__", (first, 1 << 26))
    random.seed(2)
    lists = [random.sample("abcdefghijkéü", random.randint(1, 9)) for _ in range(40)] + [["alone"]]
    s = sentences(spark, lists)
    vocabulary = wd.ranked_words(wd.word_counts(s))
    coded = wd.coded_sentences(s, ["id"], vocabulary)
    plain = rows(wd.jaccard(wd.pair_counts(coded), vocabulary), "word1", "word2")
    known = vocabulary.join(wd.pair_members(coded), "rank").select("rank", "word", "members")
    assert plain and rows(wd.jaccard(wd.pair_counts(coded, known=known), known), "word1", "word2") == plain
    want = collections.Counter(tuple(sorted(p)) for l in lists for p in itertools.combinations(l, 2))
    assert {r[:2]: r[2] for r in plain} == dict(want)
    cut = vocabulary.filter("rank < 9")
    kept = {r.word for r in cut.collect()}
    assert rows(wd.cut_sentences(s, ["id"], cut), "id") == [(i, sorted(kept & set(l))) for i, l in enumerate(lists) if kept & set(l)]
    assert wd.bag_of_words(s, ["id"], cut).count() == sum(len(kept & set(l)) for l in lists)


def test_pair_packs_do_not_grow_with_the_square(spark, monkeypatch):
    """A task adds up its pairs before it sends them: four times the sentences made sixteen times the packs."""
    monkeypatch.setattr(wd, "PAIR_BUFFER", 100)
    monkeypatch.setattr(wd, "PAIR_GROUP", 400)
    random.seed(3)
    words = "abcdefghijklmnop"
    some = [random.sample(words, 6) for _ in range(60)]
    made = {}
    packed = wd._packed_pairs
    monkeypatch.setattr(wd, "_packed_pairs", lambda code, count, groups, rare=None: packed(code, count, groups, rare).assign(part=0))
    monkeypatch.setattr(wd, "_added_pairs", lambda t: pa.table({"word1": [t.num_rows], "word2": [0], "intersection_count": [0]}))
    for times in (1, 4):
        s = sentences(spark, some * times).coalesce(1)
        coded = s.select(F.transform("words", lambda w: F.ascii(w).cast("long")).alias("ranks"))
        made[times] = wd.pair_counts(coded).first().word1
    assert made[4] < 8 * made[1]


def test_pairs_are_added_up_once_and_named_in_their_group(spark, monkeypatch):
    """Only pairs of two rare words are joined; the others were added up twice, once for each side of a join by rank."""
    monkeypatch.setattr(wd, "BROADCAST_ROWS", 8)
    random.seed(5)
    s = sentences(spark, [random.sample("abcdefghijkéü", random.randint(2, 9)) for _ in range(60)])
    vocabulary = wd.ranked_words(wd.word_counts(s))
    coded = wd.coded_sentences(s, ["id"], vocabulary)
    known = vocabulary.join(wd.pair_members(coded), "rank").select("rank", "word", "members").localCheckpoint()
    plain = rows(wd.jaccard(wd.pair_counts(coded), vocabulary), "word1", "word2")
    rank = {r.word: r["rank"] for r in vocabulary.collect()}
    assert any(rank[r[0]] >= 8 and rank[r[1]] >= 8 for r in plain) and any(rank[r[0]] < 8 for r in plain)
    pairs = wd.pair_counts(coded, known=known)
    assert rows(wd.jaccard(pairs, known), "word1", "word2") == plain
    assert pairs.columns == ["name1", "count1", "name2", "count2", "intersection_count"]
    monkeypatch.setattr(wd, "fits", lambda df: False)
    assert rows(wd.jaccard(wd.pair_counts(coded, known=known), known), "word1", "word2") == plain


def test_shares_are_rounded_as_by_round(spark):
    from parley.plans.words import rounded

    random.seed(6)
    shares = [a / b for b in range(1, 300) for a in range(1, b + 1)] + [(n + 0.5) / 1e6 for n in range(2000)] + [random.random() for _ in range(2000)] + [None, 0.0, 1e-9, 1.0]
    df = spark.createDataFrame([(s,) for s in shares], "s double")
    assert df.filter(~rounded(F.col("s")).eqNullSafe(F.round("s", 6))).count() == 0 and df.select(rounded(F.col("s")).alias("s")).schema == df.schema


def test_jaccard_groups(spark):
    df = spark.createDataFrame([(c,) for c in (0.0, 0.003, 0.0089, 0.009, 0.012)], "jaccard_coefficient double")
    assert [r.g for r in df.select(wd.jaccard_group(F.col("jaccard_coefficient")).alias("g")).collect()] == [0, 1, 2, 3, 4]


def test_isolated_words_fall_away(spark):
    df = spark.createDataFrame([("a", "b", 0.02), ("b", "c", 0.01)], "word1 string, word2 string, jaccard_coefficient double")
    edges, nodes = wd.thresholded(df)
    assert edges.count() == 1 and sorted(r.word for r in nodes.collect()) == ["a", "b"]


def test_joined_texts_in_order(spark):
    df = spark.createDataFrame([(0, 2, "c"), (0, 0, "a"), (0, 1, "")], "k long, o long, t string")
    assert wd.joined_texts(df, ["k"], "o", "t").first().text == "a; ; c"


@pytest.mark.parametrize("limit", [200_000, 1])
def test_pagerank(spark, limit, monkeypatch):
    monkeypatch.setattr(graph.fits, "__defaults__", (limit, 1 << 26))
    edges = [("a", "b", 1.0), ("b", "c", 2.0), ("a", "c", 1.0), ("c", "d", 0.5)]
    got = {r.word: r["rank"] for r in graph.pagerank(spark.createDataFrame(edges, "src string, dst string, weight double"), tolerance=1e-9).collect()}
    both = [(a, b, w) for a, b, w in edges] + [(b, a, w) for a, b, w in edges]
    out = collections.Counter()
    for a, _, w in both:
        out[a] += w
    rank = dict.fromkeys("abcd", 0.25)
    for _ in range(200):
        rank = {n: 0.15 / 4 + 0.85 * sum(rank[a] * w / out[a] for a, b, w in both if b == n) for n in rank}
    assert got == pytest.approx(rank, abs=1e-6)


def test_words_by_class(spark):
    s = sentences(spark, [["x", "y", "x", "z"], ["z"]])
    lexicon = spark.createDataFrame([("x", "noun"), ("y", "verb")], "token string, class string")
    assert rows(wd.words_by_class(s, ["id"], lexicon, ["noun", "verb"])) == [(0, "x x", "y")]


@pytest.mark.parametrize("rows_", [2, 200_000])
def test_cut_sentences_keep_a_sentence_together(spark, monkeypatch, capsys, rows_):
    """Words of the first ranks are not shuffled one by one; rare words are met without repeating the vocabulary."""
    monkeypatch.setattr(wd, "BROADCAST_ROWS", rows_)
    sentences = spark.createDataFrame([(1, 0, ["b", "a", "x"]), (1, 0, ["a", "d"]), (1, 1, ["x"]), (2, 0, ["c", "d", "a"]), (None, 0, ["c"]), (3, 0, [])],
                                      "doc long, pos int, words array<string>")
    vocabulary = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2), ("d", 3)], "word string, rank long")
    cut = wd.cut_sentences(sentences, ["doc", "pos"], vocabulary)
    assert sorted(map(tuple, cut.collect()), key=str) == sorted([(1, 0, ["a", "a", "b", "d"]), (2, 0, ["a", "c", "d"]), (None, 0, ["c"])], key=str)
    tokens = wd.known_rows(sentences.select("doc", "pos", F.explode("words").alias("word")), vocabulary, "word")
    assert sorted(r["rank"] for r in tokens.collect()) == [0, 0, 0, 1, 2, 2, 3, 3]
    capsys.readouterr()
    cut.explain()
    tokens.explain()
    plan = capsys.readouterr().out
    assert "_salt" not in plan and (rows_ == 2 or "Generate explode" not in plan.partition("== Physical Plan ==")[2].partition("== Physical Plan ==")[0])


def test_pagerank_moves_ranks_and_not_edges(spark, monkeypatch):
    """In a graph too large for broadcasts a round shuffles about as many rows as there are nodes, not edges."""
    monkeypatch.setattr(graph, "fits", lambda df: False)
    random.seed(4)
    pairs = random.sample(list(itertools.combinations(range(60), 2)), 1200)
    weight = {p: random.random() + 0.1 for p in pairs}
    edges = spark.createDataFrame([(f"w{a}", f"w{b}", x) for (a, b), x in weight.items()], "src string, dst string, weight double")
    plans = []
    cut = graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    got = {r.word: r["rank"] for r in graph.pagerank(edges, rounds=4, tolerance=0.0, checkpoint_every=2).collect()}
    both = weight | {(b, a): x for (a, b), x in weight.items()}
    out = collections.Counter()
    for (a, _), x in both.items():
        out[a] += x
    rank = {a: 1 / len(out) for a in out}
    for _ in range(4):
        flow = collections.Counter()
        for (a, b), x in both.items():
            flow[b] += rank[a] * x / out[a]
        rank = {a: 0.85 * flow[a] + 0.15 / len(out) for a in out}
    assert got == pytest.approx({f"w{a}": x for a, x in rank.items()})
    # the rounds: the edges come from their place; only ranks (two exchanges: to the edges and to the sums) move
    assert all("InMemoryTableScan" in p and "_salt" not in p for p in plans[3:]) and len(plans) == 7
