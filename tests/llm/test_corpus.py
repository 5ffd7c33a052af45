"""The manifest, the divergence audit and the benchmark search against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from parley.llm import contamination, divergence, merkle

DOCS = "doc_id bigint, source string, lang string, n_chars bigint, text string, leaf int, extra string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


# --- manifest -----------------------------------------------------------------------------------------------------

def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]))


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i:i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def steps_of(levels, at):
    out = []
    for level in levels[:-1]:
        run = level[at // 16 * 16:at // 16 * 16 + 16]
        out.append(("".join(run[:at % 16]), "".join(run[at % 16 + 1:])))
        at //= 16
    return out


def plain_manifest(rows):
    trees = defaultdict(list)
    for r in rows:
        trees[(r[1] is not None, (r[1] or "").encode())].append(r)
    order = sorted(trees)
    for k in order:
        trees[k].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
    low = {k: levels_of([leaf_of(r) for r in trees[k]]) for k in order}
    high = levels_of([low[k][-1][0] for k in order])
    out = []
    for i, k in enumerate(order):
        for at, r in enumerate(trees[k]):
            steps = steps_of(low[k], at) + steps_of(high, i)
            out.append((r[0], leaf_of(r), low[k][-1][0], high[-1][0], tuple(steps)))
    return out


def dataset(n, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        source = r.choice(["hot"] * 40 + ["a", "b", "é", "", None] + [f"s{j}" for j in range(18)])
        rows.append((r.choice([i, i, i, None]) if i % 50 == 0 else i, source, r.choice(["en", None]), r.choice([None, i]),
                     r.choice([None, "", "Aé " * (i % 7), "Text %d" % i]), 1, "x"))
    return rows + rows[:3] + [(n + 1, "alone", "en", 1, "L" * 70_000, 1, "x")]


@pytest.mark.parametrize("n", [0, 1, 17, 700])
def test_manifest(spark, n):
    rows = dataset(n) if n > 1 else [(5, "a", "en", 2, "Hi", 1, "x")][:n]
    if n == 17:
        rows = [(i, "a", "en", 2, "Hi", 1, "x") for i in range(17)]  # two runs, one of them of a single leaf
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    found = merkle.manifest(df).withColumns({"back": merkle.folded(F.col("leaf"), F.col("proof")), "digest": merkle.proof_digest(F.col("proof"))}).collect()
    key = lambda x: tuple(map(str, x))
    got = sorted([(r.doc_id, r.leaf, r.subroot, r.root, tuple((s.left, s.right) for s in r.proof)) for r in found], key=key)
    assert got == sorted(plain_manifest(rows), key=key)
    assert all(r.back == r.root for r in found)
    assert all(r.digest == sha("".join(s.left + s.right for s in r.proof)) for r in found)


def test_changed_text_does_not_verify(spark):
    rows = dataset(60)
    df = spark.createDataFrame(rows, DOCS)
    changed = merkle.leaf_of([F.col(c) for c in merkle.COLUMNS[:-1]] + [merkle.lower_ascii(F.col("text"))])
    found = merkle.manifest(df, carry={"changed": changed})
    texts = {leaf_of(r): r[4] for r in rows}
    for r in found.withColumn("ok", merkle.folded(F.col("changed"), F.col("proof")) == F.col("root")).collect():
        assert r.ok == (texts[r.leaf] is None or lower(texts[r.leaf]) == texts[r.leaf])


# --- divergence -----------------------------------------------------------------------------------------------------

def plain_divergence(rows, least, best):
    docs = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lower(text or ""))) for lang, source, text in rows]
    df = Counter((lang, t) for lang, _, ts in docs for t in set(ts))
    out = []
    for lang in {d[0] for d in docs}:
        kept = sorted(t for (x, t), n in df.items() if x == lang and n >= least)
        groups = {s: Counter() for x, s, _ in docs if x == lang}
        for x, s, ts in docs:
            if x == lang:
                groups[s].update(t for t in ts if df[(lang, t)] >= least)
        whole = sum(groups.values(), Counter())

        def share(c):
            n = sum(c.values())
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        p, q = {s: share(c) for s, c in groups.items()}, share(whole)
        apart = lambda a, b: (a - b) ** 2 // (a + b)
        for s in groups:
            pair = [(o, sum(apart(p[s][t], p[o][t]) for t in kept)) for o in groups if o != s]
            term = [(t, apart(p[s][t], q[t])) for t in kept if groups[s][t] > 0 and p[s][t] > q[t]]
            for part, items, most in (("pair", pair, None), ("term", term, best)):
                for rank, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                    out.append((lang, s, part, item, value, rank))
    return sorted(out)


def corpus(n=300, seed=2):
    r = random.Random(seed)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)] + ["É", "naïve", "Ünder"]
    rows = []
    for i in range(n):
        s = r.choice([None, "", "a", "b", "c", "é"])
        words = [r.choice(vocabulary[:30 + 15 * (len(s or "") + ord((s or "a")[0]) % 3)]) for _ in range(r.randrange(40))]
        rows.append((r.choice(["en", "en", "de", None]), s, r.choice([" ", "-", "1"]).join(w.upper() if r.random() < 0.2 else w for w in words)))
    return rows + [("fr", "a", None), ("fr", "b", "one two"), ("xx", "only", "one"), ("en", "a", "long " * 40_000 + "x" * 100_000)] + rows[:5]


@pytest.mark.parametrize("small", [False, True])
def test_divergences(spark, small, monkeypatch):
    if small:  # many spills, blocks and tiles
        for name, value in (("ENTRIES", 50), ("BLOCK", 200), ("TILE", 2)):
            monkeypatch.setattr(divergence, name, value)
    rows = corpus()
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "lang string, source string, text string, term int, rank string").repartition(3)
    got = sorted(map(tuple, divergence.divergences(df, least=3, best=4).collect()))
    assert got == plain_divergence(rows, 3, 4)


def test_divergence_of_nothing(spark):
    assert divergence.divergences(spark.createDataFrame([], "lang string, source string, text string")).count() == 0


def test_large_counts_stay_exact():
    import numpy as np

    big = np.array([[1 << 40, 3]], np.int64)
    assert divergence._share(big, np.array([[1 << 41]], np.int64)).tolist() == [[1 + 10**9 * ((1 << 40) + 2) // (1 << 41), 1 + 10**9 * 5 // (1 << 41)]]


# --- benchmark ------------------------------------------------------------------------------------------------------

def plain_matches(docs, items, window=10):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t or ""))
    held = [(i, words(t)) for i, t in items]
    out = []
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for item, x in held:
            k = min(window, len(x))
            grams = {tuple(x[j:j + k]) for j in range(len(x) - k + 1)} if k else set()
            for j in range(len(w) - k + 1) if k else ():
                if tuple(w[j:j + k]) in grams:
                    hit.update(range(j, j + k))
                    found.add(item)
        out.append((d, len(w), len(hit), tuple(sorted(str(f) for f in found if f is not None))))
    return sorted(out, key=str)


def texts(seed=3):
    r = random.Random(seed)
    say = lambda n: " ".join(r.choice(["of", "the", "Tea", "cup", "é1", "x9", "an"]) for _ in range(n))
    items = [(i, say(r.choice([12, 25, 40]))) for i in range(30)] + [(100, None), (101, " ,, "), (102, "three Words only"), (103, "one1"), (None, say(15)), (5, say(14))]
    items += [(104, items[3][1]), (105, say(8000))]
    docs = []
    for i in range(80):
        body = say(r.randrange(200))
        if i % 3 == 0:
            cut = items[r.randrange(30)][1].split()
            at = r.randrange(len(cut))
            body = body + " -- " + ", ".join(w.upper() for w in cut[max(0, at - 14):at]) + "\n" + say(5)
        docs.append((i, body))
    docs += [(200, None), (201, ""), (202, "a THREE words-only b one1"), (203, say(60_000) + " " + items[7][1]), (204, items[37][1]), (7, docs[7][1]), (None, items[34][1])]
    return docs, items


@pytest.mark.parametrize("blocks", [1, 5])
def test_benchmark_passages(spark, blocks, monkeypatch):
    docs, items = texts()
    if blocks > 1:
        monkeypatch.setattr(contamination, "PIECE_WORDS", 50)
    df = spark.createDataFrame([(*d, 1, "q") for d in docs], "doc_id bigint, text string, hits int, _hits string").repartition(3)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = contamination.matches(df, bench, block_bytes=(1 << 20) if blocks == 1 else 12_000)
    assert found.columns == ["doc_id", "text", "hits", "_hits", "__hits", "items", "n_words"]
    got = sorted([(r.doc_id, r.n_words, sum(s["stop"] - s["start"] for s in r["__hits"]), tuple(r["items"])) for r in found.collect()], key=str)
    assert got == plain_matches(docs, items)


def test_benchmark_or_documents_empty(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert [tuple(r) for r in contamination.matches(docs, none).collect()] == [(1, "a b c", [], [], 3)]
    some = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert contamination.matches(docs.limit(0), some).count() == 0


def test_crc_of_the_query_is_zlibs():
    import duckdb

    ids = [0, 7, 10, 123456789, 256409]
    got = duckdb.sql(f"SELECT {merkle.CRC32} FROM (SELECT unnest({ids}) AS doc_id)").fetchall()
    assert [g[0] for g in got] == [zlib.crc32(str(i).encode()) for i in ids]
