"""The operators on small tables of odd cases, against plain Python."""

import hashlib
import math
import pickle
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as public
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from parley.llm import audio, bpe, graphs, langid, mixing, nndescent, rounds, scoring, simhash, suffixes, toxicity, warc
from parley.llm.common import remove_folder, shared_folder

PATH, PATTERN = public.path("byte_bpe_50k.tiktoken"), public.PATTERN


def reference(path=PATH):
    coder = bpe.encoder(path, PATTERN)
    return coder, tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=coder.ranks, special_tokens={})


def groups_of(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return [find(i) for i in range(n)]


# op6


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=" ab\n.1é'sT\t漢😀", max_size=60))
def test_leaves_joined_as_one_text(text):
    coder, tik = reference()
    small = bpe.LEAF_CHARS
    try:
        bpe.LEAF_CHARS = 5
        ids = coder.encode(text)
    finally:
        bpe.LEAF_CHARS = small
    assert ids == tik.encode_ordinary(text) and coder.decode(ids) == text.encode()


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="abeinrst", min_size=33, max_size=700))
def test_long_pieces_join_where_tokens_stabilise(text):
    coder, tik = reference()
    assert coder.encode(text) == tik.encode_ordinary(text)


def test_bpe_table(docs, empty, rows):
    out = bpe.decode(bpe.encode(docs, PATH, PATTERN), PATH, PATTERN).collect()
    tik = reference()[1]
    want = Counter((i, tuple(tik.encode_ordinary(t or "")), (t or "").encode()) for i, t in rows)
    assert Counter((r["doc_id"], tuple(r["ids"]), bytes(r["decoded"])) for r in out) == want
    assert bpe.encode(empty, PATH, PATTERN).count() == 0


# op4


def test_audio_round_trip(docs, empty, rows):
    clips = audio.as_clips(docs)
    out = audio.features(clips).collect()
    want = {i: (t or "").encode() for i, t in rows}
    for r in out:
        data = want[r["doc_id"]]
        padded = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(data), len(padded), hashlib.sha256(padded).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(padded[-64:])
    same = {}
    for r in out:
        assert same.setdefault(want[r["doc_id"]], r["feature"]) == r["feature"]
    assert audio.features(audio.as_clips(empty)).count() == 0
    assert audio.samples(None) is None and audio.samples(b"RIFF") is None


def test_resampling_is_a_filter_of_every_output():
    data = bytes(np.random.default_rng(1).integers(0, 256, 70000).astype(np.uint8))
    x = np.concatenate([np.zeros(audio.TAPS // 2), (np.frombuffer(data, np.uint8) - 128.0) / 128, np.zeros(audio.TAPS)])
    phases, out = audio.kernels()[0], audio.resample(data)
    for n in [0, 1, 7, 5000, 13106, 13107, 13108, len(out) - 1]:
        at = n * audio.DOWN // audio.UP
        assert out[n] == pytest.approx(float(x[at:at + audio.TAPS] @ phases[n * audio.DOWN % audio.UP]), abs=1e-4)


def test_tensors_have_one_shape_and_spans_hysteresis():
    import pyarrow as pa

    mel, level = audio.log_mel(audio.resample(bytes(range(256)) * 100))
    table = pa.ipc.open_stream(audio.tensors(mel)).read_all()
    kind = table.schema.field("log_mel").type
    assert list(kind.shape) == [audio.TENSOR, audio.BANDS] and table.num_rows == -(-len(mel) // audio.TENSOR)
    spans = audio.sounding(np.array([-20, -10, -5, -10, -11.5, -13, -10, -5.0]))
    step = audio.HOP / 3200
    assert spans == [pytest.approx((2 * step, 5 * step)), pytest.approx((7 * step, 8 * step))]


# op5


def test_mixing_targets_and_copies(docs, empty, rows):
    out = mixing.curriculum(docs).collect()
    assert len(out) == len(rows)
    total = sum(r["size"] for r in out)
    target = {r["source"]: (r["target"], r["source_size"]) for r in out}
    assert sum(t for t, _ in target.values()) == pytest.approx(total)
    for s, (t, size) in target.items():
        taken = sum(r["taken"] for r in out if r["source"] == s)
        assert abs(taken - t) < 1 and t <= 3 * size + 1e-9
    assert all(r["taken"] <= 3 * r["size"] for r in out)
    places = [r["position"] for r in out if r["position"] is not None]
    assert places == sorted(places) and all(0 <= p <= 1 for p in places)
    assert sorted(map(str, out)) == sorted(map(str, mixing.curriculum(docs.repartition(7)).collect()))
    assert mixing.curriculum(empty).count() == 0 and mixing.mix(empty).count() == 0
    assert mixing.mix(docs).columns == docs.columns


def test_mix_of_rows_that_repeat(spark, tmp_path):
    """Four equal rows of a source that is wanted with 15 words are planned row by row, not as one."""
    text = "a b c d e"
    rows = [(1, "a", text, "x")] * 4 + [(None, "b", text, "y")] * 3 + [(2, "b", text + " f", "z")]
    spark.createDataFrame(rows, "doc_id bigint, source string, text string, _row string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    plan = mixing.curriculum(docs).collect()
    times = {}
    for r in plan:
        times[(r.doc_id, r.size)] = times.get((r.doc_id, r.size), 0) + len(r.copies)
    got = {}
    for r in mixing.mix(docs).collect():
        key = (r.doc_id, len(r.text.split()))
        got[key] = got.get(key, 0) + 1
    assert got == {k: n for k, n in times.items() if n}
    target = {r.source: r.target for r in plan}
    assert sum(len(r.text.split()) for r in mixing.mix(docs).filter("source = 'a'").collect()) - target["a"] < 5


def test_audio_names_that_clash(spark):
    docs = spark.createDataFrame([(1, "some text", "f", [1.0])], "doc_id bigint, text string, feature string, spans array<double>")
    out = audio.features(audio.as_clips(docs))
    assert out.columns == ["doc_id", "text", "feature", "spans", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "tensors", "n_frames", "_spans", "_feature"]
    row = out.first()
    assert row.feature == "f" and row._feature and row.spans == [1.0]


def test_served_share_is_the_integral_of_the_weight(spark):
    knots = (1.5, 1.0, 0.5)
    times = [i / 20 for i in range(21)]
    area = lambda t: 1.5 * t - t * t / 2
    df = spark.createDataFrame([(t, area(t) / area(1)) for t in times], "t double, share double")
    for r in df.select("t", mixing.when_served(F.col("share"), knots).alias("found")).collect():
        assert r["found"] == pytest.approx(r["t"], abs=1e-9)


# op8


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "x" * 1200 + "é</p>\r\n\r\nWARC/1.0\r\n"
    pages = [(1, "http://a.b/c?d#e", "<p>é</p>"), (2, "http://a.b/", big), (3, None, big), (9, "http://x.y", big), (4, "u\n1", None), (5, "", ""),
             (None, "http://n.o/", "<i>"), (6, "http://q/", "y" * 999), (7, "http://q/", "y" * 999), (8, "http://r/", "z" * 1000), (8, "http://r/", "z" * 1000)]
    df = spark.createDataFrame([(*p, 0) for p in pages], "page_id bigint, url string, html string, type int")
    df.repartition(3).write.parquet(str(tmp_path / "pages"))
    df = spark.read.parquet(str(tmp_path / "pages"))
    folder = shared_folder(spark)
    warc.write(df, folder)
    found = warc.resolved(warc.records(spark, folder)).collect()
    assert len(found) == len(pages)
    seen = Counter()
    for r in found:
        meta = bytes(r["metadata"]["payload"]).decode().strip()
        page = int(meta.split(": ")[1]) if meta else None
        payload = bytes((r["original"]["response"] if r["original"] else r["response"])["payload"])
        to = bytes(r["original"]["metadata"]["payload"]).decode().split(": ")[1].strip() if r["original"] else None
        assert r["request"]["http_head"].startswith("GET /")
        seen[page, payload, r["type"], to] += 1
    want = Counter()
    for i, _, html in pages:
        want[i, (html or "").encode(), *(("revisit", "9") if i in (2, 3) else ("response", None))] += 1
    want[8, b"z" * 1000, "response", None] -= 1
    want[8, b"z" * 1000, "revisit", "8"] += 1
    assert seen == +want
    remove_folder(spark, folder)
    folder = shared_folder(spark)
    warc.write(df.limit(0), folder)
    assert warc.resolved(warc.records(spark, folder)).count() == 0


# op2


def plain_print(text, words):
    parts = (text or "").encode().lower().split()
    grams = [b" ".join(parts[i:i + words]) for i in range(len(parts) - words + 1)] or ([b" ".join(parts)] if parts else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_simhash_against_all_pairs(docs, empty, rows):
    for radius in (4, 12):
        out = simhash.near_duplicates(docs, radius=radius).collect()
        prints = [plain_print(t, 4) for _, t in rows]
        pairs = [(i, j) for i in range(len(rows)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= radius]
        group = groups_of(len(rows), pairs)
        least = {}
        for (i, _), g in zip(rows, group):
            if i is not None:
                least[g] = min(i, least.get(g, i))
        want = Counter((i, p, least.get(g)) for (i, _), p, g in zip(rows, prints, group))
        assert Counter((r["id"], r["fp"] % (1 << 64), r["component"]) for r in out) == want
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_keeps_one_of_each_group(docs, empty, rows):
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert {20, 22, 5} <= set(ids) and not {63, 64} & set(ids) and ids.count(67) == 0
    assert simhash.representatives(empty).count() == 0


def test_components_of_a_long_path(spark):
    pairs = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1100)]
    out = {r["node"]: r["component"] for r in graphs.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert all(out[i] == 0 for i in range(201)) and all(out[i] == 1000 for i in range(1000, 1100))
    assert graphs.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# op7


def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((12, 16))
    vectors = [(b + rng.standard_normal(16) * s).tolist() for b in base for s in [0.01] * 15 + [0.15] * 4]
    rows = [(i, v, i % 2) for i, v in enumerate(vectors)]
    rows += [(300 + i, vectors[0], 0) for i in range(20)] + [(400, None, 0), (401, [0.0] * 16, 1), (402, vectors[1], None), (403, [float("nan")] * 16, 1),
             (404, [], 1), (405, vectors[2][:8], 0), (406, [None] * 16, 0), (None, vectors[0], 0), (407, vectors[3], 1), (407, vectors[3], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").repartition(4)
    out = nndescent.near_duplicates(df).collect()
    good = lambda r: r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])
    unit = [np.array(r[1]) / np.linalg.norm(r[1]) if good(r) else None for r in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2]
             and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98]
    n, group = Counter(x for p in pairs for x in p), groups_of(len(rows), pairs)
    least = {}
    for r, g in zip(rows, group):
        if r[0] is not None:
            least[g] = min(r[0], least.get(g, r[0]))
    want = Counter((r[0], n[i], least.get(g)) for i, (r, g) in enumerate(zip(rows, group)))
    assert Counter((r["id"], r["n_links"], r["component"]) for r in out) == want
    assert nndescent.near_duplicates(df.limit(0)).count() == 0


# op10


def plain_repeats(rows, length):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    seen, out = {}, {}
    for k in order:
        b, i = (rows[k][1] or "").encode(), rows[k][0]
        i = math.inf if i is None else i
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen.get(b[p:p + length], math.inf) < i:
                gone[p:p + length] = b"\1" * length
        for p in range(len(b) - length + 1):
            seen.setdefault(b[p:p + length], i)
        out[k] = (rows[k][0], len(b), sum(gone), sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1])),
                  bytes(x for x, g in zip(b, gone) if not g))
    return Counter(out.values())


@pytest.mark.parametrize("length", [16, 50, 120])
def test_repeats_against_all_strings(docs, rows, length, monkeypatch):
    monkeypatch.setattr(rounds, "CHUNK_BYTES", 9000)
    out = suffixes.without_repeats(docs, length).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in out) == plain_repeats(rows, length)
    for r in out:
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"]


def test_repeats_of_random_letters(spark, empty, monkeypatch):
    rng = np.random.default_rng(5)
    pool = ["".join(rng.choice(list("ab"), int(n))) for n in rng.integers(10, 90, 30)]
    rows = [(i, "".join(pool[int(k)] for k in rng.integers(0, 30, int(rng.integers(0, 6))))) for i in range(80)]
    monkeypatch.setattr(rounds, "CHUNK_BYTES", 2000)
    monkeypatch.setattr(suffixes, "SLICE", 64)
    out = suffixes.without_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in out) == plain_repeats(rows, 50)
    assert suffixes.without_repeats(empty).count() == 0


def test_chunks_and_messages_do_not_grow_with_the_square(spark, monkeypatch):
    """A chunk is packed once, not once per scan task; the chunks of a load share their messages."""
    monkeypatch.setattr(rounds, "CHUNK_BYTES", 1000)
    monkeypatch.setattr(rounds, "together", lambda n: 4)
    rng = np.random.default_rng(9)
    made = [(i, None if i % 50 == 7 else "".join(rng.choice(list("abü"), int(rng.integers(0, 200))))) for i in range(300)] + [(300, "long" * 700)]
    docs = spark.createDataFrame(made, "doc_id bigint, text string").repartition(6).cache()
    packs, n = rounds.chunks(docs)
    held = [rounds.Chunk(pa.table({k: [r[k]] for k in ("seq", "data", "extra")})) for r in packs.collect()]
    assert n <= len(held) + 6 <= 2 * n
    assert sorted((k, bytes(c.bytes[a:b]).decode()) for c in held for k, a, b in zip(c.keys, c.starts, c.starts[1:])) == [(i, t or "") for i, t in made]
    assert sorted(len(c.bytes) for c in held)[-2] <= 1000
    loads = packs.select("load").distinct().count()
    assert loads <= n / 4 + 6

    def question(chunk, heard):
        return {"name": np.unique(np.array([0 if i is None else i * 0x9E3779B97F4A7C15 % (1 << 64) for i in chunk.keys], np.uint64)), "n": np.ones(len(set(chunk.keys)), np.int64)}

    first = rounds.ask(packs, n, 0, question, lambda rows, chunk: rows["name"] + np.uint64(1))
    second = rounds.ask(packs, n, 1, question, lambda rows, chunk: rows["name"] + np.uint64(2), first)
    assert second.groupBy("round", "load").count().agg(F.max("count")).first()[0] <= n // 4

    def result(chunk, heard):
        name = question(chunk, heard)["name"]
        return pa.table({"right": pa.array([bool((heard[0] == name + np.uint64(1)).all() and (heard[1] == name + np.uint64(2)).all())])})

    assert [r.right for r in rounds.finish(packs, second, "right boolean", result).collect()] == [True] * len(held)


# op9


def test_scores(docs, empty, rows):
    out = scoring.scored(docs).collect()
    assert len(out) == len(rows)
    train, tokens = Counter(), {}
    for i, t in rows:
        words = (t or "").encode().lower().split() + [None]
        tokens.setdefault(i, []).append(words)
        if zlib.crc32(b"" if i is None else str(i).encode()) % 10:
            train.update(words)
    total, distinct = sum(train.values()), len(train)
    scores = {}
    for r in out:
        words = tokens[r["doc_id"]][0]
        base = sum(math.log10((train[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in words)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(train[w] > 0 for w in words), total)
        assert r["base_score"] == pytest.approx(base) and r["_score"] < 0
        assert scores.setdefault(tuple(words) + (r["doc_id"] == 62,), r["_score"]) == pytest.approx(r["_score"])
    assert scoring.scored(empty).count() == 0


def test_bit_counts_come_from_all_training_texts(spark):
    made = [(i, "the same sentence about the same small matter " * 4) for i in range(60)]
    out = scoring.scored(spark.createDataFrame(made, "doc_id bigint, text string")).collect()
    assert len({r.score for r in out}) == 1 and out[0].bits_per_byte < 1
    model = {}
    packs, _ = rounds.chunks(spark.createDataFrame(made, "doc_id bigint, text string"), None, "doc_id", "text")
    singles, triples, _, _ = scoring.totals(packs, 2, "doc_id", "text")
    model = dict(zip(("codes", "tree"), scoring.trees(singles, triples)))
    tuning, whole = scoring.predictors(packs, 2, model, 2, "doc_id", "text")
    _, other = scoring.predictors(packs, 2, model, 3, "doc_id", "text")
    assert (whole == other).all() and (whole != tuning).any()


def test_first_weights_come_from_all_training_texts(spark, monkeypatch):
    """Not from the sample alone: every training text is scored with the counts of the other half, and all that is learned is averaged."""
    monkeypatch.setattr(scoring, "TUNING", 4)
    monkeypatch.setattr(rounds, "CHUNK_BYTES", 3000)
    rng = np.random.default_rng(6)
    pool = ["river", "stone", "under", "the", "a", "über", "light", "of"]
    made = [(i, " ".join(rng.choice(pool, int(rng.integers(0, 150))))) for i in range(40)]
    df = spark.createDataFrame(made, "doc_id bigint, text string").repartition(3).cache()
    packs, _ = rounds.chunks(df)
    singles, triples, _, _ = scoring.totals(packs, 2, "doc_id", "text")
    model = dict(zip(("codes", "tree"), scoring.trees(singles, triples)))
    apart, _ = scoring.predictors(packs, 2, model, 2, "doc_id", "text")
    model |= {"weights": np.full((scoring.GATES, scoring.CONTEXTS), 0.35), "curve": np.zeros(scoring.LEVELS), "tables": apart[0]}
    weights, curve, total = 0, 0, 0
    for i, text in made:
        if scoring.trained(i):
            data = np.frombuffer(text.encode() + bytes([scoring.END]), np.uint8)
            mixer = scoring.Mixer(model | {"tables": apart[0 if scoring.tuned(i, 2) else 1]})
            mixer.score(data, np.array([0, len(data)]))
            share = len(data) ** 0.5
            weights, curve, total = weights + share * mixer.learned[0][0], curve + share * mixer.learned[1][0], total + share
    scoring.fitted(packs, 2, model, apart, "doc_id", "text")
    assert np.allclose(model["weights"], weights / total, atol=1e-5) and np.allclose(model["curve"], curve / total, atol=1e-5)
    assert {scoring.tuned(i, 2) for i, _ in made if scoring.trained(i)} == {True, False}


def test_long_texts_go_on_where_a_stretch_ends(monkeypatch):
    """A text scored in stretches has the score and the weights it has as a whole; learning does not stop at doubled places."""
    rng = np.random.default_rng(7)
    text = " ".join(rng.choice(["river", "stone", "unter", "a", "x" * 700, "ü"], 900)).encode() + bytes([scoring.END])
    data, bounds = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    model = dict(zip(("codes", "tree"), scoring.trees(rng.integers(0, 50, (256, 256)), {})))
    model |= {"tables": rng.integers(-40, 40, (scoring.CONTEXTS, 1 << scoring.BITS)).astype(np.int8),
              "weights": np.full((scoring.GATES, scoring.CONTEXTS), 0.4), "curve": np.zeros(scoring.LEVELS)}
    whole = scoring.Mixer(model)
    want, hashed = whole.score(data, bounds), scoring.contexts(data, bounds)
    monkeypatch.setattr(scoring, "MEMBERS", 2 * scoring.STRIDE)
    mixer, got, seen = scoring.Mixer(model), 0, []
    for _, _, part, at, lead, _ in scoring.stretches(data, bounds):
        got += mixer.score(part, at, lead)
        seen.append(scoring.contexts(part, at, lead))
    assert len(seen) == -(-len(data) // (2 * scoring.STRIDE)) > 50
    for k in range(2):
        assert (np.concatenate([s[k] for s in seen]) == hashed[k]).all()
    for k in range(scoring.CONTEXTS):
        assert (np.concatenate([s[2][k] for s in seen]) == hashed[2][k]).all()
    assert got == pytest.approx(want, rel=1e-6) and np.allclose(mixer.learned[0], whole.learned[0], atol=1e-4)
    assert whole.phase(np.array([0, 31, 32, 127, 128, 255, 256, 511, 512, 5000]), None).tolist() == [0, 0, 1, 2, 3, 3, 4, 4, 5, 22]


def test_bits_are_a_probability():
    """Over all one-byte texts, the probabilities of the byte sum to one, as each tree's leaves do."""
    counts = np.random.default_rng(2).integers(0, 50, (256, 256))
    codes, tree = scoring.trees(counts, {})
    model = {"codes": codes, "tree": tree, "tables": np.random.default_rng(4).integers(-40, 40, (scoring.CONTEXTS, 1 << scoring.BITS)).astype(np.int8),
             "weights": np.full((scoring.GATES, scoring.CONTEXTS), 0.4), "curve": np.zeros(scoring.LEVELS)}
    mixer = scoring.Mixer(model)
    total = sum(math.exp(mixer.score(np.array([b], np.uint8), np.array([0, 1]))[0]) for b in range(256))
    assert total == pytest.approx(1, abs=1e-5)


# op1


def test_language(docs, empty, rows):
    model = langid.train(docs.filter("doc_id % 5 <> 0"))
    out = langid.predict(docs, model).collect()
    for r in out:
        if not any(c.isalpha() for c in r["text"] or ""):
            assert r["lang_pred"] == "und" and r["_score"] == 0
        else:
            assert r["lang_pred"] in ("en", "de", "fr") and 0 <= r["_score"] <= 1
    assert all(r["lang_pred"] == r["lang"] for r in out if r["doc_id"] is not None and r["doc_id"] < 60)
    none = langid.train(empty)
    assert {r["lang_pred"] for r in langid.predict(docs, none).collect()} == {"und"}
    assert langid.predict(empty, model).count() == 0


# op3


def test_toxicity(spark, docs, empty):
    words = "river stone paper cloud winter garden silver music window bridge".split()
    rows = [(i, " ".join(words[(i * 3 + j) % 10] for j in range(20)) + (" horrible nasty vermin" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, truth int").repartition(3)
    labels = df.filter("doc_id % 3 <> 1").select("doc_id", F.col("truth").alias("toxic")).unionByName(
        spark.createDataFrame([(None, 1), (0, None), (0, 0), (999, 1)], "doc_id bigint, toxic int"))
    model = toxicity.train(df.select("doc_id", "text"), toxicity.labelled(df, labels))
    assert all((r["score"] >= 0.7) == bool(r["truth"]) for r in toxicity.score(df, model).collect())
    assert all(0 <= r["_score"] < 0.7 and r["evidence"] is not None for r in toxicity.score(docs, model).collect())
    none = toxicity.train(df.select("doc_id", "text"), toxicity.labelled(df, labels.limit(0)))
    assert {r["score"] for r in toxicity.score(df, none).collect()} == {0.0}
    assert toxicity.score(empty, model).count() == 0


def test_toxicity_compares_texts_without_words_of_a_label(spark):
    """Toxic texts of a second language share no word that is frequent among toxic ones; only their many rare words are near."""
    words = "river stone paper cloud winter garden silver music window bridge".split()
    rows = [(i, " ".join(words[(i * 3 + j) % 10] for j in range(20)) + (" horrible nasty vermin" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(200)]
    rare = "schlecht boshaft gemein widerlich".split()
    rows += [(300 + i, f"{rare[i % 4]} {words[i % 10]}", 1) for i in range(8)] + [(400 + i, f"{rare[i % 4]} {words[(i + 3) % 10]}", None) for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int").repartition(3)
    model = toxicity.train(df.select("doc_id", "text"), toxicity.labelled(df.select("doc_id", "text"), df.select("doc_id", "toxic")))
    out = {r["doc_id"]: r for r in toxicity.score(df, model).collect()}
    assert all(len(r["evidence"]) == toxicity.NEAREST for r in out.values())
    assert all(out[400 + i]["evidence"][0]["label"] == 1 and out[400 + i]["score"] >= 0.7 for i in range(4))


def test_index_finds_the_exact_nearest():
    rng = np.random.default_rng(6)

    def vector():
        f = np.sort(rng.choice(300, int(rng.integers(1, 12)), replace=False))
        w = rng.random(len(f)) + 0.1
        return f, w / np.linalg.norm(w)

    examples = [vector() for _ in range(700)]
    index = toxicity.Index(examples, [0] * 700, [1.0] * 700)
    dense = np.zeros((700, toxicity.FEATURES + 1))
    for i, (f, w) in enumerate(examples):
        dense[i, f] = w
    for _ in range(50):
        f, w = vector()
        _, found = index.nearest(f, w)
        want = np.sort(dense[:, f] @ w)[::-1][:toxicity.NEAREST]
        assert np.allclose(found, want[want > 0])


def test_index_goes_through_its_rows_once_and_adds_up_few_entries_at_a_time(monkeypatch):
    """Making a row's vector is most of the work of an index; sums of long lists stay in a core's cache."""
    rng = np.random.default_rng(7)
    rows = [(np.sort(rng.choice(5000, 200, replace=False)), np.full(200, 200 ** -0.5)) for _ in range(300)]
    passes, longest = [], []

    class Rows(list):
        def __iter__(self):
            passes.append(1)
            return super().__iter__()

    index = toxicity.Index(Rows(rows), [0] * 300, [1.0] * 300, np.bincount(np.concatenate([f for f, _ in rows]), minlength=toxicity.FEATURES))
    assert len(passes) == 1
    monkeypatch.setattr(toxicity, "ENTRIES", 64)
    count = np.bincount
    monkeypatch.setattr(np, "bincount", lambda x, *a, **k: longest.append(len(x)) or count(x, *a, **k))
    dense = np.zeros((300, 5000))
    for i, (f, w) in enumerate(rows):
        dense[i, f] = w
    for f, w in rows[:20]:
        _, found = index.nearest(f, w)
        assert np.allclose(found, np.sort(dense[:, f] @ w)[::-1][:toxicity.NEAREST])
    assert len(longest) > 20 and max(longest) <= 64 + 300


def test_decisions_are_looked_up_without_a_change_of_type():
    texts = [b"", b"a", "größe über".encode(), b"the cat sat on the mat " * 30]
    data = np.frombuffer(b"".join(t + bytes([scoring.END]) for t in texts), np.uint8)
    bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
    model = dict(zip(("codes", "tree"), scoring.trees(np.ones((256, 256), np.int64), {})))
    byte, depth, _, _, _, _, length = scoring.decisions(data, bounds, model)
    assert byte.dtype == np.intp
    assert (byte == np.repeat(np.arange(len(data)), length)).all()
    assert (depth == np.concatenate([np.arange(n) for n in length])).all()


def test_workers_of_an_executor_share_the_memory_of_the_examples(tmp_path, monkeypatch):
    """An index in each worker, idle ones included, took the memory of an executor."""
    monkeypatch.setenv("SPARK_LOCAL_DIRS", str(tmp_path))
    rng = np.random.default_rng(8)
    rows = [(np.sort(rng.choice(3000, 150, replace=False)), rng.integers(1, 9, 150)) for _ in range(400)]
    scale = rng.random(toxicity.FEATURES) + 0.5
    part = toxicity.parts([toxicity.packed(*r) for r in rows], np.bincount(np.concatenate([f for f, _ in rows]), minlength=toxicity.FEATURES))
    seen = np.array([np.bincount(np.concatenate([f for (f, _), k in zip(rows, part) if k == p] or [[]]).astype(int), minlength=toxicity.FEATURES) for p in range(part.max() + 1)])
    sent = pickle.dumps(toxicity.Examples(toxicity.bundled([toxicity.packed(*r) for r in rows]), [0] * 400, [1.0] * 400, [0] * 400, scale, seen, part, 8))
    first, second = pickle.loads(sent), pickle.loads(sent)
    made = toxicity.Index.__init__
    assert first.index.owner.size and not first.index.owner.flags.owndata and first.parts is None
    monkeypatch.setattr(toxicity.Index, "__init__", lambda *a: 1 / 0)
    dense = np.zeros((400, toxicity.FEATURES))
    for i, (f, n) in enumerate(rows):
        dense[i, f] = toxicity.vector(f, n, scale)[1]
    for f, n in rows[:30]:
        f, w = toxicity.vector(f, n, scale)
        for index in (first.index, second.index):
            place, found = index.nearest(f, w)
            assert np.allclose(found, np.sort(dense[:, f] @ w)[::-1][:toxicity.NEAREST], atol=1e-12)
    monkeypatch.setattr(toxicity.Index, "__init__", made)
