"""How the sources of a language differ in their words.

Partitions fold whole documents into stripes: a hash table from a term to the number of documents that hold it and its
count in each source. A task's table spills as rows when it holds ``ENTRIES`` counts and starts anew, so its memory is bounded.
Partial stripes of a term meet by language and term, where at most one per spill and task is left, however common the
term; merged stripes of terms that enough documents hold are kept. Blocks of merged stripes then give the sources' divergences
as matrices: every pair of sources, and each source's most typical terms, without a row per term and pair.

In a group (a language and a source) or a language, a kept term has p = 1 + floor(10^9 (count + 2) / (N + 2 V)), N the
counts of all V kept terms there. The divergence of p and q is floor((p - q)^2 / (p + q)). Everything is whole numbers.

Nulls in text, language and source count as empty texts; empty ones are a language or source of their own. Texts are read
whole. Rows that repeat count each time. Ties are ordered by the item's UTF-8 bytes. A language without kept terms still
has its pairs, with value 0. An empty table gives an empty result. Only the named columns are read, so names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..operators.skew import lookup_join
from ..session import cut_lineage
from .common import bounded_batches, utf8

LEAST = 10  # documents of its language that hold a kept term
BEST = 10  # terms reported per group
SCALE = 1_000_000_000
ENTRIES = 1 << 19  # counts in a task's stripes before they spill
TERM_BYTES = 64 << 20  # bytes of terms in a task's stripes before they spill
BLOCK = 1 << 15  # counts of merged stripes in one block, about
TILE = 128  # sources compared at once
STRIPE = "lang string, term string, df long, sources array<string>, counts array<long>"

#: Every byte that no term holds becomes a blank, A-Z become a-z; bytes of longer characters stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text) -> list[bytes]:
    return utf8(text).translate(_FOLD).split()


class _Stripes:
    """A task's hash stripes: for each term of a language the documents that hold it, and its count in each source.

    They are kept as one counter per language and per source, which only the spill turns into rows, one per term.
    """

    def __init__(self):
        self.holding: dict = {}  # lang -> Counter of documents
        self.counts: dict = {}  # lang -> source -> Counter of words
        self.entries = self.bytes = 0

    def add(self, lang: str, source: str, words: list[bytes]) -> None:
        from collections import Counter

        holding = self.holding.setdefault(lang, Counter())
        count = self.counts.setdefault(lang, {}).setdefault(source, Counter())
        distinct = set(words)
        before = len(holding) + len(count)
        holding.update(distinct)
        count.update(words)
        self.entries += len(holding) + len(count) - before
        self.bytes += sum(map(len, distinct))  # an upper bound: most terms are known already

    @property
    def full(self) -> bool:
        return self.entries >= ENTRIES or self.bytes >= TERM_BYTES

    def spill(self):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for lang, sources in self.counts.items():
            names = pa.array(list(sources), pa.string())
            holding = self.holding[lang]
            terms = pa.array(list(holding), pa.binary())
            df = np.fromiter(holding.values(), np.int64, len(holding))
            row = pc.index_in(pa.concat_arrays([pa.array(list(c), pa.binary()) for c in sources.values()]), terms).to_numpy()
            source = np.repeat(np.arange(len(names)), [len(c) for c in sources.values()])
            count = np.concatenate([np.fromiter(c.values(), np.int64, len(c)) for c in sources.values()])
            order = np.argsort(row, kind="stable")
            source, count = source[order], count[order]
            ends = np.append(0, np.cumsum(np.bincount(row, minlength=len(terms))))
            for at in range(0, len(terms), 1 << 14):
                cut = ends[at:at + (1 << 14) + 1]
                offsets = pa.array(cut - cut[0], pa.int32())
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * (len(cut) - 1), pa.string()), terms[at:at + (1 << 14)].cast(pa.string()), pa.array(df[at:at + (1 << 14)]),
                    pa.ListArray.from_arrays(offsets, names.take(pa.array(source[cut[0]:cut[-1]]))),
                    pa.ListArray.from_arrays(offsets, pa.array(count[cut[0]:cut[-1]]))], ["lang", "term", "df", "sources", "counts"])


def _fold(batches):
    """Stripes of a partition's documents (lang, source, text)."""
    stripes = _Stripes()
    for b in batches:
        for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            stripes.add(lang, source, terms_of(text.as_py()))
            if stripes.full:
                yield from stripes.spill()
                stripes = _Stripes()
    yield from stripes.spill()


def stripes(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Merged stripes (lang, term, stripe) of the terms that at least ``least`` documents of their language hold."""
    bounded_batches(docs.sparkSession)
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    partial = docs.select(text("lang"), text("source"), "text").mapInArrow(_fold, STRIPE)
    # One exchange by term; sources are summed and put back together where the term's stripes lie.
    each = partial.repartition("lang", "term").select("lang", "term", "df", F.posexplode(F.arrays_zip("sources", "counts")).alias("at", "one"))
    summed = (each.groupBy("lang", "term", F.col("one.sources").alias("source"))
              .agg(F.sum("one.counts").alias("count"), F.sum(F.when(F.col("at") == 0, F.col("df"))).alias("df")))
    return (summed.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.collect_list(F.struct("source", "count")).alias("stripe"))
            .filter(F.col("df") >= least).select("lang", "term", "stripe"))


def _share(count, total):
    """p of each count; Python's whole numbers where the product could pass 64 bits."""
    import numpy as np

    if int(count.max(initial=0)) < (1 << 62) // SCALE:
        return 1 + SCALE * (count + 2) // total
    return np.array([1 + SCALE * (int(c) + 2) // int(t) for c, t in zip(count.ravel(), np.broadcast_to(total, count.shape).ravel())],
                    np.int64).reshape(count.shape)


def _apart(p, q):
    return (p - q) ** 2 // (p + q)


def _compared(best: int):
    """Of a block of a language's terms and that language's sources: sums per pair of sources, and each source's best terms."""

    def run(terms, groups):
        import numpy as np
        import pyarrow as pa

        out: dict = {"lang": [], "source": [], "part": [], "item": [], "value": []}
        if terms.num_rows and groups.num_rows:
            lang = groups.column("lang")[0].as_py()
            names = groups.column("source").to_pylist()
            size = (groups.column("words").to_numpy() + 2 * groups.column("kept").to_numpy()).astype(np.int64)
            all_ = int(groups.column("all_words")[0].as_py()) + 2 * int(groups.column("kept")[0].as_py())
            words = terms.column("term").to_pylist()
            at = {s: i for i, s in enumerate(names)}
            stripe = terms.column("stripe").combine_chunks()
            row = np.repeat(np.arange(len(words)), np.diff(stripe.offsets.to_numpy()))
            flat = stripe.flatten()
            col = np.array([at[s] for s in flat.field("source").to_pylist()], np.int64)
            n = flat.field("count").to_numpy().astype(np.int64)
            order = np.lexsort((row, col))
            row, col, n = row[order], col[order], n[order]

            # The best terms: only entries that occur, against the language.
            total = np.zeros(len(words), np.int64)
            np.add.at(total, row, n)
            q = _share(total, np.int64(all_))
            p = _share(n, size[col])
            value = np.where(p > q[row], _apart(p, q[row]), -1)
            cuts = np.searchsorted(col, np.arange(len(names) + 1))
            for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                found = sorted((-int(v), words[r]) for v, r in zip(value[a:b], row[a:b]) if v >= 0)[:best]
                for v, w in found:
                    for c, x in zip(out.values(), (lang, names[s], "term", w, -v)):
                        c.append(x)

            # All pairs of sources, tile by tile: a dense matrix of a tile's p is terms times TILE numbers.
            def dense(start):
                end = min(start + TILE, len(names))
                counts = np.zeros((end - start, len(words)), np.int64)
                a, b = cuts[start], cuts[end]
                counts[col[a:b] - start, row[a:b]] = n[a:b]
                return _share(counts, size[start:end, None])

            for i in range(0, len(names), TILE):
                left = dense(i)
                for j in range(i, len(names), TILE):
                    right = left if i == j else dense(j)
                    for a in range(len(left)):
                        first = a + 1 if i == j else 0
                        sums = _apart(left[a], right[first:]).sum(axis=1)
                        for b, v in enumerate(sums.tolist(), first):
                            for c, x in zip(out.values(), (lang, names[i + a], "pair", names[j + b], v)):
                                c.append(x)
        types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()]
        return pa.table([pa.array(c, t) for c, t in zip(out.values(), types)], names=list(out))

    return run


def divergences(docs: DataFrame, least: int = LEAST, best: int = BEST) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` for each other source, part ``term`` for the ``best`` terms."""
    kept = cut_lineage(stripes(docs, least))
    each = kept.select("lang", "term", F.explode("stripe").alias("one"))
    words = each.groupBy("lang", F.col("one.source").alias("source")).agg(F.sum("one.count").alias("words"))
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    known = docs.select(text("lang"), text("source")).distinct().join(words, ["lang", "source"], "left").fillna(0, ["words"])
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum(F.size("stripe")).alias("entries"))
    per_lang = known.groupBy("lang").agg(F.sum("words").alias("all_words"), F.count(F.lit(1)).alias("n"))
    groups = cut_lineage(known.join(per_lang, "lang").join(langs, "lang", "left").fillna(0, ["kept", "entries"]))

    # A block holds about BLOCK counts: its sources' dense matrices and the merged stripes; sources go to each of the language's blocks.
    sizes = groups.groupBy("lang").agg((F.greatest(F.max("entries"), F.max("kept") * F.least(F.max("n"), F.lit(TILE))) / BLOCK + 1).cast("int").alias("blocks"))
    dealt = lookup_join(kept, sizes, ["lang"], by=["term"]).withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int"))
    copies = groups.filter("kept > 0").join(sizes, "lang").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    found = (dealt.select("lang", "block", "term", "stripe").groupBy("lang", "block")
             .cogroup(copies.select("lang", "block", "source", "words", "all_words", "kept").groupBy("lang", "block"))
             .applyInArrow(_compared(best), "lang string, source string, part string, item string, value long"))
    found = cut_lineage(found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")))

    one = found.filter("part = 'pair'").select("lang", "source", "item", "value")
    both = one.unionByName(one.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    names = groups.select("lang", "source")
    pairs = names.join(names.withColumnRenamed("source", "item"), "lang").filter("source <> item")  # the pairs to report
    pairs = pairs.join(both, ["lang", "source", "item"], "left").fillna(0, ["value"]).withColumn("part", F.lit("pair"))
    out = pairs.unionByName(found.filter("part = 'term'"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    out = out.withColumn("rank", F.row_number().over(order).cast("int"))
    return out.filter((F.col("part") == "pair") | (F.col("rank") <= best)).select("lang", "source", "part", "item", "value", "rank")


SQL = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
df AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(terms)) AS term FROM d) GROUP BY ALL HAVING count(*) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(terms) AS term FROM d) SEMI JOIN df USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*)::HUGEINT AS v FROM df GROUP BY lang),
g AS (SELECT lang, source, coalesce(v, 0) AS v, coalesce(n, 0)::HUGEINT AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN v USING (lang)
  LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL) USING (lang, source)),
p AS (SELECT g.lang, g.source, df.term, coalesce(c.n, 0) AS k, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (g.n + 2 * g.v) AS p
  FROM g JOIN df USING (lang) LEFT JOIN c USING (lang, source, term)),
q AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (sum(n) + 2)::HUGEINT // (any_value(total) + 2 * any_value(v)) AS q FROM c
  JOIN v USING (lang) JOIN (SELECT lang, sum(n)::HUGEINT AS total FROM c GROUP BY lang) USING (lang) GROUP BY lang, term),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value FROM p x JOIN p y
    ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE k > 0 AND p > q)
SELECT lang, source, part, item, value, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)) WHERE part = 'pair' OR rank <= 10
"""
