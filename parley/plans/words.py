"""Word and graph queries over the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import texts
from ..operators import graph, words as wd
from ..session import cut_lineage
from . import views as v
from .registry import query
from .views import with_views

KEYS = ["doc_id", "pos"]
SPECTRUM_ROW = 3  # the rarest four counts are cut, as the word network asks for words seen often enough

COUNTS = """cnt AS (SELECT word, count(*) AS n FROM (SELECT unnest(words) AS word FROM sent) GROUP BY word),
spec AS (SELECT n AS count, count(*) AS n_word, (sum(count(*)) OVER (ORDER BY n))::BIGINT AS cumsum,
  sum(count(*)) OVER (ORDER BY n) / (SELECT count(*) FROM cnt) AS cumsum_rate FROM cnt GROUP BY n)"""
VOCAB = f"""size AS (SELECT coalesce((SELECT trunc((SELECT count(*) FROM cnt) * (1 - cumsum_rate)) FROM spec ORDER BY count LIMIT 1 OFFSET {SPECTRUM_ROW}), 1) AS n),
ranked AS (SELECT word, n AS count, row_number() OVER (ORDER BY n DESC, word) - 1 AS rank FROM cnt),
vocab AS (SELECT * FROM ranked WHERE rank < (SELECT n FROM size))"""
CUT = """cut AS (SELECT doc_id, pos, list(s.word ORDER BY s.word) AS words FROM (SELECT doc_id, pos, unnest(words) AS word FROM sent) s
  JOIN vocab USING (word) GROUP BY ALL)"""
PAIRS = """tok AS (SELECT doc_id, pos, unnest(words) AS w FROM sent),
pairs AS (SELECT a.w AS word1, b.w AS word2, count(*) AS intersection_count FROM tok a JOIN tok b
  ON a.doc_id = b.doc_id AND a.pos = b.pos AND a.w < b.w GROUP BY ALL),
member AS (SELECT word, sum(c)::BIGINT AS count FROM (SELECT word1 AS word, intersection_count AS c FROM pairs
  UNION ALL SELECT word2, intersection_count FROM pairs) GROUP BY word),
jac AS (SELECT p.*, a.count AS count1, b.count AS count2, a.count + b.count - intersection_count AS union_count,
  intersection_count / (a.count + b.count - intersection_count) AS jaccard_coefficient
  FROM pairs p JOIN member a ON a.word = word1 JOIN member b ON b.word = word2)"""
GROUP = "CASE WHEN jaccard_coefficient < 0.003 THEN 0 WHEN jaccard_coefficient < 0.006 THEN 1 WHEN jaccard_coefficient < 0.009 THEN 2 WHEN jaccard_coefficient < 0.012 THEN 3 ELSE 4 END"
BASE = (v.SENT, PAIRS)


def _counts(spark, folder):
    return wd.word_counts(v.sent(spark, folder))


def _words(spark, folder):
    """The sentences' words, split once and kept as one text, and how many sentences hold each word."""
    sent = cut_lineage(v.sent(spark, folder).withColumn("words", F.array_join("words", " ")))
    sent = sent.withColumn("words", F.split("words", " "))
    return sent, cut_lineage(wd.word_counts(sent))


def _vocabulary(counts):
    """The reported vocabulary: the rarest counts are cut."""
    size = wd.vocabulary_size(wd.count_spectrum(counts), SPECTRUM_ROW)
    return cut_lineage(wd.ranked_words(counts, size))


def _pairs(spark, folder):
    """All pairs of words of a sentence; no word is cut."""
    sent, counts = _words(spark, folder)
    codes = cut_lineage(wd.ranked_words(counts))
    coded = cut_lineage(wd.coded_sentences(sent, KEYS, codes).select(F.col("ranks").cast("array<int>").alias("ranks")))
    known = cut_lineage(codes.join(wd.pair_members(coded), "rank").select("rank", "word", "members"))
    return wd.jaccard(wd.pair_counts(coded, known=known), known)


@query(with_views(v.SENT, COUNTS) + "SELECT word, n AS count FROM cnt")
def word_counts(spark, folder):
    return _counts(spark, folder)


@query(with_views(v.SENT, COUNTS) + "SELECT word, n AS count FROM cnt ORDER BY n DESC, word LIMIT 30")
def top_words(spark, folder):
    return wd.top_words(_counts(spark, folder), 30)


@query(with_views(v.SENT, COUNTS) + "SELECT count, n_word, cumsum, round(cumsum_rate, 6) AS cumsum_rate FROM spec")
def count_spectrum(spark, folder):
    counts = cut_lineage(_counts(spark, folder))
    return wd.count_spectrum(counts).withColumn("cumsum_rate", F.round("cumsum_rate", 6))


@query(with_views(v.SENT, COUNTS, VOCAB) + "SELECT word, count, rank FROM vocab")
def vocabulary(spark, folder):
    return _vocabulary(_words(spark, folder)[1])


@query(with_views(v.SENT, COUNTS, VOCAB) + "SELECT doc_id, pos, rank FROM (SELECT doc_id, pos, unnest(words) AS word FROM sent) JOIN vocab USING (word)")
def bag_of_words(spark, folder):
    sent, counts = _words(spark, folder)
    return wd.bag_of_words(sent, KEYS, _vocabulary(counts))


@query(with_views(v.SENT, COUNTS, VOCAB) + "SELECT doc_id, pos, rank FROM (SELECT doc_id, pos, unnest(words) AS word FROM sent) JOIN vocab USING (word) WHERE rank > 0")
def bag_of_words_without_top(spark, folder):
    sent, counts = _words(spark, folder)
    return wd.bag_of_words(sent, KEYS, _vocabulary(counts).filter("rank > 0"))


@query(with_views(v.SENT, COUNTS, VOCAB, CUT) + "SELECT doc_id, pos, array_to_string(words, ',') AS line FROM cut")
def cut_sentences(spark, folder):
    sent, counts = _words(spark, folder)
    cut = wd.cut_sentences(sent, KEYS, _vocabulary(counts))
    return cut.select(*KEYS, F.array_join("words", ",").alias("line"))


@query(with_views(*BASE) + """SELECT word1, word2, intersection_count, count1, count2, union_count,
  round(jaccard_coefficient, 6) AS jaccard_coefficient FROM jac""")
def co_occurrence(spark, folder):
    return _pairs(spark, folder).withColumn("jaccard_coefficient", rounded(F.col("jaccard_coefficient")))


def rounded(share):
    """``F.round`` to six places of a number from 0 to 1; only near the middle between two of them does it take the slow exact way."""
    whole = F.rint(share * 1e6)
    return F.when(F.abs(share * 1e6 - whole) < 0.499999, whole / 1e6).otherwise(F.round(share, 6))


@query(with_views(*BASE) + f"SELECT {GROUP} AS group_number, count(*) AS pairs FROM jac GROUP BY ALL")
def jaccard_groups(spark, folder):
    return wd.group_sizes(_pairs(spark, folder))


@query(with_views(*BASE) + f"""SELECT word1, word2, round(jaccard_coefficient, 6) AS jaccard_coefficient FROM jac WHERE {GROUP} = 4
  ORDER BY jac.jaccard_coefficient DESC, word1, word2 LIMIT 10""")
def closest_pairs(spark, folder):
    top = wd.closest_pairs(_pairs(spark, folder))
    return top.select("word1", "word2", F.round("jaccard_coefficient", 6).alias("jaccard_coefficient"))


@query(with_views(*BASE) + "SELECT DISTINCT unnest([word1, word2]) AS word FROM jac WHERE jaccard_coefficient > 0.01")
def network_nodes(spark, folder):
    return wd.thresholded(_pairs(spark, folder))[1]


RANK = """edge AS (SELECT word1 AS src, word2 AS dst, jaccard_coefficient AS weight FROM jac WHERE jaccard_coefficient > 0.01
  UNION ALL SELECT word2, word1, jaccard_coefficient FROM jac WHERE jaccard_coefficient > 0.01),
flow AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS share FROM edge),
node AS (SELECT DISTINCT src AS word FROM edge), num AS (SELECT count(*) AS n FROM node),
pr AS (SELECT word, 1.0::DOUBLE / n AS rank, 0 AS round FROM node, num UNION ALL
  SELECT f.dst, 0.85 * sum(pr.rank * f.share) + 0.15 / any_value(num.n), any_value(pr.round) + 1 FROM pr JOIN flow f ON f.src = pr.word, num
  WHERE pr.round < 20 GROUP BY f.dst)"""


@query(with_views(*BASE, RANK, recursive=True) + "SELECT word, round(rank, 8) AS rank FROM pr WHERE round = 20")
def word_pagerank(spark, folder):
    edges, _ = wd.thresholded(_pairs(spark, folder))
    ranks = graph.pagerank(edges, rounds=20, tolerance=0.0, checkpoint_every=10)
    return ranks.withColumn("rank", F.round("rank", 8))


@query(with_views(v.SENT) + """SELECT doc_id, pos, length(sentence) AS n_chars FROM sentences""")
def sentence_split(spark, folder):
    return v.sentences(spark, folder).select("doc_id", "pos", F.length("sentence").cast("long").alias("n_chars"))


STOP = ["the", "of", "de", "la", "und", "der", "el", "le"]


@query(with_views(v.SENT) + f"""SELECT doc_id, pos, array_to_string([w FOR w IN words IF w NOT IN ({", ".join(f"'{w}'" for w in STOP)})], ' ') AS kept FROM
  (SELECT doc_id, pos, regexp_extract_all(lower(sentence), '[a-zà-ÿ]+') AS words FROM sentences)""")
def stop_words(spark, folder):
    s = v.sentences(spark, folder)
    return s.select("doc_id", "pos", F.array_join(texts.kept_words(texts.words(F.col("sentence")), STOP), " ").alias("kept"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(lower(nfc_normalize(replace(text, chr(10), ''))), '[!-/:-@\[-`{-~]', '', 'g'), '\p{Nd}+\.*\p{Nd}*', '0', 'g') AS normal
  FROM documents""")
def normalised_text(spark, folder):
    return v.table(spark, folder, "documents").select("doc_id", texts.normalised(F.col("text")).alias("normal"))


LEXICON = """lex AS (SELECT DISTINCT token, ['noun', 'adjective', 'verb'][length(token) % 3 + 1] AS class FROM (
  SELECT unnest(regexp_extract_all(lower(text), '[a-zà-ÿ]+')) AS token FROM benchmark))"""


@query(with_views(LEXICON) + """, t AS (SELECT conv_id, turn, unnest(range(len(w))) AS i, unnest(w) AS token FROM (
  SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-zà-ÿ]+') AS w FROM conversations))
SELECT conv_id, turn, coalesce(string_agg(token, ' ' ORDER BY i) FILTER (class = 'noun'), '') AS noun,
  coalesce(string_agg(token, ' ' ORDER BY i) FILTER (class = 'adjective'), '') AS adjective,
  coalesce(string_agg(token, ' ' ORDER BY i) FILTER (class = 'verb'), '') AS verb FROM t JOIN lex USING (token) GROUP BY ALL""")
def words_by_class(spark, folder):
    classes = ["noun", "adjective", "verb"]
    tokens = v.table(spark, folder, "benchmark").select(F.explode(texts.words(F.col("text"))).alias("token")).distinct()
    kind = F.element_at(F.array(*[F.lit(c) for c in classes]), (F.length("token") % 3 + 1).cast("int"))
    c = v.table(spark, folder, "conversations").select("conv_id", "turn", texts.words(F.col("text")).alias("words"))
    return wd.words_by_class(c, ["conv_id", "turn"], tokens.withColumn("class", kind), classes)


@query("""SELECT p_partkey AS part, list_sum([d::BIGINT FOR d IN regexp_extract_all(p_name || '#' || p_partkey, '[0-9]+')])::BIGINT AS total,
  p_partkey % 7 + p_partkey % 5 AS tuple_sum FROM part""")
def parsed_numbers(spark, folder):
    p = v.table(spark, folder, "part")
    name = F.concat("p_name", F.lit("#"), F.col("p_partkey").cast("string"))
    pair = F.format_string("(%d, %d)", F.col("p_partkey") % 7, F.col("p_partkey") % 5)
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    return p.select(F.col("p_partkey").alias("part"), total(texts.numbers_of(name)).alias("total"),
                    total(texts.int_tuple(pair)).alias("tuple_sum"))


@query("""SELECT doc_id, label, n FROM (SELECT d.doc_id, l.label, count(*) AS n FROM documents d JOIN (
  SELECT DISTINCT lang AS label FROM documents) l ON l.label <> d.lang GROUP BY ALL)""")
def missing_labels(spark, folder):
    from ..operators.sets import missing

    d = v.table(spark, folder, "documents")
    d = d.select("doc_id", F.col("lang").alias("label"))
    return missing(d, ["doc_id"], "label", d.filter(F.col("label").isNotNull())).withColumn("n", F.lit(1).cast("long"))
