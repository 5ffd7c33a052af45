"""Agreement and error scores."""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.permute import drawn, permuted
from ..functions.vectors import bind
from ..session import cut_lineage
from .ranks import ranked
from .series import along, differs
from .skew import salted_join


def classification_report(df: DataFrame, truth: str, pred: str, keys: list[str] | None = None) -> DataFrame:
    """Confusion matrix, accuracy, precision and recall of 0/1 labels."""
    hit = lambda t, p: F.sum(F.when((F.col(truth) == t) & (F.col(pred) == p), 1).otherwise(0))
    c = df.groupBy(*(keys or [])).agg(hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), hit(0, 0).alias("tn"))
    tp, fp, fn, tn = (F.col(n) for n in ("tp", "fp", "fn", "tn"))
    return c.withColumns({"accuracy": F.try_divide(tp + tn, tp + fp + fn + tn),
                          "precision": F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)),
                          "recall": F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))})


FEW_LABELS = 5  # labels whose renamings are all tried


@functools.cache
def _choices(n: int, m: int) -> np.ndarray:
    """All ways to give n rows different ones of m columns."""
    return np.array(list(itertools.permutations(range(m), n)))


def best_assignment(gain: np.ndarray) -> float:
    """Highest total of a one-to-one assignment of rows to columns (shortest augmenting paths with potentials)."""
    if gain.shape[0] > gain.shape[1]:
        gain = gain.T
    if gain.shape[1] <= FEW_LABELS:  # as with a few speakers, where a loop in Python would take most of the time
        return float(gain[np.arange(gain.shape[0]), _choices(*gain.shape)].sum(axis=1).max())
    cost = gain.max() - gain
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    row_of = np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        row_of[0], j0 = i, 0
        least, back, done = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=bool)
        while row_of[j0]:
            done[j0] = True
            i0 = row_of[j0]
            reduced = cost[i0 - 1] - u[i0] - v[1:]
            better = ~done[1:] & (reduced < least[1:])
            least[1:][better], back[1:][better] = reduced[better], j0
            j1 = int(np.where(done, np.inf, least).argmin())
            delta = least[j1]
            u[row_of[done]] += delta
            v[done] -= delta
            least[~done] -= delta
            j0 = j1
        while j0:
            row_of[j0] = row_of[back[j0]]
            j0 = back[j0]
    pairs = [(row_of[j] - 1, j - 1) for j in range(1, m + 1) if row_of[j]]
    return float(sum(gain[i, j] for i, j in pairs))


def sequence_match(df: DataFrame, keys: list[str], label1: str, label2: str) -> DataFrame:
    """Share of positions that agree under the best one-to-one renaming of the labels.

    Spark counts the label pairs; only the small count matrix of a key is assigned in Python. Positions where one side
    is missing mean sequences of unequal length, which is an error.
    """
    counts = df.groupBy(*keys, label1, label2).agg(F.count(F.lit(1)).alias("_n"))
    # Few bytes but much work per key: a fixed number of partitions is not put together into one task.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = counts.repartition(tasks, *keys).groupBy(*keys).agg(
        F.collect_list(F.struct(F.col(label1).alias("a"), F.col(label2).alias("b"), F.col("_n").alias("n"))).alias("_c"), F.sum("_n").alias("length"))

    @F.pandas_udf("double")
    def matched(first: pd.Series, second: pd.Series, n: pd.Series) -> pd.Series:
        best = []
        for a, b, c in zip(first, second, n):
            if pd.isna(a).any() or pd.isna(b).any():
                raise ValueError("every row needs a label of either sequence")
            rows, i = np.unique(a, return_inverse=True)
            columns, j = np.unique(b, return_inverse=True)
            matrix = np.zeros((len(rows), len(columns)))
            np.add.at(matrix, (i, j), c)
            best.append(best_assignment(matrix))
        return pd.Series(best, dtype=float)

    part = lambda f: F.transform("_c", lambda x: x[f])
    return cells.select(*keys, (matched(part("a"), part("b"), part("n")) / F.col("length")).alias("accuracy"), "length")


def aligned(first: DataFrame, second: DataFrame, keys: list[str], pos: str, label: str) -> DataFrame:
    """Two labelled sequences side by side by position; ``sequence_match`` refuses positions that one side lacks."""
    a = first.select(*keys, pos, F.col(label).alias("label1"))
    b = second.select(*keys, pos, F.col(label).alias("label2"))
    return a.join(b, [*keys, pos], "full")


def transition_bias(df: DataFrame, keys: list[str], pos: str, label: str) -> DataFrame:
    """(label changes + 1) / length of each sequence."""
    seen = along(df.select(*keys, pos, label), keys, [pos], lag={"_was": F.struct(label)})
    change = F.when(F.col("_was").isNotNull() & differs(F.col("_was")[label], F.col(label)), 1).otherwise(0)
    return seen.groupBy(*keys).agg(((F.sum(change) + 1) / F.count(F.lit(1))).alias("bias"), F.count(F.lit(1)).alias("length"))


def merged_bias(biases: DataFrame) -> DataFrame:
    """Biases of several fits merged, each weighted by its length."""
    return biases.agg((F.sum(F.col("bias") * F.col("length")) / F.sum("length")).alias("bias"), F.sum("length").alias("length"))


def equal_error_rate(df: DataFrame, keys: list[str], truth: str, score: str) -> DataFrame:
    """Rate at which false accepts equal false rejects on the interpolated ROC curve, and its threshold.

    Equal scores are counted first, so the curve has one point per distinct score and is swept in chunks.
    """
    points = df.groupBy(*keys, (-F.col(score)).alias("_s")).agg(F.sum(truth).alias("_p"), F.sum(1 - F.col(truth)).alias("_q"))
    sizes = df.groupBy(*keys).agg(F.sum(truth).alias("_pos"), F.sum(1 - F.col(truth)).alias("_neg"))
    curve = along(points, keys, ["_s"], total={"_tp": F.col("_p"), "_fp": F.col("_q")})
    rates = salted_join(curve, sizes, keys).select(
        *keys, "_s", (F.col("_tp") / F.col("_pos")).alias("tpr"), (F.col("_fp") / F.col("_neg")).alias("fpr"),
        ((F.col("_tp") - F.col("_p")) / F.col("_pos")).alias("tpr0"), ((F.col("_fp") - F.col("_q")) / F.col("_neg")).alias("fpr0"))
    gap0, gap1 = 1 - F.col("fpr0") - F.col("tpr0"), 1 - F.col("fpr") - F.col("tpr")
    part = gap0 / (gap0 - gap1)
    before = along(rates, keys, ["_s"], lag={"_s0": F.col("_s")})
    crossing = before.filter((gap0 > 0) & (gap1 <= 0))
    threshold = -(F.coalesce("_s0", "_s") + part * (F.col("_s") - F.coalesce("_s0", "_s")))
    return crossing.select(*keys, (F.col("fpr0") + part * (F.col("fpr") - F.col("fpr0"))).alias("eer"), threshold.alias("threshold"))


# --- transcripts ------------------------------------------------------------------------------------------------

KEPT_ROWS = 512  # distance rows kept between two stored ones


def _distance_rows(first: np.ndarray, a: np.ndarray, t: np.ndarray, start: int) -> np.ndarray:
    """``first`` (row ``start``) and the rows of the words ``a`` after it; insertions are a running minimum in a row."""
    step = np.arange(len(t) + 1, dtype=np.int32)
    rows = np.empty((len(a) + 1, len(t) + 1), dtype=np.int32)
    rows[0] = first
    for k, word in enumerate(a):
        best = np.empty(len(t) + 1, dtype=np.int32)
        best[0] = start + k + 1
        best[1:] = np.minimum(rows[k, :-1] + (t != word), rows[k, 1:] + 1)
        rows[k + 1] = np.minimum.accumulate(best - step) + step
    return rows


def _edit_counts(answer: list[str], heard: list[str]) -> tuple[int, int, int, int]:
    """Insertions, deletions, substitutions and hits on the way back that prefers hit, insertion, deletion,
    substitution.

    Only every ``KEPT_ROWS``-th row of the distance matrix is stored; the rows between are worked out again on the way
    back, so long texts need memory for one strip only.
    """
    codes: dict[str, int] = {}
    a, t = (np.array([codes.setdefault(w.lower(), len(codes)) for w in words], dtype=np.int64) for words in (answer, heard))
    stored = [np.arange(len(t) + 1, dtype=np.int32)]
    for at in range(0, len(a) - KEPT_ROWS + 1, KEPT_ROWS):
        stored.append(_distance_rows(stored[-1], a[at:at + KEPT_ROWS], t, at)[-1])
    i, j, ins, dele, sub, hit = len(a), len(t), 0, 0, 0, 0
    base, m = len(a) + 1, None
    while i or j:
        if m is None or i - 1 < base and i > 0:
            base = max(i - 1, 0) // KEPT_ROWS * KEPT_ROWS
            m = _distance_rows(stored[base // KEPT_ROWS], a[base:base + KEPT_ROWS], t, base)
        r = i - base
        if i and j and a[i - 1] == t[j - 1] and m[r, j] == m[r - 1, j - 1]:
            i, j, hit = i - 1, j - 1, hit + 1
        elif j and m[r, j] == m[r, j - 1] + 1:
            j, ins = j - 1, ins + 1
        elif i and m[r, j] == m[r - 1, j] + 1:
            i, dele = i - 1, dele + 1
        else:
            i, j, sub = i - 1, j - 1, sub + 1
    return ins, dele, sub, hit


def transcript_errors(df: DataFrame, answer: str, heard: str) -> DataFrame:
    """Word error rate and error counts of each pair of word lists; case does not count."""
    schema = "struct<ins:int,del:int,sub:int,correct:int>"

    @F.pandas_udf(schema)
    def score(answers: pd.Series, heards: pd.Series) -> pd.DataFrame:
        rows = [_edit_counts(list(a), list(h)) for a, h in zip(answers, heards)]
        return pd.DataFrame(rows, columns=["ins", "del", "sub", "correct"])

    scored = df.withColumn("_e", score(answer, heard)).withColumn("words", F.size(answer))
    wrong = F.col("_e.ins") + F.col("_e.del") + F.col("_e.sub")
    return scored.select("*", "_e.*").withColumn("wer", F.try_divide(wrong, F.col("words"))).drop("_e")


def word_distance(answer, heard):
    """Word-level edit distance without Python: each distinct word becomes one character for ``levenshtein``.

    Good for a million distinct words in a pair: characters start above the ASCII range and leave out the surrogates.
    """
    lower = lambda words: F.transform(words, lambda w: F.lower(w))
    place = lambda known, w: F.array_position(known, w) + F.lit(0x100)
    point = lambda p: F.when(p < 0xD800, p).otherwise(p + 0x800)
    code = lambda words, known: F.array_join(F.transform(words, lambda w: F.decode(
        F.unhex(F.lpad(F.hex(point(place(known, w))), 8, "0")), "UTF-32")), "")
    both = lambda a, b: bind(F.array_distinct(F.concat(a, b)), lambda k: F.levenshtein(code(a, k), code(b, k)))
    return bind(lower(answer), lambda a: bind(lower(heard), lambda b: both(a, b)))


# --- training sequences ------------------------------------------------------------------------------------------

def assembled(sequences: DataFrame, dimension: str = "embedding", seed: int | None = None) -> DataFrame:
    """Training sequences (sequence_id, pos, embedding, cluster_id) put end to end under labels of their own.

    Labels get the sequence id as prefix, so equal names in two sequences stay apart. ``place`` is the order of the
    whole: by sequence, or by a seeded random order of the sequences. Vectors of unequal length are an error.
    """
    sizes = sequences.agg(F.min(F.size(dimension)).alias("lo"), F.max(F.size(dimension)).alias("hi")).first()
    if sizes["lo"] != sizes["hi"]:
        raise ValueError("all vectors must have the same number of elements")
    lengths = sequences.groupBy("sequence_id").agg(F.count(F.lit(1)).alias("_n"))
    if seed is None:
        laid = ranked(lengths, ["sequence_id"], "_draw", total={"_end": F.col("_n")})
    else:
        numbered = ranked(lengths, ["sequence_id"], "_no", size="_all")
        shuffled = numbered.withColumn("_draw", permuted(F.col("_no"), F.col("_all"), seed))
        laid = ranked(shuffled, ["_draw"], "_at", total={"_end": F.col("_n")})
    placed = salted_join(sequences, laid.select("sequence_id", (F.col("_end") - F.col("_n")).alias("_base")), ["sequence_id"])
    label = F.concat_ws("_", F.col("sequence_id").cast("string"), F.col("cluster_id").cast("string"))
    return placed.select((F.col("_base") + F.col("pos")).alias("place"), label.alias("cluster_id"), dimension)


def regrouped(df: DataFrame, keys: list[str], pos: str, label: str) -> DataFrame:
    """One sub-sequence per label: the place of each row within its label, and the label's length plus one."""
    ranked = along(df, [*keys, label], [pos], rank="place")
    lengths = df.groupBy(*keys, label).agg((F.count(F.lit(1)) + 1).alias("length"))
    return salted_join(ranked, lengths, [*keys, label])


def random_mixes(items: DataFrame, item: str, samples: int, seed: int, least: int = 10, most: int = 19) -> DataFrame:
    """Random training mixes: per sample ``least`` to ``most`` different items, in random order (sample, slot, item).

    Items are numbered, and each sample takes the first places of its own random order of the numbers, so it never draws an
    item twice and items and samples meet in an equi-join on the number. The draws are repeatable. A sample takes all
    items if there are fewer.
    """
    numbered = cut_lineage(ranked(items.select(item), [item], "_no"))
    count = numbered.count()
    size = F.least(drawn(F.col("sample"), most - least + 1, seed) + least, F.lit(count))
    slots = F.explode(F.sequence(F.lit(0).cast("long"), size - 1))
    wanted = (items.sparkSession.range(samples if count else 0).withColumnRenamed("id", "sample").select("sample", slots.alias("slot"))
              .withColumn("_no", permuted(F.col("slot"), F.lit(count), seed, F.col("sample"))))
    return wanted.join(numbered, "_no").select("sample", F.col("slot").cast("int").alias("slot"), item)
