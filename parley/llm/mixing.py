"""Mixing sources to target weights by a curriculum over training time.

A source's weight changes over training time. Its integral says which share of the source's demand has been served at a
time; inverted, it says at which time the n-th word of a source is wanted. Every copy of a document gets the time of its
first word, and the result is range-sorted by that time. Only DataFrame functions are used.

Nulls: a null or empty text has size 0 and is never taken; a null source is a source of its own and comes last; a null id
is an ordinary id. Rows that repeat are rows of their own; ties in the order within a source are broken by id and size (by
the row's place in ``mix``), and rows equal in both are interchangeable. A source without words gets target 0. An empty table gives an empty result.
Columns besides the three named are ignored, so names cannot clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage
from .common import free_name

WORD = r"[^ \t-\r]+"
PASSES = 3  # a document is taken at most this often
WEIGHTS = (1, 2, 3)
#: Weight of a source at equally spaced moments of the training, by its base weight: light sources first, heavy ones last.
SCHEDULES = {1: (1.5, 1.0, 0.5), 2: (1.0, 1.0, 1.0), 3: (0.5, 1.0, 1.5)}
ROWS = 1 << 12  # of a source that one window sorts


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shares(sources: DataFrame, weight: Column) -> DataFrame:
    """Add ``target``: all words shared by ``weight``, no source above ``PASSES`` times its own.

    ``sources`` has one row per source with ``source_size``. Sources in the order of their limit per weight: those whose
    limit is below an even share of what is left are full; the others share the rest by weight.
    """
    everything = Window.partitionBy(F.lit(0))
    order = everything.orderBy("_ratio", "_key")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    s = sources.withColumns({"_weight": weight, "_limit": F.col("source_size") * PASSES, "_ratio": F.col("source_size") * PASSES / weight})
    s = s.withColumn("_total", F.sum("source_size").over(everything))
    left = F.col("_total") - F.coalesce(F.sum("_limit").over(before), F.lit(0))
    s = s.withColumn("_full", F.col("_limit") * F.sum("_weight").over(onward) < F.col("_weight") * left)
    full = F.coalesce(F.sum(F.when(F.col("_full"), F.col("_limit"))).over(everything), F.lit(0))
    rest = F.sum(F.when(~F.col("_full"), F.col("_weight"))).over(everything)
    even = F.col("_weight") * (F.col("_total") - full) / rest
    return s.withColumn("target", F.when(F.col("_full"), F.col("_limit").cast("double")).otherwise(F.coalesce(even, F.lit(0.0))))


def when_served(share: Column, knots: tuple[float, ...]) -> Column:
    """Training time in [0, 1] at which ``share`` of the demand is served, for a weight linear between ``knots``."""
    n = len(knots) - 1
    areas = [(knots[i] + knots[i + 1]) / 2 / n for i in range(n)]
    total = math.fsum(areas)
    time, done = F.lit(None).cast("double"), 0.0
    for i in range(n):
        a, b = knots[i], knots[i + 1]
        part = share * total - done  # the area wanted inside this piece
        if a == b:
            inside = part * n / a
        else:
            inside = (F.sqrt(F.greatest(F.lit(0.0), part * n * 2 * (b - a) + a * a)) - a) / (b - a)
        piece = (F.least(F.lit(1.0), F.greatest(F.lit(0.0), inside)) + i) / n
        done += areas[i]
        time = F.when(time.isNull() & ((share * total < done) if i < n - 1 else F.lit(True)), piece).otherwise(time)
    return time


def curriculum(docs: DataFrame, schedules=SCHEDULES, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document in the order of training: doc_id, source, size, source_size, target, taken, position, copies.

    ``carry`` names columns that stay beside their row and put rows of equal id and size in order.

    ``copies`` holds a (position, words) pair for each time the document is read; ``position`` is the first (null and last
    if the document is not taken). The copy at which a source's demand ends is read up to the last wanted word.
    """
    sized = docs.select(*carry, "doc_id", "source", word_count(F.col("text")).alias("size"),
                        F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("t")).alias("_key"),
                        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("_order"))
    sized = cut_lineage(sized)
    # Chunks of a source by the leading digits of the order, so that no window sorts a whole source.
    digits = min(8, max(0, math.ceil(math.log(max(1, sized.count()) / ROWS, 16))))
    sized = sized.withColumn("_chunk", F.substring("_order", 1, digits) if digits else F.lit(""))
    sums = sized.groupBy("_key", "_chunk").agg(F.sum("size").alias("_words"))
    chunks = sums.withColumn("_carry", F.coalesce(F.sum("_words").over(
        Window.partitionBy("_key").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    sources = sums.groupBy("_key").agg(F.sum("_words").alias("source_size"))
    number = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_key")) - 1
    sources = shares(sources.withColumn("_number", number), 1 + F.col("_number") % len(WEIGHTS))
    known = chunks.join(sources.select("_key", "source_size", "target", "_weight"), "_key").drop("_words")
    rows = sized.join(known, ["_key", "_chunk"])
    inside = Window.partitionBy("_key", "_chunk").orderBy("_order", "doc_id", "size", *carry).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_before", F.col("_carry") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    wanted = F.floor("target").cast("long")

    def copy(i: int) -> Column:
        start = F.col("_before") + F.col("source_size") * i
        share = start / F.col("target")
        place = F.lit(None).cast("double")
        for base, knots in schedules.items():
            place = F.when(F.col("_weight") == base, when_served(share, knots)).otherwise(place)
        words = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), wanted - start))
        return F.struct(place.alias("position"), words.alias("words"))

    rows = rows.withColumn("copies", F.filter(F.array(*[copy(i) for i in range(PASSES)]), lambda c: c["words"] > 0))
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda s, c: s + c["words"])
    rows = rows.select(*carry, "doc_id", "source", "size", "source_size", "target", taken.alias("taken"),
                       F.get("copies", F.lit(0))["position"].alias("position"), "copies")
    return rows.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def mix(docs: DataFrame) -> DataFrame:
    """The documents of the mix, one row for each time one is read, whole, in the order of training.

    Rows are told apart by their place in the table, so rows with equal ids, sources and sizes are planned each; ``docs`` must
    be a stored table, which reads the same twice.
    """
    name = free_name(docs, "_row")
    placed = docs.withColumn(name, F.monotonically_increasing_id())
    plan = curriculum(placed.select(name, "doc_id", "source", "text"), carry=(name,)).filter("taken > 0")
    copies = plan.select(F.col(name), F.explode("copies").alias(free_name(placed, "_copy")))
    copy = copies.columns[1]
    return placed.join(copies, name).orderBy(f"{copy}.position", "doc_id", name).select(*docs.columns)


SQL = r"""
WITH d AS (SELECT doc_id, coalesce('s' || source, 't') AS k, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    md5(coalesce(doc_id::VARCHAR, '')) AS o FROM documents),
s0 AS (SELECT k, sum(size)::BIGINT AS source_size, 1 + (row_number() OVER (ORDER BY k) - 1) % 3 AS w FROM d GROUP BY k),
s1 AS (SELECT *, sum(source_size) OVER () AS total, sum(w) OVER onward AS w_on,
    coalesce(sum(3 * source_size) OVER before, 0) AS used FROM s0
    WINDOW onward AS (ORDER BY 3 * source_size / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
           before AS (ORDER BY 3 * source_size / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s2 AS (SELECT *, 3 * source_size * w_on < w * (total - used) AS is_full FROM s1),
s AS (SELECT k, source_size, w, CASE WHEN is_full THEN (3 * source_size)::DOUBLE ELSE
    (w * (total - coalesce(sum(CASE WHEN is_full THEN 3 * source_size END) OVER (), 0)))::DOUBLE / sum(CASE WHEN NOT is_full THEN w END) OVER () END AS target FROM s2),
r AS (SELECT d.*, s.source_size, s.target, s.w, coalesce(sum(size) OVER (PARTITION BY k ORDER BY o, doc_id, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM d JOIN s USING (k))
SELECT doc_id, size, source_size, target, (greatest(0, least(size, floor(target)::BIGINT - b))
  + greatest(0, least(size, floor(target)::BIGINT - b - source_size))
  + greatest(0, least(size, floor(target)::BIGINT - b - 2 * source_size)))::BIGINT AS taken FROM r
"""
