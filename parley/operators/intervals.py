"""Interval algebra over speech segments. Intervals are half-open ``[start, end)`` unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from .series import along, differs


def compact_runs(df: DataFrame, keys: list[str], time: str, label: str) -> DataFrame:
    """Dense labels to runs: a run ends where the next one starts, the last one at the last timestamp itself."""
    runs = (along(df.select(*keys, time, label), keys, [time], runs={"run": (F.col(label), differs)})
            .groupBy(*keys, "run")
            .agg(F.min_by(label, time).alias(label), F.min(time).alias("start"), F.max(time).alias("last_seen")))
    return (along(runs, keys, ["run"], lead={"next_start": F.col("start")})
            .select(*keys, label, "start", F.coalesce("next_start", "last_seen").alias("end")))


def merge_runs(df: DataFrame, keys: list[str], order: str, label: str,
               start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """Neighbours with the same label become one interval from the first start to the last end."""
    return (along(df.select(*keys, order, label, start, end), keys, [order], runs={"run": (F.col(label), differs)})
            .groupBy(*keys, "run")
            .agg(F.min_by(label, order).alias(label), F.min_by(start, order).alias(start),
                 F.max_by(end, order).alias(end), F.count(F.lit(1)).alias("pieces")))


def label_slices(df: DataFrame, keys: list[str], index: str, label: str, step: float) -> DataFrame:
    """Window labels to time slices: a run of equal labels times the window step, each bound rounded half up."""
    runs = (along(df.select(*keys, index, label), keys, [index], runs={"run": (F.col(label), differs)})
            .groupBy(*keys, "run")
            .agg(F.min_by(label, index).alias(label), F.min(index).alias("_from"), F.max(index).alias("_to")))
    at = lambda i: F.floor(i * F.lit(float(step)) + 0.5).cast("long")
    return runs.select(*keys, label, at(F.col("_from")).alias("start"), at(F.col("_to") + 1).alias("end"))


def points_in_intervals(points: DataFrame, intervals: DataFrame, keys: list[str], time: str, width: float, *,
                        start: str = "start_ms", end: str = "end_ms", closed: bool = False,
                        how: str = "inner") -> DataFrame:
    """Range join: every point with every interval of its key that holds it.

    Both sides meet on (key, time bucket of ``width``), so a busy key is spread over its buckets and no key is joined
    as a whole; adaptive execution splits a bucket that is still too large. ``closed`` takes the end point too.
    ``how`` is inner or left (points without interval are kept).
    """
    bucket = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long")
    valid = F.col(end) >= F.col(start) if closed else F.col(end) > F.col(start)
    pieces = intervals.filter(valid).withColumn("_bucket", F.explode(F.sequence(bucket(start), bucket(end))))
    points = points.withColumn("_bucket", bucket(time))
    p, i = points.alias("p"), pieces.alias("i")
    inside = (F.col(f"p.{time}") >= F.col(f"i.{start}")) & (
        F.col(f"p.{time}") <= F.col(f"i.{end}") if closed else F.col(f"p.{time}") < F.col(f"i.{end}"))
    on = inside
    for k in [*keys, "_bucket"]:
        on = on & (F.col(f"p.{k}") == F.col(f"i.{k}"))
    extra = [F.col(f"i.{c}") for c in intervals.columns if c not in keys]
    return p.join(i, on, how).select(*[F.col(f"p.{c}") for c in points.columns if c != "_bucket"], *extra)


def asof(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str,
         values: list[str], strict: bool = False) -> DataFrame:
    """For every left row the right row with the greatest time not after it (before it if ``strict``).

    ``right`` has one row per key and time. The two sides are unioned and swept once in time order.
    """
    # A time of the same type on both sides travels once, as the order.
    once = [left_time] if left.schema[left_time].dataType == right.schema[right_time].dataType else []
    payload = [c for c in left.columns if c not in [*keys, *once]]
    mark = 0 if strict else 1
    ours = left.select(*keys, F.col(left_time).alias("_t"), F.lit(mark).alias("_side"), F.lit(True).alias("_left"),
                       F.struct(*payload, F.lit(0).alias("_")).alias("_row"))
    theirs = right.select(*keys, F.col(right_time).alias("_t"), F.lit(1 - mark).alias("_side"),
                          F.lit(False).alias("_left"),
                          F.struct(*[F.col(v) for v in values]).alias("_found"))
    both = ours.unionByName(theirs, allowMissingColumns=True)
    swept = along(both, keys, ["_t", "_side"], last={"_hit": F.col("_found")})
    ours = [(F.col("_t") if c in once else F.col(f"_row.{c}")).alias(c) for c in left.columns if c not in keys]
    return swept.filter("_left").select(*keys, *ours, *[F.col(f"_hit.{v}").alias(v) for v in values])


def coverage(df: DataFrame, keys: list[str], start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """Split all intervals at every start and end; the pieces that at least one interval covers, with their count.

    Starts and ends are first added up per instant, so only distinct instants are swept.
    """
    deltas = (df.filter(F.col(end) > F.col(start))
              .select(*keys, F.explode(F.array(F.struct(F.col(start).alias("t"), F.lit(1).alias("d")),
                                               F.struct(F.col(end).alias("t"), F.lit(-1).alias("d")))).alias("e"))
              .groupBy(*keys, F.col("e.t").alias("t")).agg(F.sum("e.d").alias("d")))
    return (along(deltas, keys, ["t"], total={"active": F.col("d")}, lead={"until": F.col("t")})
            .filter("active > 0").select(*keys, F.col("t").alias(start), F.col("until").alias(end), "active"))


def without_contained(df: DataFrame, keys: list[str], ident: str, start: str = "start_ms",
                      end: str = "end_ms") -> DataFrame:
    """Drop every interval that lies inside another one; equal intervals drop each other.

    In the order (start, longest first) an interval that holds another comes before it, so one running maximum of the
    ends decides; no pairs are formed.
    """
    rows = df.withColumns({"_back": -F.col(end), "_span": F.struct(start, end)})
    order = [start, "_back", ident]
    seen = along(rows, keys, order, high_before={"_reached": F.col(end)}, lead={"_after": F.col("_span")})
    alone = ((F.col("_reached").isNull() | (F.col("_reached") < F.col(end)))
             & ~F.col("_after").eqNullSafe(F.col("_span")))
    return seen.filter(alone).select(*df.columns)


def gaps(df: DataFrame, keys: list[str], length: DataFrame, start: str = "start_ms",
         end: str = "end_ms") -> DataFrame:
    """Silent ranges of each recording to all its ranges, silent and not, without empty ones.

    ``length`` has one row per key with ``duration_ms``. A recording without silence is one non-silent range; one that
    is silent throughout is one silent range. Silent ranges must not overlap.
    """
    silent = cut_lineage(df.select(*keys, start, end))  # read four times below
    before = (along(silent, keys, [start], lag={"_prev": F.col(end)})
              .select(*keys, F.coalesce("_prev", F.lit(0)).alias(start), F.col(start).alias(end)))
    final = silent.groupBy(*keys).agg(F.max(end).alias("_last"))
    tail = (length.join(final, keys, "left")
            .select(*keys, F.coalesce("_last", F.lit(0)).alias(start), F.col("duration_ms").alias(end)))
    sound = before.unionByName(tail).filter(F.col(end) > F.col(start)).withColumn("kind", F.lit("nonsilence"))
    return sound.unionByName(silent.withColumn("kind", F.lit("silence"))).select(*keys, "kind", start, end)


def midpoint_splits(df: DataFrame, keys: list[str], start: str = "start_ms", end: str = "end_ms",
                    kind: str = "kind", speech=("speech", "nonsilence")) -> DataFrame:
    """Split a labelled timeline in the middle of every part that is not speech."""
    df = cut_lineage(df.select(*keys, kind, start, end))
    mids = (df.filter(~F.col(kind).isin(*speech))
            .select(*keys, (F.col(start) + (F.col(end) - F.col(start)) / 2).alias("mid")))
    cut = (along(mids, keys, ["mid"], lag={"_prev": F.col("mid")})
           .select(*keys, F.coalesce("_prev", F.lit(0.0)).alias(start), F.col("mid").alias(end)))
    last = mids.groupBy(*keys).agg(F.max("mid").alias("_mid"))
    tail = (df.groupBy(*keys).agg(F.max_by(end, start).cast("double").alias(end)).join(last, keys, "left")
            .select(*keys, F.coalesce("_mid", F.lit(0.0)).alias(start), end))
    return cut.unionByName(tail)


def original_times(times: DataFrame, intervals: DataFrame, keys: list[str], time: str,
                   start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """Times in a recording with the silence cut out, back to times in the whole recording.

    The kept ``intervals`` are laid end to end; a time past the last one maps to its end.
    """
    laid = along(cut_lineage(intervals.select(*keys, start, end)), keys, [start],
                 total={"_to": F.col(end) - F.col(start)})
    shift = laid.select(*keys, (F.col("_to") - (F.col(end) - F.col(start))).alias("_from"), F.col(start).alias("_start"),
                        F.col(end).alias("_end"))
    found = asof(cut_lineage(times), cut_lineage(shift), keys, time, "_from", ["_from", "_start", "_end"])
    return (found.withColumn("original", F.least(F.col("_start") + F.col(time) - F.col("_from"), F.col("_end")))
            .drop("_from", "_start", "_end"))


def with_unknown_ends(df: DataFrame, keys: list[str], bounds: DataFrame, speaker: str = "speaker",
                      start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """Add speaker -1 before the first and after the last interval; ``bounds`` holds ``duration_ms`` per key."""
    edge = df.groupBy(*keys).agg(F.min(start).alias("_first"), F.max(end).alias("_last")).join(bounds, keys)
    ends = edge.select(*keys, F.lit(-1).cast(df.schema[speaker].dataType).alias(speaker), F.explode(F.array(
        F.struct(F.lit(0).cast("long").alias(start), F.col("_first").alias(end)),
        F.struct(F.col("_last").alias(start), F.col("duration_ms").alias(end)))).alias("_e"))
    ends = ends.select(*keys, speaker, f"_e.{start}", f"_e.{end}").filter(F.col(end) > F.col(start))
    return df.select(*keys, speaker, start, end).unionByName(ends)


def centre_labels(windows: DataFrame, changes: DataFrame, keys: list[str], index: str, centre: str) -> DataFrame:
    """Label windows by the speaker whose change point lies at or after the window centre.

    ``changes`` has (key, ord from 0, change, speaker); at most one speaker is passed per window, as the source
    recordings are read in order. With ``c(n)`` change points before window n, the speaker number obeys
    s(n) = min(s(n-1) + 1, c(n)), which is n + min over m <= n of (c(m) - m): a running minimum.
    """
    counted = asof(windows, changes, keys, centre, "change", ["ord"], strict=True)
    passed = counted.withColumn("_ahead", F.col(index) - (F.coalesce("ord", F.lit(-1)) + 1)).drop("ord")
    swept = along(passed, keys, [index], high={"_most": F.greatest(F.col("_ahead"), F.lit(-1))})
    numbered = swept.withColumn("ord", F.col(index) - F.col("_most")).drop("_ahead", "_most")
    return numbered.join(changes.select(*keys, "ord", "speaker"), [*keys, "ord"])


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "ord") -> DataFrame:
    """0-based position of each row; number first, filter afterwards, to keep the original index."""
    return along(df, keys, order, rank=name)


def at_least(start: str, end: str, ms: int) -> Column:
    return F.col(end) - F.col(start) >= ms
