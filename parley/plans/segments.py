"""Interval queries: who speaks when."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.times import hms, hour_clock, minute_clock
from ..operators import intervals as iv
from ..operators.audio import trimmed
from ..operators.skew import lookup_join
from ..operators.series import along, differs
from . import views as v
from .registry import query
from .views import DAY_MS, HOUR_MS, with_views



@query(with_views(v.LAB) + """SELECT person, label, start, coalesce(lead(start) OVER (PARTITION BY person ORDER BY run), last_seen) AS "end"
FROM (SELECT person, run, any_value(label) AS label, min(t) AS start, max(t) AS last_seen FROM (
  SELECT *, sum(chg) OVER (PARTITION BY person ORDER BY t) AS run FROM (
    SELECT *, (label IS DISTINCT FROM lag(label) OVER (PARTITION BY person ORDER BY t))::INT AS chg FROM lab))
  GROUP BY person, run)""")
def run_compaction(spark, folder):
    return iv.compact_runs(v.lab(spark, folder), ["person"], "t", "label")


@query(with_views(v.UTT) + """SELECT meeting, arg_min(speaker, ord) AS speaker, min(start_ms) AS start_ms,
  max(end_ms) AS end_ms, count(*) AS pieces FROM (
  SELECT *, sum(chg) OVER (PARTITION BY meeting ORDER BY ord) AS run FROM (
    SELECT *, (speaker IS DISTINCT FROM lag(speaker) OVER (PARTITION BY meeting ORDER BY ord))::INT AS chg FROM utt))
  GROUP BY meeting, run""")
def run_merge(spark, folder):
    return iv.merge_runs(v.utt(spark, folder), ["meeting"], "ord", "speaker").drop("run")


SLICE_MS = 1000 * (1 / 1.2) * (1 - 0.4)


@query(with_views(v.LAB) + f"""SELECT person, any_value(label) AS label, floor(min(i)*{SLICE_MS!r} + 0.5)::BIGINT AS start,
  floor((max(i)+1)*{SLICE_MS!r} + 0.5)::BIGINT AS "end" FROM (
  SELECT *, i - row_number() OVER (PARTITION BY person, label ORDER BY i) AS grp FROM (
    SELECT person, label, row_number() OVER (PARTITION BY person ORDER BY t, event_id) - 1 AS i FROM lab))
  GROUP BY person, label, grp""")
def label_slices(spark, folder):
    windows = iv.numbered(v.lab(spark, folder), ["person"], ["t", "event_id"], "i")
    return iv.label_slices(windows, ["person"], "i", "label", SLICE_MS)


@query(with_views(v.UTT, v.FRM) + """SELECT f.person, f.frame, u.meeting, u.ord, u.speaker FROM frm f
  JOIN utt u ON u.meeting = f.meeting AND f.time_ms >= u.start_ms AND f.time_ms < u.end_ms""")
def point_in_interval(spark, folder):
    found = iv.points_in_intervals(v.frm(spark, folder, "meeting").drop("event_id"),
                                   v.utt(spark, folder).select("meeting", "ord", "speaker", "start_ms", "end_ms"),
                                   ["meeting"], "time_ms", 60_000)
    return found.select("person", "frame", "meeting", "ord", "speaker")


@query(with_views(v.UTT, v.FRM) + """SELECT u.meeting, u.ord, f.person, count(*) AS frames, min(f.frame) AS first_frame,
  max(f.frame) AS last_frame FROM utt u JOIN frm f ON u.meeting = f.meeting AND f.time_ms BETWEEN u.start_ms AND u.end_ms
  GROUP BY ALL""")
def interval_join(spark, folder):
    found = iv.points_in_intervals(v.frm(spark, folder, "meeting").drop("event_id"),
                                   v.utt(spark, folder).select("meeting", "ord", "start_ms", "end_ms"),
                                   ["meeting"], "time_ms", 60_000, closed=True)
    return found.groupBy("meeting", "ord", "person").agg(
        F.count(F.lit(1)).alias("frames"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"))


COVER = """ev AS (SELECT meeting, t, sum(d) AS d FROM (SELECT meeting, start_ms AS t, 1 AS d FROM seg WHERE end_ms > start_ms
  UNION ALL SELECT meeting, end_ms, -1 FROM seg WHERE end_ms > start_ms) GROUP BY meeting, t),
cover AS (SELECT meeting, t AS start_ms, lead(t) OVER w AS end_ms, (sum(d) OVER w)::BIGINT AS active FROM ev
  WINDOW w AS (PARTITION BY meeting ORDER BY t))"""


@query(with_views(v.SEG, COVER) + "SELECT * FROM cover WHERE active > 0")
def sweep_overlap(spark, folder):
    return iv.coverage(v.seg(spark, folder), ["meeting"])


@query(with_views(v.SEG) + """SELECT meeting, id, speaker, start_ms, end_ms FROM seg a WHERE NOT EXISTS (
  SELECT 1 FROM seg b WHERE b.meeting = a.meeting AND b.id <> a.id AND b.start_ms <= a.start_ms AND a.end_ms <= b.end_ms)""")
def drop_contained(spark, folder):
    s = v.seg(spark, folder).select("meeting", "id", "speaker", "start_ms", "end_ms")
    return iv.without_contained(s, ["meeting"], "id")


# The speech of a meeting with overlaps merged, and the start of each piece when the silence is cut out.
KEPT = """kept AS (SELECT meeting, start_ms, end_ms, (sum(end_ms - start_ms) OVER (PARTITION BY meeting ORDER BY start_ms)
  - (end_ms - start_ms))::BIGINT AS cut_start FROM cover WHERE active > 0)"""


@query(with_views(v.SEG, v.FRM, COVER, KEPT) + """SELECT f.person, f.frame, k.meeting, f.cut_ms,
  least(k.start_ms + f.cut_ms - k.cut_start, k.end_ms) AS original
  FROM (SELECT person, frame, person % 10 AS meeting, frame * 1000003 AS cut_ms FROM frm) f
  ASOF JOIN kept k ON f.meeting = k.meeting AND f.cut_ms >= k.cut_start""")
def offset_map(spark, folder):
    kept = iv.coverage(v.seg(spark, folder), ["meeting"]).drop("active")
    times = v.frm(spark, folder).select("person", "frame", (F.col("person") % 10).alias("meeting"),
                                        (F.col("frame") * 1000003).alias("cut_ms"))
    return iv.original_times(times, kept, ["meeting"], "cut_ms")


@query(with_views(v.SEG, v.FRM) + """SELECT f.person, f.frame, s.start_ms, s.end_ms FROM (
    SELECT person, frame, person % 10 AS meeting, 1704067200000 + frame * 37000000 AS t FROM frm) f
  JOIN (SELECT meeting, start_ms, lead(start_ms) OVER (PARTITION BY meeting ORDER BY start_ms) AS end_ms
        FROM (SELECT DISTINCT meeting, start_ms FROM seg)) s
  ON s.meeting = f.meeting AND f.t >= s.start_ms AND f.t < s.end_ms""")
def speech_span(spark, folder):
    points = v.seg(spark, folder).select("meeting", "start_ms").distinct()
    spans = along(points, ["meeting"], ["start_ms"], lead={"end_ms": F.col("start_ms")})
    times = v.frm(spark, folder).select("person", "frame", (F.col("person") % 10).alias("meeting"),
                                        (F.lit(1704067200000) + F.col("frame") * 37000000).alias("t"))
    found = iv.asof(times, spans, ["meeting"], "t", "start_ms", ["start_ms", "end_ms"])
    return found.filter(F.col("t") < F.col("end_ms")).select("person", "frame", "start_ms", "end_ms")


@query(with_views(v.SEG) + """, f AS (SELECT meeting, min(start_ms) AS a, max(end_ms) AS b FROM seg GROUP BY meeting)
SELECT meeting, id::VARCHAR AS speaker, start_ms, end_ms FROM seg UNION ALL
SELECT meeting, '-1', 0, a FROM f WHERE a > 0 UNION ALL SELECT meeting, '-1', b, b + 3600000 FROM f""")
def unknown_ends(spark, folder):
    s = v.seg(spark, folder).select("meeting", F.col("id").cast("string").alias("speaker"), "start_ms", "end_ms")
    bounds = s.groupBy("meeting").agg((F.max("end_ms") + HOUR_MS).alias("duration_ms"))
    return iv.with_unknown_ends(s, ["meeting"], bounds)


@query(with_views(v.LAB) + """, n AS (SELECT person, label, row_number() OVER (PARTITION BY person ORDER BY t, event_id) - 1 AS i FROM lab),
runs AS (SELECT person, any_value(label) AS speaker, max(i) AS last FROM (SELECT *, i - row_number() OVER (PARTITION BY person, label ORDER BY i) AS g FROM n)
  GROUP BY person, label, g),
chg AS (SELECT person, speaker, (last + 1) * 333 AS change, row_number() OVER (PARTITION BY person ORDER BY last) - 1 AS ord FROM runs),
c AS (SELECT person, i, (SELECT count(*) FROM chg WHERE chg.person = n.person AND chg.change < n.i * 333 + 400) AS c FROM n),
s AS (SELECT *, i - max(greatest(i - c, -1)) OVER (PARTITION BY person ORDER BY i) AS s FROM c)
SELECT s.person, s.i AS frame, s.s AS ord, chg.speaker FROM s JOIN chg ON chg.person = s.person AND chg.ord = s.s""")
def centre_labels(spark, folder):
    n = iv.numbered(v.lab(spark, folder), ["person"], ["t", "event_id"], "frame").select("person", "label", "frame")
    runs = (along(n, ["person"], ["frame"], runs={"ord": (F.col("label"), differs)}).groupBy("person", "ord")
            .agg(F.first("label").alias("speaker"), ((F.max("frame") + 1) * 333).alias("change")))
    windows = n.select("person", "frame", (F.col("frame") * 333 + 400).alias("centre"))
    return iv.centre_labels(windows, runs, ["person"], "frame", "centre").select("person", "frame", "ord", "speaker")


@query(with_views(v.SEG) + """SELECT meeting, id, ord, end_ms - start_ms AS ms FROM (
  SELECT *, row_number() OVER (PARTITION BY meeting ORDER BY start_ms, id) - 1 AS ord FROM seg)
  WHERE end_ms - start_ms >= 1000000""")
def min_duration(spark, folder):
    s = iv.numbered(v.seg(spark, folder).select("meeting", "id", "start_ms", "end_ms"), ["meeting"],
                    ["start_ms", "id"])
    return (s.filter(iv.at_least("start_ms", "end_ms", 1_000_000))
            .select("meeting", "id", "ord", (F.col("end_ms") - F.col("start_ms")).alias("ms")))


@query(with_views(v.LAB) + """SELECT person, t AS start, "end", row_number() OVER (PARTITION BY person ORDER BY t) - 1 AS ord
  FROM (SELECT *, lead(t) OVER (PARTITION BY person ORDER BY t) AS "end" FROM lab)
  WHERE label = 'click' AND "end" IS NOT NULL""")
def class_intervals(spark, folder):
    spans = along(v.lab(spark, folder), ["person"], ["t"], lead={"end": F.col("t")})
    mine = spans.filter((F.col("label") == "click") & F.col("end").isNotNull())
    return iv.numbered(mine.select("person", F.col("t").alias("start"), "end"), ["person"], ["start"])


QUIET = """silent AS (SELECT meeting, start_ms, end_ms FROM cover WHERE active > 0),
bound AS (SELECT meeting, max(end_ms) + 3600000 AS duration_ms FROM seg GROUP BY meeting),
timeline AS (SELECT meeting, 'silence' AS kind, start_ms, end_ms FROM silent UNION ALL
  SELECT meeting, 'nonsilence', coalesce(lag(end_ms) OVER (PARTITION BY meeting ORDER BY start_ms), 0) AS s, start_ms
  FROM silent QUALIFY start_ms > s UNION ALL
  SELECT b.meeting, 'nonsilence', coalesce(max(end_ms), 0), any_value(duration_ms) FROM bound b
  LEFT JOIN silent s ON s.meeting = b.meeting GROUP BY b.meeting)"""


def _timeline(spark, folder):
    s = v.seg(spark, folder)
    silent = iv.coverage(s, ["meeting"]).drop("active")
    length = s.groupBy("meeting").agg((F.max("end_ms") + HOUR_MS).alias("duration_ms"))
    return iv.gaps(silent, ["meeting"], length)


@query(with_views(v.SEG, COVER, QUIET) + "SELECT * FROM timeline")
def silence_complement(spark, folder):
    return _timeline(spark, folder)


@query(with_views(v.SEG, COVER, QUIET) + """, mids AS (SELECT meeting, start_ms + (end_ms - start_ms)/2.0 AS mid
  FROM timeline WHERE kind = 'silence')
SELECT meeting, coalesce(lag(mid) OVER (PARTITION BY meeting ORDER BY mid), 0)::DOUBLE AS start_ms, mid::DOUBLE AS end_ms FROM mids
UNION ALL SELECT b.meeting, coalesce(max(mid), 0)::DOUBLE, any_value(duration_ms)::DOUBLE FROM bound b LEFT JOIN mids m
  ON m.meeting = b.meeting GROUP BY b.meeting""")
def midpoint_split(spark, folder):
    return iv.midpoint_splits(_timeline(spark, folder), ["meeting"])


@query(with_views(v.SEG) + """SELECT meeting, id % 4 AS mic, start_ms, end_ms, row_number() OVER
  (PARTITION BY meeting ORDER BY start_ms, id) - 1 AS ord FROM seg""")
def mic_union(spark, folder):
    s = v.seg(spark, folder)
    mics = [s.filter(F.col("id") % 4 == m).withColumn("mic", F.lit(m).cast("long")) for m in range(4)]
    union = mics[0]
    for m in mics[1:]:
        union = union.unionByName(m)
    return (iv.numbered(union.select("meeting", "id", "mic", "start_ms", "end_ms"), ["meeting"], ["start_ms", "id"]).drop("id"))


@query(with_views(v.SEG) + """SELECT meeting, id, id % 4 AS mic, start_ms, end_ms FROM seg
  WHERE id % 4 = CASE speaker WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 WHEN 'error' THEN 3 END""")
def mic_selection(spark, folder):
    matched = spark.createDataFrame([("click", 0), ("view", 1), ("purchase", 2), ("error", 3)], "speaker string, mic long")
    s = v.seg(spark, folder).withColumn("mic", F.col("id") % 4)
    return lookup_join(s, matched, ["speaker", "mic"], "left_semi").select("meeting", "id", "mic", "start_ms", "end_ms")


@query(with_views(v.SEG) + """SELECT meeting, id, CASE speaker WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase'
  THEN 2 ELSE -1 END AS matched FROM seg""")
def speaker_relabel(spark, folder):
    mapping = spark.createDataFrame([("click", 0), ("view", 1), ("purchase", 2)], "speaker string, matched int")
    s = v.seg(spark, folder).select("meeting", "id", "speaker")
    return (lookup_join(s, mapping, ["speaker"], "left")
            .select("meeting", "id", F.coalesce("matched", F.lit(-1)).alias("matched")))


@query(with_views(v.SEG) + """SELECT meeting, id, greatest(start_ms, 1704672000000) AS start_ms, least(end_ms, 1705276800000) AS end_ms
  FROM seg WHERE start_ms < 1705276800000 AND end_ms > 1704672000000""")
def trim_range(spark, folder):
    lo, hi = 1704672000000, 1705276800000
    s = v.seg(spark, folder).filter((F.col("start_ms") < hi) & (F.col("end_ms") > lo))
    return s.select("meeting", "id", F.greatest("start_ms", F.lit(lo)).alias("start_ms"),
                    F.least("end_ms", F.lit(hi)).alias("end_ms"))


@query(with_views(v.SEG) + """SELECT meeting, id, start_ms - 1704672000000 AS t_ms, value FROM seg
  WHERE start_ms >= 1704672000000 AND start_ms < 1705276800000""")
def trimmed_samples(spark, folder):
    samples = v.seg(spark, folder).select("meeting", "id", F.col("start_ms").alias("t_ms"), "value")
    return trimmed(samples, 1704672000000, 1705276800000)


@query(with_views(v.UTT) + """SELECT meeting, ord,
  printf('%02d:%02d:%02d', (start_ms // 1000 % 86400) // 3600, (start_ms // 1000 % 3600) // 60, start_ms // 1000 % 60) AS hms,
  printf('%d:%02d.%d', start_ms // 60000, start_ms % 60000 // 1000, start_ms % 1000) AS minute_clock,
  printf('%d:%d:%.2f', start_ms // 3600000, start_ms % 3600000 // 60000, (start_ms / 1000) % 3600 % 60) AS hour_clock
  FROM utt""")
def time_formats(spark, folder):
    ms = F.col("start_ms")
    return v.utt(spark, folder).select("meeting", "ord", hms(ms).alias("hms"), minute_clock(ms).alias("minute_clock"),
                                       hour_clock(ms / 1000).alias("hour_clock"))
