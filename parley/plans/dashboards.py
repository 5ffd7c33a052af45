"""Summary, emotion and dialogue queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as iv, summary as sm
from ..operators.series import along
from ..operators.skew import salted_join
from ..session import cut_lineage
from . import views as v
from .registry import query
from .views import with_views

MINUTE = 60_000

TURNS = """turns AS (SELECT meeting, speaker, sum(chg)::BIGINT AS utterances, sum(end_ms - start_ms)/1000 AS speech_s FROM (
  SELECT *, (speaker IS DISTINCT FROM lag(speaker) OVER (PARTITION BY meeting ORDER BY ord))::INT AS chg FROM utt)
  GROUP BY meeting, speaker)"""
NODS = """edges AS (SELECT meeting, speaker, person, (gesture = 1 AND coalesce(lag(gesture) OVER
  (PARTITION BY person ORDER BY frame), 0) = 0)::INT AS up FROM frm),
nods AS (SELECT meeting, speaker, sum(up)::BIGINT AS nods FROM edges GROUP BY meeting, speaker)"""
QUIET = """quiet AS (SELECT meeting, speaker, start_ms - last_end AS ms FROM (SELECT *, lag(end_ms) OVER
  (PARTITION BY meeting, speaker ORDER BY ord) AS last_end FROM utt) WHERE start_ms - last_end >= 3000)"""
SUMMARY = """summary AS (SELECT s.meeting, s.speaker, coalesce(utterances, 0) AS utterances, coalesce(speech_s, 0) AS speech_s,
  CASE WHEN utterances > 0 THEN speech_s / utterances END AS density_s,
  coalesce(speech_s, 0) / nullif(sum(speech_s) OVER (PARTITION BY s.meeting), 0) * 100 AS occupancy_pct,
  coalesce(nods, 0) AS nods, coalesce(q.ms, 0) / 1000 AS silence_s
  FROM (SELECT * FROM (SELECT DISTINCT meeting FROM utt), (SELECT unnest([0, 1, 2]) AS speaker)) s
  LEFT JOIN turns USING (meeting, speaker) LEFT JOIN nods USING (meeting, speaker)
  LEFT JOIN (SELECT meeting, speaker, sum(ms) AS ms FROM quiet GROUP BY ALL) q USING (meeting, speaker))"""


def _nods(spark, folder):
    e = v._events(spark, folder).select((F.col("user_id") % 100).alias("meeting"), (F.col("user_id") % 3).cast("int").alias("speaker"),
                                        F.col("user_id").alias("person"), "us", "event_id", (F.col("value") > 50).cast("int").alias("gesture"))
    up = sm.rising_edges(e, ["meeting", "speaker", "person"], ["us", "event_id"], "gesture")
    return up.groupBy("meeting", "speaker").agg(F.sum("nods").alias("nods"))


def _silence(spark, folder):
    told = along(v.utt(spark, folder), ["meeting", "speaker"], ["ord"], lag={"_end": F.col("end_ms")})
    return (told.filter(F.col("start_ms") - F.col("_end") >= 3000)
            .select("meeting", "speaker", F.col("_end").alias("start_ms"), F.col("start_ms").alias("end_ms")))


def _summary(spark, folder):
    return sm.speaker_summary(v.utt(spark, folder), _nods(spark, folder), _silence(spark, folder), 3)


@query(with_views(v.UTT, v.FRM, TURNS, NODS, QUIET, SUMMARY) + """SELECT meeting, speaker, utterances, speech_s::DOUBLE AS speech_s,
  round(density_s, 6) AS density_s, round(occupancy_pct, 6) AS occupancy_pct, nods, silence_s::DOUBLE AS silence_s FROM summary""")
def meeting_speaker_summary(spark, folder):
    s = _summary(spark, folder)
    return s.withColumns({"density_s": F.round("density_s", 6), "occupancy_pct": F.round("occupancy_pct", 6)})


@query(with_views(v.UTT, v.FRM, TURNS, NODS, QUIET, SUMMARY) + """SELECT s.meeting, s.nods, s.utterances, s.silence_s, e.negative_pct, e.normal_pct, e.positive_pct
FROM (SELECT meeting, sum(nods)::BIGINT AS nods, sum(utterances)::BIGINT AS utterances, round(sum(silence_s), 6)::DOUBLE AS silence_s FROM summary GROUP BY meeting) s
LEFT JOIN (SELECT meeting, round(100 * count(*) FILTER (prediction = 'Negative') / nullif(count(*), 0), 6) AS negative_pct,
  round(100 * count(*) FILTER (prediction = 'Normal') / nullif(count(*), 0), 6) AS normal_pct,
  round(100 * count(*) FILTER (prediction = 'Positive') / nullif(count(*), 0), 6) AS positive_pct
  FROM frm WHERE prediction <> 'Unknown' GROUP BY meeting) e USING (meeting)""")
def meeting_totals(spark, folder):
    t = sm.meeting_totals(_summary(spark, folder), v.frm(spark, folder, "meeting", "prediction"))
    return t.select("meeting", "nods", "utterances", F.round("silence_s", 6).alias("silence_s"),
                    *[F.round(c, 6).alias(c) for c in ("negative_pct", "normal_pct", "positive_pct")])


OLD = v.UTT.replace("ELSE 2 END", "ELSE -1 END")


@query(with_views(OLD, v.FRM, TURNS, NODS) + """SELECT meeting, speaker, utterances, floor(speech_s)::BIGINT AS speech_s,
  floor(speech_s / utterances)::BIGINT AS density_s, floor(speech_s / nullif(whole, 0) * 100)::BIGINT AS occupancy_pct,
  coalesce(nods, 0) AS nods FROM (SELECT *, sum(speech_s) OVER (PARTITION BY meeting) AS whole FROM turns)
  LEFT JOIN nods USING (meeting, speaker) WHERE speaker >= 0""")
def coarse_summary(spark, folder):
    old = v.utt(spark, folder).withColumn("speaker", F.when(F.col("speaker") == 2, -1).otherwise(F.col("speaker")))
    return sm.coarse_summary(old, _nods(spark, folder))


@query(with_views(v.FRM, NODS) + "SELECT person, sum(up)::BIGINT AS nods FROM edges GROUP BY person")
def nod_count(spark, folder):
    return sm.rising_edges(v.frm(spark, folder, "gesture"), ["person"], ["frame"], "gesture")


SHARE = ", ".join(f"count(*) FILTER (prediction = '{e}') / nullif(count(prediction), 0) AS {e.lower()}" for e in
                  ("Unknown", "Positive", "Normal", "Negative"))
MEANS = ", ".join(f"round(avg({e}), 6) AS {e}" for e in ("unknown", "positive", "normal", "negative"))
ROUNDED = ", ".join(f"round({e}, 6) AS {e}" for e in ("unknown", "positive", "normal", "negative"))
LABELS = ("unknown", "positive", "normal", "negative")


@query(with_views(v.FRM) + f"""SELECT person, {ROUNDED} FROM (SELECT person, {SHARE} FROM frm GROUP BY person)
  UNION ALL SELECT -1, {MEANS} FROM (SELECT person, {SHARE} FROM frm GROUP BY person)""")
def emotion_share(spark, folder):
    shares = sm.emotion_shares(v.frm(spark, folder, "prediction"), ["person"])
    mean = sm.mean_shares(shares, []).withColumn("person", F.lit(-1).cast("long"))
    both = shares.unionByName(mean)
    return both.select("person", *[F.round(c, 6).alias(c) for c in LABELS])


# Every person of a meeting has a row in each of its utterances.
GRID = """grid AS (SELECT u.meeting, u.ord, u.start_ms, u.end_ms, p.person FROM utt u JOIN (SELECT DISTINCT meeting, person FROM frm) p USING (meeting)),
f AS (SELECT g.meeting, g.ord, g.person, frm.prediction FROM grid g LEFT JOIN frm ON frm.meeting = g.meeting AND frm.person = g.person
  AND frm.time_ms BETWEEN g.start_ms AND g.end_ms)"""


def _in_utterances(spark, folder):
    return sm.emotions_in_utterances(v.frm(spark, folder, "meeting", "prediction").drop("event_id"), v.utt(spark, folder), MINUTE)


@query(with_views(v.UTT, v.FRM, GRID) + f"""SELECT meeting, ord, person, {ROUNDED} FROM (SELECT meeting, ord, person, {SHARE} FROM f GROUP BY ALL)""")
def emotion_share_per_utterance(spark, folder):
    return _in_utterances(spark, folder).select("meeting", "ord", "person", *[F.round(c, 6).alias(c) for c in LABELS])


@query(with_views(v.UTT, v.FRM, GRID) + f"""SELECT meeting, ord, {MEANS} FROM (SELECT meeting, ord, person, {SHARE} FROM f GROUP BY ALL) GROUP BY ALL""")
def mean_emotion_per_utterance(spark, folder):
    s = _in_utterances(spark, folder)
    return sm.mean_shares(s, ["meeting", "ord"]).select("meeting", "ord", *[F.round(c, 6).alias(c) for c in LABELS])


@query(with_views(v.UTT, v.FRM) + """, p AS (SELECT u.meeting, f.person, u.ord, u.start_ms, u.end_ms FROM utt u JOIN (SELECT DISTINCT meeting, person FROM frm) f USING (meeting)),
j AS (SELECT p.meeting, p.person, p.ord, f.prediction FROM p JOIN frm f ON f.meeting = p.meeting AND f.person = p.person AND f.time_ms >= p.start_ms AND f.time_ms < p.end_ms),
c AS (SELECT meeting, person, ord, prediction AS label, count(*) AS n FROM j GROUP BY ALL),
l AS (SELECT unnest(['Unknown', 'Positive', 'Normal', 'Negative']) AS label), w AS (SELECT meeting, person, ord, label FROM p, l),
g AS (SELECT meeting, person, ord, label, coalesce(n, 0) AS current FROM w LEFT JOIN c USING (meeting, person, ord, label))
SELECT *, (sum(current) OVER (PARTITION BY meeting, person, label ORDER BY ord))::BIGINT AS cumulative FROM g""")
def emotion_counts(spark, folder):
    return sm.emotion_counts(v.frm(spark, folder, "meeting", "prediction").drop("event_id"), v.utt(spark, folder), MINUTE)


CHANGES = """changes AS (SELECT meeting, ord, start_ms, src, speaker AS dst FROM (SELECT *, lag(speaker) OVER
  (PARTITION BY meeting ORDER BY ord) AS src FROM utt) WHERE src <> speaker)"""


@query(with_views(v.UTT, CHANGES) + """SELECT meeting, src, dst, weight,
  round(weight / sum(weight) OVER (PARTITION BY meeting), 6) AS share FROM (
  SELECT meeting, src, dst, count(*) AS weight FROM changes GROUP BY ALL)""")
def dialog_direction(spark, folder):
    return sm.direction_graph(v.utt(spark, folder)).withColumn("share", F.round("share", 6))


@query(with_views(v.UTT, CHANGES) + """SELECT meeting, dst, count(*) FILTER (src = 0) AS from_0, count(*) FILTER (src = 1) AS from_1,
  count(*) FILTER (src = 2) AS from_2 FROM changes WHERE start_ms <= 120000 GROUP BY ALL""")
def transition_matrix(spark, folder):
    return sm.transition_matrix(v.utt(spark, folder), 120_000, 3)


@query(with_views(v.UTT, CHANGES) + "SELECT meeting, src, count(*) AS out_degree FROM changes GROUP BY ALL")
def out_degree(spark, folder):
    return sm.out_degrees(sm.direction_graph(v.utt(spark, folder)))


LOUD = """mics AS (SELECT s.meeting, s.id, s.start_ms, s.end_ms, e.id % 4 AS mic,
  20 * log10(sqrt(avg(e.value * e.value)) / 1000) AS dbfs FROM seg s JOIN seg e ON e.meeting = s.meeting
  AND e.start_ms >= s.start_ms AND e.start_ms < s.end_ms WHERE s.speaker = 'purchase' GROUP BY ALL),
loud AS (SELECT meeting, id, start_ms, end_ms, mic, dbfs FROM mics
  QUALIFY row_number() OVER (PARTITION BY meeting, id ORDER BY dbfs DESC, mic) = 1)"""


def _loudest(spark, folder):
    s = v.seg(spark, folder)
    samples = s.select("meeting", (F.col("id") % 4).alias("mic"), F.col("start_ms").alias("t_ms"),
                       F.col("value").alias("amplitude"))
    segments = s.filter(F.col("speaker") == "purchase").select("meeting", "id", "start_ms", "end_ms")
    return sm.loudest_mic(samples, segments, ["meeting"], 1000.0)


@query(with_views(v.SEG, LOUD) + "SELECT meeting, id, start_ms, end_ms, mic, round(dbfs, 6) AS dbfs FROM loud")
def loudest_mic(spark, folder):
    return _loudest(spark, folder).withColumn("dbfs", F.round("dbfs", 6))


@query(with_views(v.SEG, LOUD) + """SELECT meeting, any_value(mic) AS mic, min(start_ms) AS start_ms, arg_max(end_ms, start_ms) AS end_ms,
  count(*) AS pieces FROM (SELECT *, sum(chg) OVER (PARTITION BY meeting ORDER BY start_ms) AS run FROM (
    SELECT *, (mic IS DISTINCT FROM lag(mic) OVER (PARTITION BY meeting ORDER BY start_ms))::INT AS chg FROM loud))
  GROUP BY meeting, run""")
def speaker_by_loudness(spark, folder):
    loud = cut_lineage(_loudest(spark, folder)).withColumn("begin", F.col("start_ms"))  # looked at for its counts, then swept
    return iv.merge_runs(loud, ["meeting"], "begin", "mic").drop("run")


@query(with_views(v.UTT, v.FRM) + """, j AS (SELECT f.meeting, f.person, f.frame, u.speaker, f.mouth FROM frm f JOIN utt u
  ON u.meeting = f.meeting AND f.time_ms >= u.start_ms AND f.time_ms < u.end_ms WHERE f.mouth <> 0),
m AS (SELECT * FROM (SELECT *, lag(mouth) OVER (PARTITION BY meeting, person ORDER BY frame) AS was FROM j)
  WHERE was IS NULL OR was <> mouth),
z AS (SELECT m.*, (mouth - avg(mouth) OVER p) / nullif(stddev_samp(mouth) OVER p, 0) AS z FROM m WINDOW p AS (PARTITION BY meeting, person)),
d AS (SELECT *, abs(z - lag(z) OVER (PARTITION BY meeting, person, speaker ORDER BY frame)) AS step FROM z),
c AS (SELECT meeting, person, speaker, avg(z) AS mean, avg(step) AS step FROM d GROUP BY ALL),
s AS (SELECT *, step * mean / nullif(max(mean) OVER (PARTITION BY meeting, person), 0) AS score FROM c),
b AS (SELECT meeting, speaker, max(score) AS score, arg_max(person, (score, -person)) FILTER (score IS NOT NULL) AS face FROM s GROUP BY ALL)
SELECT meeting, speaker, round(score, 6) AS score, CASE WHEN score >= 0 THEN face ELSE -1 END AS face FROM b""")
def face_of_speaker(spark, folder):
    frames = v.frm(spark, folder, "meeting", "mouth").drop("event_id")
    segments = v.utt(spark, folder).select("meeting", "speaker", "start_ms", "end_ms")
    return sm.match_faces(frames, segments, MINUTE).withColumn("score", F.round("score", 6))


@query(with_views(v.FRM) + "SELECT person, frame, time_ms / 1000 AS time_s FROM frm WHERE gesture = 1")
def gesture_points(spark, folder):
    f = v.frm(spark, folder, "gesture").filter("gesture = 1")
    return f.select("person", "frame", (F.col("time_ms") / 1000).alias("time_s"))


@query(with_views(v.FRM, v.LAB) + """SELECT f.person, f.frame, f.event_id, f.time_ms, l.label FROM frm f JOIN (
  SELECT person, label, row_number() OVER (PARTITION BY person ORDER BY t, event_id) - 1 AS frame FROM lab) l
  ON l.person = f.person AND l.frame * 333 = f.time_ms""")
def frame_label_join(spark, folder):
    dense = iv.numbered(v.lab(spark, folder), ["person"], ["t", "event_id"], "n")
    dense = dense.select("person", "label", (F.col("n") * 333).alias("time_ms"))
    return v.frm(spark, folder).join(dense, ["person", "time_ms"]).select("person", "frame", "event_id", "time_ms", "label")


@query(with_views(v.FRM) + """, k AS (SELECT * FROM frm WHERE frame % 3 = 0)
SELECT f.person, f.frame, k.prediction, k.gesture, k.x, k.y FROM frm f JOIN k ON k.person = f.person
  AND k.frame = f.frame - f.frame % 3""")
def sampled_row_lookup(spark, folder):
    kept = v.frm(spark, folder, "prediction", "gesture", "x", "y").filter("frame % 3 = 0")
    # The sampling step is the difference of the first two kept frames of a person.
    step = (kept.select("person", "frame").filter("frame > 0").groupBy("person").agg(F.min("frame").alias("k")))
    grid = salted_join(v.frm(spark, folder), step, ["person"], "left")
    keyed = grid.withColumn("_at", F.col("frame") - F.coalesce(F.col("frame") % F.col("k"), F.col("frame")))
    return (keyed.join(kept.withColumnRenamed("frame", "_at").drop("event_id", "time_ms"), ["person", "_at"])
            .select("person", "frame", "prediction", "gesture", "x", "y"))


@query(with_views(v.UTT, v.FRM) + """SELECT f.person, f.frame, coalesce(u.speaker, -1) AS speaker FROM frm f LEFT JOIN utt u
  ON u.meeting = f.meeting AND f.time_ms >= u.start_ms AND f.time_ms < u.end_ms""")
def speaker_at_time(spark, folder):
    found = iv.points_in_intervals(v.frm(spark, folder, "meeting").drop("event_id"),
                                   v.utt(spark, folder).select("meeting", "speaker", "start_ms", "end_ms"),
                                   ["meeting"], "time_ms", MINUTE, how="left")
    return found.select("person", "frame", F.coalesce("speaker", F.lit(-1)).alias("speaker"))


@query(with_views(v.FRM) + """SELECT person, frame, mouth FROM frm WHERE frame % 3 = 0""")
def frame_sampling(spark, folder):
    return v.frm(spark, folder, "mouth").filter(F.col("frame") % 3 == 0).select("person", "frame", "mouth")


@query(with_views(v.FRM) + """SELECT person, frame, floor(frame * 1000 / 29.97)::BIGINT AS ms, floor(time_ms * 29.97 / 1000)::BIGINT AS back
  FROM frm WHERE abs(floor(time_ms * 29.97 / 1000) - 600) <= 300""")
def near_time(spark, folder):
    from ..functions.times import frame_to_ms, ms_to_frame

    f = v.frm(spark, folder)
    near = f.filter(F.abs(ms_to_frame(F.col("time_ms"), 29.97) - 600) <= 300)
    return near.select("person", "frame", frame_to_ms(F.col("frame"), 29.97).alias("ms"),
                       ms_to_frame(F.col("time_ms"), 29.97).alias("back"))


@query(with_views(v.UTT) + """SELECT meeting, speaker, string_agg(ord::VARCHAR || ':' || length(text), '; ' ORDER BY ord) AS joined
  FROM utt GROUP BY ALL""")
def joined_segments(spark, folder):
    from ..operators.words import joined_texts

    u = v.utt(spark, folder, text=True).withColumn("piece", F.concat(F.col("ord").cast("string"), F.lit(":"), F.length("text").cast("string")))
    return joined_texts(u, ["meeting", "speaker"], "ord", "piece", "joined")
