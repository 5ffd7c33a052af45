"""Face-vector, scoring and order-dependent queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import texts, vectors as vx
from ..functions.permute import drawn_sql, permuted_sql
from ..operators import faces as fc, replay as rp, scoring as sc
from ..operators.clustering import kmeans, spectral
from ..operators.intervals import label_slices, numbered
from ..operators.series import along
from ..operators.skew import lookup_join
from ..session import cut_lineage
from . import segments as sg, views as v
from .registry import query
from .views import with_views

M = ["meeting"]
THRESHOLD = 1.3  # the driver vectors lie 1.0 to 1.4 apart; face encodings use 0.35
CHUNK = 1000  # frames compared by one task


@query(with_views(v.VEC) + "SELECT meeting, frame, count(*) AS faces, string_agg(vec::VARCHAR, ',' ORDER BY slot) AS found FROM vec GROUP BY ALL")
def frame_faces(spark, folder):
    f = fc.faces_per_frame(v.vec(spark, folder), M)
    return f.select("meeting", "frame", "faces", F.concat_ws(",", F.transform("found", lambda e: e["vec"].cast("string"))).alias("found"))


@query(with_views(v.VEC) + "SELECT meeting, max(n) AS persons FROM (SELECT meeting, frame, count(*) AS n FROM vec GROUP BY ALL) GROUP BY meeting")
def most_faces(spark, folder):
    return fc.most_faces(v.vec(spark, folder), M)


@query(with_views(v.VEC) + """SELECT vec, round(sqrt(list_sum([x*x FOR x IN encoding])), 6) AS norm, round(list_avg(encoding), 6) AS mean,
  round(list_distance(encoding, [0.1 FOR x IN encoding]), 6) AS distance FROM vec""")
def vector_measures(spark, folder):
    flat = F.transform("encoding", lambda x: F.lit(0.1))
    return v.vec(spark, folder).select("vec", F.round(vx.norm(F.col("encoding")), 6).alias("norm"),
                                       F.round(vx.mean(F.col("encoding")), 6).alias("mean"),
                                       F.round(vx.distance(F.col("encoding"), flat), 6).alias("distance"))


# Person p stands where slots p and p + 1 are seen; faces lie 200 pixels apart.
GALLERY = """gal AS (SELECT meeting, person, frame, min(vec) AS sample, arg_min(encoding, vec) AS encoding
  FROM vec, (SELECT unnest(range(4))::INT AS person) WHERE time_ms < 30000 AND slot*200 + 100 >= person*200 AND slot*200 + 100 < person*200 + 400
  GROUP BY ALL)"""


def _gallery(spark, folder):
    seen = v.vec(spark, folder).withColumn("face_x", F.col("slot") * 200 + 100)
    rois = (seen.select("meeting").distinct().withColumn("person", F.explode(F.array(*[F.lit(p) for p in range(4)])))
            .withColumns({"roi_from": F.col("person") * 200, "roi_to": F.col("person") * 200 + 400}))
    return fc.reference_faces(seen, rois, M)


@query(with_views(v.VEC, GALLERY) + "SELECT meeting, person, frame, sample, round(encoding[1], 6) AS first FROM gal")
def reference_faces(spark, folder):
    return _gallery(spark, folder).select("meeting", "person", "frame", "sample", F.round(F.col("encoding")[0], 6).alias("first"))


NEAR = """near AS (SELECT q.meeting, q.frame, q.vec, g.person, min(list_distance(q.encoding, g.encoding)) AS distance
  FROM vec q JOIN gal g ON g.meeting = q.meeting GROUP BY ALL)"""


@query(with_views(v.VEC, GALLERY, NEAR) + "SELECT meeting, frame, vec, person, round(distance, 6) AS distance FROM near")
def person_distances(spark, folder):
    d = fc.person_distances(v.vec(spark, folder), _gallery(spark, folder), M, CHUNK)
    return d.withColumn("distance", F.round("distance", 6))


@query(with_views(v.VEC, GALLERY, NEAR) + f""", claim AS (SELECT * FROM near WHERE distance <= {THRESHOLD}
  QUALIFY row_number() OVER (PARTITION BY meeting, frame, person ORDER BY distance, vec) = 1)
SELECT meeting, frame, vec, max(person) AS person, round(arg_max(distance, person), 6) AS distance FROM claim GROUP BY ALL""")
def gallery_match(spark, folder):
    found = fc.gallery_match(v.vec(spark, folder), _gallery(spark, folder), M, THRESHOLD, CHUNK)
    return found.withColumn("distance", F.round("distance", 6))


DENSE = """dense AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY meeting, frame) AS faces FROM vec) WHERE faces <= 5
  QUALIFY row_number() OVER (PARTITION BY meeting ORDER BY faces DESC, frame, vec) <= 120)"""


@query(with_views(v.VEC, DENSE) + "SELECT meeting, frame, vec, faces FROM dense")
def densest_faces(spark, folder):
    return fc.densest_faces(v.vec(spark, folder), M, 5, 120).select("meeting", "frame", "vec", "faces")


@query(with_views(v.VEC) + """, c AS (SELECT label, i, avg(encoding[i]) AS m FROM vec, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL),
cc AS (SELECT label, list(m ORDER BY i) AS centre FROM c GROUP BY label)
SELECT cc.label::VARCHAR AS name, arg_min(vec, (list_distance(encoding, centre), vec)) AS nearest, round(min(list_distance(encoding, centre)), 6) AS distance
FROM vec, cc GROUP BY cc.label""")
def nearest_to_centre(spark, folder):
    data = v.vec(spark, folder)
    targets = fc.centres(data, ["label"]).withColumnRenamed("label", "name")
    return fc.nearest_to(data, targets).withColumn("distance", F.round("distance", 6))


@query("""SELECT event_id, list_position(d, list_min(d)) - 1 AS view_id FROM (SELECT event_id, [
  pow(value/500, 2) + pow(event_id % 10 / 10, 2) + pow(value % 1, 2), pow(value/500 - 0.5, 2) + pow(event_id % 10 / 10, 2) + pow(value % 1, 2),
  pow(value/500, 2) + pow(event_id % 10 / 10 - 0.7, 2) + pow(value % 1 - 0.5, 2)] AS d FROM events)""")
def nearest_orientation(spark, folder):
    e = v.table(spark, folder, "events")
    pose = F.array(F.col("value") / 500, F.col("event_id") % 10 / 10, F.col("value") % 1)
    return e.select("event_id", fc.nearest_orientation(pose, [[0, 0, 0], [0.5, 0, 0], [0, 0.7, 0.5]]).alias("view_id"))


@query(with_views(v.VEC) + """SELECT a.meeting, a.label AS speaker1, b.label AS speaker2, round(sqrt(avg(pow(list_distance(a.encoding, b.encoding), 2))), 6) AS distance
  FROM vec a JOIN vec b ON a.meeting = b.meeting AND a.label <= b.label GROUP BY ALL""")
def speaker_distances(spark, folder):
    d = fc.speaker_distances(v.vec(spark, folder), M, "label")
    return d.withColumn("distance", F.round("distance", 6))


@query()
def face_clusters(spark, folder):
    """Faces named by the clusters of all vectors of their recording."""
    data = v.vec(spark, folder)
    clustered = fc.cluster_faces(data, M).withColumnRenamed("vec", "sample")
    return fc.gallery_match(data, clustered, M, THRESHOLD, CHUNK).withColumn("distance", F.round("distance", 6))


@query(with_views(v.VEC) + """, most AS (SELECT meeting, max(n) AS persons FROM (SELECT meeting, frame, count(*) AS n FROM vec GROUP BY ALL) GROUP BY meeting)
SELECT meeting, count(*) AS vectors, count(*) AS labelled, any_value(persons)::BIGINT AS clusters, true AS at_nearest, true AS at_mean FROM vec JOIN most USING (meeting) GROUP BY meeting""")
def face_cluster_check(spark, folder):
    """What k-means must keep: every vector has a cluster, its centre is the nearest one, and centres are their rows' means."""
    data = v.vec(spark, folder)
    found, centre = kmeans(data, M, "vec", "encoding", fc.most_faces(data, M).withColumnRenamed("persons", "wanted"), rounds=100)
    every = centre.groupBy("meeting").agg(F.collect_list(F.struct("cluster", "centre")).alias("centres"))  # a few centres a meeting
    gap = F.array_min(F.transform("centres", lambda c: vx.distance(F.col("encoding"), c["centre"])))
    rows = lookup_join(data.join(found, ["meeting", "vec"]), every, M)
    near = rows.groupBy("meeting").agg(F.count(F.lit(1)).alias("vectors"), F.count("cluster").alias("labelled"),
                                       F.countDistinct("cluster").alias("clusters"), F.max(F.abs(F.col("distance") - gap) < 1e-9).alias("at_nearest"),
                                       F.min(F.abs(F.col("distance") - gap) < 1e-9).alias("_all"))
    means = fc.centres(rows, ["meeting", "cluster"]).withColumnRenamed("centre", "mean").join(centre, ["meeting", "cluster"])
    off = means.groupBy("meeting").agg((F.max(vx.distance(F.col("mean"), F.col("centre"))) < 1e-6).alias("at_mean"))
    return near.join(off, "meeting").select("meeting", "vectors", "labelled", "clusters", (F.col("at_nearest") & F.col("_all")).alias("at_nearest"), "at_mean")


@query()
def identity_tracks(spark, folder):
    data = v.vec(spark, folder).withColumns({"cx": F.col("slot") * 10.0, "cy": F.col("label") * 1.0})
    return rp.track_identities(data, M, box_reach=20.0, face_reach=THRESHOLD)


@query()
def speaker_clusters(spark, folder):
    """Time slices of the speakers of one long recording, their number unknown."""
    data = v.vec(spark, folder).select(F.lit(0).alias("recording"), "vec", "encoding")
    labelled = spectral(data, ["recording"], "vec", "encoding", least=2)
    return label_slices(labelled, ["recording"], "vec", "speaker", sg.SLICE_MS)


@query(with_views(v.VEC) + """SELECT meeting, vec, min(vec) OVER (PARTITION BY meeting, label) AS first, (SELECT count(DISTINCT label) FROM vec w
  WHERE w.meeting = vec.meeting)::INT AS speakers FROM vec""")
def planted_speakers(spark, folder):
    """Speakers planted in the recordings (a voice of their own under each vector as noise) are found without their number."""
    voice = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.when(i == F.col("label"), 1.0).otherwise(0.0))
    data = v.vec(spark, folder).select("meeting", "vec", F.concat(voice, F.transform("encoding", lambda x: x * 0.1)).alias("window"))
    found = cut_lineage(spectral(data, M, "vec", "window"))
    first = found.groupBy("meeting", "speaker").agg(F.min("vec").alias("first"))
    return lookup_join(found, first, ["meeting", "speaker"]).select("meeting", "vec", "first", F.col("clusters").alias("speakers"))


# --- scores ------------------------------------------------------------------------------------------------------

@query(with_views(v.FRM) + """, c AS (SELECT person, count(*) FILTER (truth AND pred) AS tp, count(*) FILTER (NOT truth AND pred) AS fp,
  count(*) FILTER (truth AND NOT pred) AS fn, count(*) FILTER (NOT truth AND NOT pred) AS tn
  FROM (SELECT person, gesture = 1 AS truth, x > 40 AS pred FROM frm) GROUP BY person)
SELECT *, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
  round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall FROM c""")
def classification_report(spark, folder):
    e = v.table(spark, folder, "events").select(
        F.col("user_id").alias("person"), (F.col("value") > 50).cast("int").alias("truth"),
        (F.floor("value") % 640 > 40).cast("int").alias("pred"))
    r = sc.classification_report(e, "truth", "pred", ["person"])
    return r.withColumns({c: F.round(c, 6) for c in ("accuracy", "precision", "recall")})


@query(with_views(v.UTT) + """, perm(a, b, c) AS (VALUES (0,1,2),(0,2,1),(1,0,2),(1,2,0),(2,0,1),(2,1,0)),
hits AS (SELECT meeting, a, b, c, count(*) FILTER (ord % 3 = CASE speaker WHEN 0 THEN a WHEN 1 THEN b ELSE c END) AS n, count(*) AS length
  FROM utt, perm GROUP BY ALL)
SELECT meeting, round(max(n) / any_value(length), 6) AS accuracy, any_value(length) AS length FROM hits GROUP BY meeting""")
def sequence_match(spark, folder):
    u = v.table(spark, folder, "conversations").select(
        F.col("conv_id").alias("meeting"), F.col("turn").alias("ord"),
        F.expr("CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END").alias("speaker"))
    both = sc.aligned(u, u.withColumn("speaker", (F.col("ord") % 3).cast("int")), M, "ord", "speaker")
    return sc.sequence_match(both, M, "label1", "label2").withColumn("accuracy", F.round("accuracy", 6))


BIAS = """bias AS (SELECT person, (count(*) FILTER (label <> was) + 1) / count(*) AS bias, count(*) AS length FROM (
  SELECT *, lag(label) OVER (PARTITION BY person ORDER BY t, event_id) AS was FROM lab) GROUP BY person)"""


def _bias(spark, folder):
    n = numbered(v.lab(spark, folder), ["person"], ["t", "event_id"], "pos")
    return sc.transition_bias(n, ["person"], "pos", "label")


@query(with_views(v.LAB, BIAS) + "SELECT person, round(bias, 6) AS bias, length FROM bias")
def transition_bias(spark, folder):
    return _bias(spark, folder).withColumn("bias", F.round("bias", 6))


@query(with_views(v.LAB, BIAS) + "SELECT round(sum(bias * length) / sum(length), 6) AS bias, sum(length)::BIGINT AS length FROM bias")
def merged_bias(spark, folder):
    return sc.merged_bias(_bias(spark, folder)).withColumn("bias", F.round("bias", 6))


@query(with_views(v.VEC) + """, r AS (SELECT slot, -encoding[1] AS s, sum((label = slot)::INT) AS p, sum((label <> slot)::INT) AS q FROM vec GROUP BY ALL),
roc AS (SELECT slot, s, sum(p) OVER w / sum(p) OVER (PARTITION BY slot) AS tpr, sum(q) OVER w / sum(q) OVER (PARTITION BY slot) AS fpr
  FROM r WINDOW w AS (PARTITION BY slot ORDER BY s)),
b AS (SELECT *, coalesce(lag(tpr) OVER w, 0) AS tpr0, coalesce(lag(fpr) OVER w, 0) AS fpr0, coalesce(lag(s) OVER w, s) AS s0
  FROM roc WINDOW w AS (PARTITION BY slot ORDER BY s)),
k AS (SELECT *, (1 - fpr0 - tpr0) / ((1 - fpr0 - tpr0) - (1 - fpr - tpr)) AS part FROM b WHERE 1 - fpr0 - tpr0 > 0 AND 1 - fpr - tpr <= 0)
SELECT slot, round(fpr0 + part*(fpr - fpr0), 6) AS eer, round(-(s0 + part*(s - s0)), 6) AS threshold FROM k""")
def equal_error_rate(spark, folder):
    scored = v.vec(spark, folder).select("slot", (F.col("label") == F.col("slot")).cast("int").alias("truth"), F.col("encoding")[0].alias("score"))
    e = sc.equal_error_rate(scored, ["slot"], "truth", "score")
    return e.withColumns({c: F.round(c, 6) for c in ("eer", "threshold")})


def _transcripts(spark, folder):
    u = v.table(spark, folder, "conversations").select(F.col("conv_id").alias("meeting"), F.col("turn").alias("ord"),
                                                       texts.words(texts.without_marks(F.col("text"), ";?")).alias("answer"))
    return (along(u, M, ["ord"], lead={"heard": F.col("answer")})
            .filter(F.col("heard").isNotNull() & (F.size("answer") > 0)))


WORDS = """w AS (SELECT conv_id AS meeting, turn AS ord, regexp_extract_all(lower(translate(text, ';?', '')), '[a-zà-ÿ]+') AS answer FROM conversations),
pair AS (SELECT * FROM (SELECT *, lead(answer) OVER (PARTITION BY meeting ORDER BY ord) AS heard FROM w) WHERE heard IS NOT NULL AND len(answer) > 0)"""
# One row of the distance matrix per step: a list folded from left to right, insertions along the row.
DISTANCE = """dist AS (SELECT meeting, ord, len(answer) AS words, list_reduce(answer, lambda prev, word:
    list_reduce(range(1, len(heard) + 1), lambda cur, j: list_append(cur, least(cur[j] + 1, prev[j + 1] + 1, prev[j] + (heard[j] <> word)::BIGINT)),
      [prev[1] + 1]), range(0, len(heard) + 1))[-1] AS distance FROM pair)"""


@query(with_views(WORDS, DISTANCE) + "SELECT meeting, ord, words, distance, round(distance / words, 6) AS wer FROM dist")
def word_error_rate(spark, folder):
    p = _transcripts(spark, folder).withColumn("distance", sc.word_distance(F.col("answer"), F.col("heard")).cast("long"))
    return p.select("meeting", "ord", F.size("answer").cast("long").alias("words"), "distance",
                    F.round(F.col("distance") / F.size("answer"), 6).alias("wer"))


@query()
def transcript_errors(spark, folder):
    scored = sc.transcript_errors(_transcripts(spark, folder), "answer", "heard")
    return scored.select("meeting", "ord", "ins", "del", "sub", "correct", "words", F.round("wer", 6).alias("wer"))


@query("""SELECT doc_id, translate(translate(text, ';?', ''), ' ', '') AS cleaned FROM documents""")
def cleaned_transcript(spark, folder):
    d = v.table(spark, folder, "documents")
    return d.select("doc_id", texts.without_marks(F.col("text"), "; ?").alias("cleaned"))


# --- training sequences -------------------------------------------------------------------------------------------

SEQ = "seq AS (SELECT meeting AS sequence_id, vec % 200 AS pos, label AS cluster_id, encoding AS embedding FROM vec)"


def _sequences(spark, folder):
    return v.vec(spark, folder).select(F.col("meeting").alias("sequence_id"), (F.col("vec") % 200).alias("pos"),
                                       F.col("label").alias("cluster_id"), F.col("encoding").alias("embedding"))


@query(with_views(v.VEC, SEQ) + """SELECT row_number() OVER (ORDER BY sequence_id, pos) - 1 AS place, sequence_id || '_' || cluster_id AS cluster_id,
  round(embedding[1], 6) AS first FROM seq""")
def training_sequence(spark, folder):
    a = sc.assembled(_sequences(spark, folder))
    return a.select("place", "cluster_id", F.round(F.col("embedding")[0], 6).alias("first"))


SHUFFLED = ("base AS (SELECT sequence_id, n, row_number() OVER (ORDER BY sequence_id) - 1 AS no, count(*) OVER () AS many FROM"
            " (SELECT sequence_id, count(*) AS n FROM seq GROUP BY sequence_id))", permuted_sql("base", "no", "many", 7))


@query(with_views(v.VEC, SEQ, *SHUFFLED, recursive=True) + """, laid AS (SELECT sequence_id, (sum(n) OVER (ORDER BY place) - n)::BIGINT AS base FROM perm)
SELECT base + pos AS place, sequence_id || '_' || cluster_id AS cluster_id, round(embedding[1], 6) AS first FROM seq JOIN laid USING (sequence_id)""")
def shuffled_training_sequence(spark, folder):
    return sc.assembled(_sequences(spark, folder), seed=7).select("place", "cluster_id", F.round(F.col("embedding")[0], 6).alias("first"))


@query(with_views(v.VEC, SEQ) + """SELECT sequence_id, pos, cluster_id, row_number() OVER (PARTITION BY sequence_id, cluster_id ORDER BY pos) - 1 AS place,
  count(*) OVER (PARTITION BY sequence_id, cluster_id) + 1 AS length FROM seq""")
def regrouped_sequence(spark, folder):
    return sc.regrouped(_sequences(spark, folder).drop("embedding"), ["sequence_id"], "pos", "cluster_id")


MIXES = (f"""sized AS (SELECT sample, least(10 + {drawn_sql('sample', 10, 7)}, many) AS size, many FROM
  (SELECT unnest(range(50))::BIGINT AS sample), (SELECT count(*) AS many FROM events)),
base AS (SELECT sample, unnest(range(size)) AS slot, many FROM sized)""", permuted_sql("base", "slot", "many", 7, "sample"))


@query(with_views(*MIXES, recursive=True) + """SELECT sample, slot::INT AS slot, event_id FROM perm
  JOIN (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS place FROM events) USING (place)""")
def random_mixes(spark, folder):
    items = v.table(spark, folder, "events").select("event_id")
    return sc.random_mixes(items, "event_id", 50, 7)


# --- order-dependent jobs -------------------------------------------------------------------------------------------

NOD = """pts AS (SELECT person, frame, x, y, row_number() OVER (PARTITION BY person ORDER BY frame) AS n FROM frm WHERE frame % 3 = 0),
st AS (SELECT person, n, frame, x, y, 0::BIGINT AS mx, 0::DOUBLE AS my, 0 AS gesture, 15 AS hold FROM pts WHERE n = 1
  UNION ALL
  SELECT person, n, frame, x, y, mx, CASE WHEN hit THEN 0 ELSE my2 END AS my,
    CASE WHEN hold3 <= 0 THEN 0 ELSE gesture2 END AS gesture, hold3 AS hold FROM (
    SELECT *, CASE WHEN gesture2 = 1 AND hold2 > 0 THEN hold2 - 3 ELSE hold2 END AS hold3 FROM (
      SELECT *, CASE WHEN hit THEN 1 ELSE gesture END AS gesture2, CASE WHEN hit THEN 15 ELSE hold END AS hold2 FROM (
        SELECT *, my2 > 20 AS hit FROM (
          SELECT p.person, p.n, p.frame, p.x, p.y, greatest(0, s.mx + abs(s.x - p.x) - 8)::BIGINT AS mx,
            CASE WHEN trunc(s.my + abs(s.y - p.y) - 8) > 0 THEN trunc(s.my + abs(s.y - p.y) - 8) + 4 ELSE 0 END::DOUBLE AS my2,
            s.gesture, s.hold FROM st s JOIN pts p ON p.person = s.person AND p.n = s.n + 1)))))"""


def _points(spark, folder):
    return v.frm(spark, folder, "x", "y").select("person", "frame", "x", "y", F.lit(100).alias("height"))


@query(with_views(v.FRM, NOD, recursive=True) + "SELECT person, frame, mx AS x_movement, my AS y_movement, gesture FROM st")
def nod_detection(spark, folder):
    return rp.detect_nods(_points(spark, folder), ["person"])


OLDER = """st AS (SELECT person, frame, x, y, 0::BIGINT AS mx, 0::DOUBLE AS my, 0 AS gesture, 30 AS hold FROM frm WHERE frame = 0
  UNION ALL
  SELECT person, frame, x, y, mx, CASE WHEN hit THEN 0 ELSE my2 END AS my, CASE WHEN hold3 <= 0 THEN 0 ELSE gesture2 END AS gesture, hold3 AS hold FROM (
    SELECT *, CASE WHEN gesture2 = 1 AND hold2 > 0 THEN hold2 - 1 ELSE hold2 END AS hold3 FROM (
      SELECT *, CASE WHEN hit THEN 1 ELSE gesture END AS gesture2, CASE WHEN hit THEN 30 ELSE hold END AS hold2 FROM (
        SELECT *, my2 > 20 AS hit FROM (
          SELECT p.person, p.frame, p.x, p.y, greatest(0, s.mx + abs(s.x - p.x) - 5)::BIGINT AS mx,
            greatest(0, trunc(s.my + abs(s.y - p.y) - 5))::DOUBLE AS my2, s.gesture, s.hold
          FROM st s JOIN frm p ON p.person = s.person AND p.frame = s.frame + 1)))))"""


@query(with_views(v.FRM, OLDER, recursive=True) + "SELECT person, frame, mx AS x_movement, my AS y_movement, gesture FROM st")
def nod_detection_older(spark, folder):
    return rp.detect_nods(_points(spark, folder), ["person"], k=1, older=True)


HIST = """h AS (SELECT person, frame, mouth, frame % 2 = 0 AS looked, frame % 2 = 0 AND event_id % 3 <> 0 AS used,
  greatest(0, least(49, trunc((mouth - 0) * 50 / 500)))::INT AS bin FROM frm),
c AS (SELECT a.person, a.frame, a.mouth, b.bin, count(*) OVER (PARTITION BY a.person, a.frame ORDER BY b.bin) AS upto,
  count(b.bin) OVER (PARTITION BY a.person, a.frame) AS n FROM h a LEFT JOIN h b ON b.person = a.person AND b.used AND b.frame <= a.frame WHERE a.looked),
med AS (SELECT person, frame, CASE max(n) WHEN 0 THEN 5 WHEN 1 THEN any_value(mouth)
  ELSE min(bin) FILTER (upto >= (n + 1) // 2) * 10 + 5 END AS median FROM c GROUP BY person, frame)"""


@query(with_views(v.FRM, HIST) + """SELECT h.person, h.frame, round(med.median, 6)::DOUBLE AS median FROM h JOIN med
  ON med.person = h.person AND med.frame = h.frame - h.frame % 2""")
def running_median(spark, folder):
    f = v.frm(spark, folder, "mouth").withColumn("success", F.col("event_id") % 3 != 0)
    m = rp.running_median(f, ["person"], "frame", "mouth", "success", 50, 0.0, 500.0)
    return m.withColumn("median", F.round("median", 6))


FIX = """au AS (SELECT person, frame, mouth/50 - 1 AS au, greatest(0, least(199, trunc((mouth/50 - 1 + 3) * 200 / 8.0)))::INT AS bin FROM frm),
q AS (SELECT a.person, a.frame, a.au, b.bin, count(*) OVER (PARTITION BY a.person, a.frame ORDER BY b.bin) AS upto,
  count(*) OVER (PARTITION BY a.person, a.frame) AS n FROM au a JOIN au b ON b.person = a.person AND b.frame <= a.frame),
lift AS (SELECT person, frame, any_value(au) AS au, CASE WHEN max(n) >= 10 THEN -3 + min(bin) FILTER (upto > trunc(0.10 * n)) * (8.0/200) ELSE 0 END AS lift
  FROM q GROUP BY person, frame)"""


def _units(spark, folder):
    return v.frm(spark, folder, "mouth").select("person", "frame", (F.col("mouth") / 50 - 1).alias("au"))


@query(with_views(v.FRM, FIX) + "SELECT person, frame, round(greatest(least(au - lift, 5), 0), 6)::DOUBLE AS corrected FROM lift")
def online_correction(spark, folder):
    c = rp.online_correction(_units(spark, folder), ["person"], "frame", "au")
    return c.withColumn("corrected", F.round("corrected", 6))


@query(with_views(v.FRM, FIX) + """, s AS (SELECT *, au - lift AS p FROM lift),
t AS (SELECT *, least(5, min(CASE WHEN p > 1 THEN 5 / p END) OVER (PARTITION BY person ORDER BY frame)) AS k FROM s)
SELECT person, frame, round(greatest(least(CASE WHEN p > 1 THEN p * k ELSE p END, 5), 0), 6)::DOUBLE AS corrected FROM t""")
def online_correction_scaled(spark, folder):
    c = rp.online_correction(_units(spark, folder), ["person"], "frame", "au", scale=True)
    return c.withColumn("corrected", F.round("corrected", 6))


MERGE = """sp AS (SELECT meeting, coalesce(lag(mid) OVER w, 0)::DOUBLE AS s, mid::DOUBLE AS e, row_number() OVER w AS n FROM (
    SELECT meeting, start_ms + (end_ms - start_ms)/2.0 AS mid FROM timeline WHERE kind = 'silence'
    UNION ALL SELECT meeting, duration_ms FROM bound) WINDOW w AS (PARTITION BY meeting ORDER BY mid)),
mg AS (SELECT meeting, n, s, e, 0 AS piece, false AS took FROM sp WHERE n = 1 UNION ALL
  SELECT meeting, n, CASE WHEN joins THEN s0 ELSE s1 END, e1, CASE WHEN joins THEN piece ELSE piece + 1 END, joins FROM (
    SELECT p.meeting, p.n, m.s AS s0, p.s AS s1, p.e AS e1, m.piece, (p.e - m.s <= 7200000 OR m.e = m.s OR p.e = p.s)
      AND NOT (m.piece = 0 AND m.took) AS joins FROM mg m JOIN sp p ON p.meeting = m.meeting AND p.n = m.n + 1))"""


@query(with_views(v.SEG, sg.COVER, sg.QUIET, MERGE, recursive=True) + """SELECT meeting, start_ms, end_ms, splits FROM (
  SELECT meeting, piece, min(s) AS start_ms, max(e) AS end_ms, count(*) AS splits FROM mg GROUP BY ALL)""")
def greedy_merge(spark, folder):
    from ..operators.intervals import midpoint_splits

    splits = midpoint_splits(sg._timeline(spark, folder), M)
    return rp.merge_splits(splits, M, 7_200_000.0, 7 * sg.DAY_MS)


@query("""SELECT meeting, t_ms, greatest(-1000, least(1000, sum(amplitude))) AS amplitude FROM (
  SELECT user_id % 10 AS meeting, event_id % 4 AS mic, epoch_us(ts) // 60000000 AS t_ms, floor(value)::BIGINT AS amplitude FROM events) e
  WHERE t_ms <= (SELECT max(epoch_us(ts) // 60000000) FROM events f WHERE f.user_id % 10 = e.meeting AND f.event_id % 4 = 0)
  GROUP BY meeting, t_ms""".replace("sum(amplitude))) AS", "sum(amplitude)))::BIGINT AS"))
def mixed_track(spark, folder):
    from ..operators.audio import mixed

    e = v.seg(spark, folder)
    samples = e.select("meeting", (F.col("id") % 4).alias("mic"), F.floor(F.col("start_ms") / 60_000).cast("long").alias("t_ms"),
                       F.floor("value").cast("long").alias("amplitude"))
    return mixed(samples, M, 1000)
