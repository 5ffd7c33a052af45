"""Frame-series queries: filters, windows, smoothing, tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import faces
from ..functions.permute import permuted_sql
from ..operators import features as ft
from ..operators.intervals import numbered
from ..operators.series import along
from . import views as v
from .registry import query
from .views import with_views

P = ["person"]
POSE = """pose AS (SELECT person, frame, frame*333/1000.0 AS timestamp, (event_id % 10)/10.0 AS confidence, mouth AS rx,
  mouth*mouth/1000 AS ry, ln(1+mouth) AS rz, x, y, y + 40 + event_id % 7 AS chin, gesture FROM frm),
kept AS (SELECT *, row_number() OVER (PARTITION BY person ORDER BY frame) - 1 AS pos, count(*) OVER (PARTITION BY person) AS n
  FROM pose WHERE NOT (confidence < 0.8) OR confidence IS NULL),
win AS (SELECT k.*, w.win FROM kept k, unnest([k.pos // 16, k.pos // 16 - 1]) AS w(win)
  WHERE w.win >= 0 AND k.pos < w.win*16 + 32 AND w.win < (k.n - 32) // 16)"""
# The driver data has about 66 frames per person, so windows are cut over ten persons together, as one meeting.
MEETING_POSE = """pose AS (SELECT person % 10 AS person, event_id AS frame, event_id*333/1000.0 AS timestamp,
  (event_id % 10)/10.0 AS confidence, mouth AS rx, mouth*mouth/1000 AS ry, ln(1+mouth) AS rz, x, y, y + 40 + event_id % 7 AS chin,
  gesture FROM frm),
kept AS (SELECT *, row_number() OVER (PARTITION BY person ORDER BY frame) - 1 AS pos, count(*) OVER (PARTITION BY person) AS n
  FROM pose WHERE NOT (confidence < 0.8) OR confidence IS NULL),
win AS (SELECT k.*, w.win FROM kept k, unnest([k.pos // 16, k.pos // 16 - 1]) AS w(win)
  WHERE w.win >= 0 AND k.pos < w.win*16 + 32 AND w.win < (k.n - 32) // 16)"""


def pose(spark, folder, people=10):
    e = v.table(spark, folder, "events")
    value, ident = F.col("value"), F.col("event_id")
    y = (F.floor(value * 7) % 480).cast("int")
    return e.select((F.col("user_id") % people).alias("person"), ident.alias("frame"), (ident * 333 / 1000).alias("timestamp"),
                    (ident % 10 / 10).alias("confidence"), value.alias("rx"), (value * value / 1000).alias("ry"),
                    F.log1p(value).alias("rz"), (F.floor(value) % 640).cast("int").alias("x"), y.alias("y"),
                    (y + 40 + ident % 7).alias("chin"), (value > 50).cast("int").alias("gesture"))


def pose_windows(spark, folder, *columns, people=10):
    kept = ft.confident(pose(spark, folder, people)).select("person", "frame", *columns)
    return ft.sliding_windows(kept, P, ["frame"])


AXES = {"x": "rx", "y": "ry", "z": "rz"}


def _stats_sql(axis, col):
    m = f"avg({col})"
    return f"""round({m} + 1e-8, 6) AS mean_{axis}, round(stddev_pop({col}) + 1e-8, 6) AS std_{axis}, round(mad({col}) + 1e-8, 6) AS mad_{axis},
  round(max({col}) + 1e-8, 6) AS max_{axis}, round(min({col}) + 1e-8, 6) AS min_{axis}, round(avg({col}*{col}) + 1e-8, 6) AS energy_{axis},
  round(any_value(ent_{axis}) + 1e-8, 6) AS entropy_{axis},
  round(quantile_cont({col}, 0.75) - quantile_cont({col}, 0.25) + 1e-8, 6) AS iqr_{axis}, round(max({col}) - min({col}) + 1e-8, 6) AS range_{axis},
  round(any_value(m3_{axis}) / pow(any_value(m2_{axis}), 1.5) + 1e-8, 6) AS skewness_{axis},
  round(any_value(m4_{axis}) / pow(any_value(m2_{axis}), 2) - 3 + 1e-8, 6) AS kurtosis_{axis}"""


def _moments_sql(axis, col):
    d = f"({col} - avg({col}) OVER w)"
    s = f"({col} - min({col}) OVER w)"
    return f"{d} AS d_{axis}, {s} / nullif(sum({col}) OVER w - count(*) OVER w * min({col}) OVER w, 0) AS p_{axis}"


WINDOW_SQL = f"""m AS (SELECT *, {", ".join(_moments_sql(a, c) for a, c in AXES.items())} FROM win WINDOW w AS (PARTITION BY person, win)),
m2 AS (SELECT *, {", ".join(f"avg(d_{a}*d_{a}) OVER w AS m2_{a}, avg(pow(d_{a},3)) OVER w AS m3_{a}, avg(pow(d_{a},4)) OVER w AS m4_{a}, sum(CASE WHEN p_{a} > 0 THEN -p_{a}*ln(p_{a}) ELSE 0 END) OVER w AS ent_{a}" for a in AXES)}
  FROM m WINDOW w AS (PARTITION BY person, win))"""


@query(with_views(v.FRM, MEETING_POSE, WINDOW_SQL) + f"""SELECT person, win, arg_min(frame, pos) AS frame_in, arg_max(frame, pos) AS frame_out,
  round(arg_min(timestamp, pos), 6)::DOUBLE AS timestamp_in, round(arg_max(timestamp, pos), 6)::DOUBLE AS timestamp_out,
  {", ".join(_stats_sql(a, c) for a, c in AXES.items())} FROM m2 GROUP BY person, win""")
def window_features(spark, folder):
    rows = pose_windows(spark, folder, "timestamp", "rx", "ry", "rz")
    made = ft.window_statistics(rows, P, AXES, "frame", "timestamp")
    doubles = [c for c, t in made.dtypes if t == "double"]
    return made.withColumns({c: F.round(F.col(c) + (0 if c.startswith("time") else 1e-8), 6) for c in doubles})


@query(with_views(v.FRM, MEETING_POSE) + """SELECT person, win, median(x)::DOUBLE AS face_x, median(y)::DOUBLE AS face_y,
  median(abs(chin - y))::DOUBLE AS face_radius FROM win GROUP BY ALL""")
def window_faces(spark, folder):
    return ft.window_faces(pose_windows(spark, folder, "x", "y", "chin"), P, "x", "y", "chin")


@query(with_views(v.FRM, MEETING_POSE) + "SELECT person, win, avg((gesture <> 0)::INT) AS success FROM win GROUP BY ALL")
def window_success(spark, folder):
    return ft.window_success(pose_windows(spark, folder, "gesture"), P, "gesture")


@query(with_views(v.FRM, MEETING_POSE) + """, w AS (SELECT person, win, arg_min(frame, pos) AS fin, arg_max(frame, pos) AS fout, median(x) AS face_x,
  median(y) AS face_y, median(abs(chin - y)) AS face_radius, (avg(rx) > 50)::INT AS pred FROM win GROUP BY ALL),
f AS (SELECT person, win, face_x, face_y, face_radius, pred, unnest(range(fin, fout + 1)) AS frame FROM w),
g AS (SELECT *, row_number() OVER (PARTITION BY person, frame ORDER BY win) AS k FROM f)
SELECT person, frame, trunc(max(face_x) FILTER (k = 1))::BIGINT AS face_x, trunc(max(face_y) FILTER (k = 1))::BIGINT AS face_y,
  trunc(max(face_radius) FILTER (k = 1))::BIGINT AS face_radius, sum(CASE WHEN k = 1 OR pred = 1 THEN pred ELSE 0 END)::BIGINT AS pred,
  sum(CASE WHEN k = 1 OR pred = 1 THEN pred ELSE 0 END) > 1 AS is_nod FROM g GROUP BY ALL""")
def window_votes(spark, folder):
    rows = pose_windows(spark, folder, "x", "y", "chin", "rx")
    w = rows.groupBy("person", "win").agg(
        F.min_by("frame", "_pos").alias("frame_in"), F.max_by("frame", "_pos").alias("frame_out"),
        F.median("x").alias("face_x"), F.median("y").alias("face_y"),
        F.median(F.abs(F.col("chin") - F.col("y"))).alias("face_radius"), (F.avg("rx") > 50).cast("long").alias("pred"))
    return ft.window_votes(w, P)


@query(with_views(v.FRM, POSE) + "SELECT person, frame, confidence FROM kept".replace("confidence FROM", "confidence::DOUBLE AS confidence FROM"))
def confident_rows(spark, folder):
    f = v.frm(spark, folder).withColumn("confidence", F.col("event_id") % 10 / 10)
    return ft.confident(f).select("person", "frame", "confidence")


def _spoiled(spark, folder):
    e = v.table(spark, folder, "events")
    spoiled = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).when(
        F.col("event_id") % 11 == 0, F.lit(float("inf"))).otherwise(F.col("value"))
    return e.select("event_id", "value", spoiled.alias("spoiled"))


@query("SELECT event_id, value, value AS spoiled FROM events WHERE event_id % 7 <> 0 AND event_id % 11 <> 0")
def finite_rows(spark, folder):
    return ft.finite_rows(_spoiled(spark, folder), ["value", "spoiled"])


@query("SELECT event_id, value FROM events")
def finite_columns(spark, folder):
    return ft.finite_columns(_spoiled(spark, folder), ["value", "spoiled"])


@query(with_views(v.FRM) + """SELECT person, frame, mouth FROM (SELECT *, lag(mouth) OVER (PARTITION BY person ORDER BY frame) AS was
  FROM frm WHERE mouth <> 0) WHERE was IS NULL OR was <> mouth""")
def changed_values(spark, folder):
    return ft.changed_values(v.frm(spark, folder, "mouth").select("person", "frame", "mouth"), P, "frame", "mouth")


@query(with_views(v.FRM) + """SELECT person, frame, round((mouth - avg(mouth) OVER w) / stddev_samp(mouth) OVER w, 6) AS z FROM frm
  WINDOW w AS (PARTITION BY person)""")
def standardised(spark, folder):
    return (ft.standardise(v.frm(spark, folder, "mouth"), P, "mouth", "z")
            .select("person", "frame", F.round("z", 6).alias("z")))


@query(with_views(v.FRM) + """SELECT person, frame, lag(x) OVER w - x AS relative_x, abs(lag(x) OVER w - x) AS absolute_x,
  lag(y) OVER w - y AS relative_y, abs(lag(y) OVER w - y) AS absolute_y FROM frm WINDOW w AS (PARTITION BY person ORDER BY frame)""")
def frame_motion(spark, folder):
    f = v.frm(spark, folder, "x", "y").select("person", "frame", "x", "y")
    return ft.motion(f, P, "frame", ["x", "y"]).drop("x", "y")


@query(with_views(v.FRM) + """SELECT person, frame, round(CASE WHEN count(*) OVER w < 3 THEN mouth ELSE (coalesce(lag(mouth) OVER o, 0)
  + mouth + coalesce(lead(mouth) OVER o, 0)) / 3 END, 6) AS smooth FROM frm WINDOW o AS (PARTITION BY person ORDER BY frame),
  w AS (PARTITION BY person ORDER BY frame ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)""")
def moving_average(spark, folder):
    f = v.frm(spark, folder, "mouth").select("person", "frame", "mouth")
    return ft.moving_average(f, P, "frame", "mouth", "smooth").select("person", "frame", F.round("smooth", 6).alias("smooth"))


@query(with_views(v.FRM) + """SELECT person, frame, CASE WHEN count(*) OVER w < 7 THEN gesture WHEN avg(gesture) OVER w < 0.5 THEN 0
  ELSE 1 END AS voted FROM frm WINDOW w AS (PARTITION BY person ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""")
def majority_vote(spark, folder):
    f = v.frm(spark, folder, "gesture").select("person", "frame", "gesture")
    return ft.majority(f, P, "frame", "gesture", "voted").select("person", "frame", "voted")


SHIFT = """au AS (SELECT person, frame, mouth/50 AS au, event_id % 5 <> 0 AS valid FROM frm),
base AS (SELECT person, max(au) FILTER (k = floor(n * 0.3)) AS base FROM (SELECT *, row_number() OVER (PARTITION BY person ORDER BY au) - 1 AS k,
  count(*) OVER (PARTITION BY person) AS n FROM au WHERE valid) GROUP BY person),
shifted AS (SELECT person, frame, CASE WHEN valid THEN greatest(least(au - coalesce(base, 0), 5), 0) ELSE 0 END AS au
  FROM au LEFT JOIN base USING (person))"""


def _shifted(spark, folder):
    au = v.frm(spark, folder, "mouth").select("person", "frame", (F.col("mouth") / 50).alias("raw"),
                                              (F.col("event_id") % 5 != 0).alias("valid"))
    return ft.baseline_shift(au, P, "raw", "valid", 0.3, "au")


@query(with_views(v.FRM, SHIFT) + "SELECT person, frame, round(au, 6) AS au FROM shifted")
def baseline_shift(spark, folder):
    return _shifted(spark, folder).select("person", "frame", F.round("au", 6).alias("au"))


@query(with_views(v.FRM, SHIFT) + """SELECT f.person, f.frame, f.x, f.y, round(CASE WHEN count(*) OVER w < 3 THEN s.au ELSE
  (coalesce(lag(s.au) OVER o, 0) + s.au + coalesce(lead(s.au) OVER o, 0)) / 3 END + 1e-9, 2) AS au FROM frm f JOIN shifted s
  ON s.person = f.person AND s.frame = f.frame WINDOW o AS (PARTITION BY f.person ORDER BY f.frame),
  w AS (PARTITION BY f.person ORDER BY f.frame ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)""")
def overwrite_columns(spark, folder):
    table = v.frm(spark, folder, "x", "y").select("person", "frame", "x", "y")
    corrected = ft.moving_average(_shifted(spark, folder).select("person", "frame", "au"), P, "frame", "au", "smooth")
    return (table.join(corrected.select("person", "frame", "smooth"), ["person", "frame"])
            .select("person", "frame", "x", "y", F.round(F.col("smooth") + 1e-9, 2).alias("au")))


NEAR = """mid AS (SELECT *, (top + bottom)/2.0 AS cy, ("left" + "right")/2.0 AS cx FROM box),
med AS (SELECT person, median(cy) AS my, median(cx) AS mx, max(frame) + 1 AS n FROM mid GROUP BY person),
near AS (SELECT m.person, frame, top, "right", bottom, "left", n FROM mid m JOIN med ON med.person = m.person
  WHERE sqrt((cy - my)*(cy - my) + (cx - mx)*(cx - mx)) < 300.0)"""


def _near(spark, folder):
    middle = ft.median_centres(v.raw_boxes(spark, folder), P)
    return ft.near_median_boxes(v.box(spark, folder), middle, P, 3000.0)


@query(with_views(v.BOX, NEAR) + 'SELECT person, frame, top, "right", bottom, "left" FROM near')
def near_median_boxes(spark, folder):
    return _near(spark, folder)


@query(with_views(v.BOX, NEAR) + """, g AS (SELECT n.*, lead(frame) OVER w AS nf, lag(frame) OVER w AS pf, lead(top) OVER w AS nt, lead("right") OVER w AS nr,
  lead(bottom) OVER w AS nb, lead("left") OVER w AS nl FROM near n WINDOW w AS (PARTITION BY person ORDER BY frame)),
e AS (SELECT *, unnest(range(CASE WHEN pf IS NULL THEN 0 ELSE frame END, coalesce(nf, n))) AS f FROM g WHERE nf IS NOT NULL OR pf IS NOT NULL)
SELECT person, f AS frame, f = frame AS is_detected,
  CASE WHEN f = frame THEN top WHEN f > frame THEN trunc((nt - top)/(nf - frame)::DOUBLE * (f - frame) + top)::INT END AS top,
  CASE WHEN f = frame THEN "right" WHEN f > frame THEN trunc((nr - "right")/(nf - frame)::DOUBLE * (f - frame) + "right")::INT END AS "right",
  CASE WHEN f = frame THEN bottom WHEN f > frame THEN trunc((nb - bottom)/(nf - frame)::DOUBLE * (f - frame) + bottom)::INT END AS bottom,
  CASE WHEN f = frame THEN "left" WHEN f > frame THEN trunc((nl - "left")/(nf - frame)::DOUBLE * (f - frame) + "left")::INT END AS "left" FROM e""")
def interpolate_track(spark, folder):
    lengths = v.table(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("person")).agg(F.count(F.lit(1)).alias("n"))
    return ft.interpolate_boxes(_near(spark, folder), P, lengths)


@query("""SELECT l_suppkey AS person, min(l_partkey * 7 % 1280)::INT AS x, min(l_partkey % 480)::INT AS y,
  (max(l_partkey * 7 % 1280 + l_quantity::INT) - min(l_partkey * 7 % 1280))::INT AS w,
  (max(l_partkey % 480 + l_quantity::INT) - min(l_partkey % 480))::INT AS h FROM lineitem GROUP BY l_suppkey""")
def outer_roi(spark, folder):
    li = v.table(spark, folder, "lineitem")
    size = F.col("l_quantity").cast("int")
    boxes = li.select(F.col("l_suppkey").alias("person"), (F.col("l_partkey") * 7 % 1280).cast("int").alias("x"),
                      (F.col("l_partkey") % 480).cast("int").alias("y"), size.alias("w"), size.alias("h"))
    return ft.outer_boxes(boxes, P)


@query(with_views(v.BOX) + """SELECT person, frame, CASE WHEN person % 2 = 0 THEN top + 11 ELSE round_even(top / 0.5, 0)::INT END AS top,
  CASE WHEN person % 2 = 0 THEN "right" + 7 ELSE round_even("right" / 0.75, 0)::INT END AS "right",
  CASE WHEN person % 2 = 0 THEN bottom + 11 ELSE round_even(bottom / 0.5, 0)::INT END AS bottom,
  CASE WHEN person % 2 = 0 THEN "left" + 7 ELSE round_even("left" / 0.75, 0)::INT END AS "left",
  (top + bottom) / 2 AS mid_y, ("left" + "right") / 2 AS mid_x FROM box""")
def original_box(spark, folder):
    roi = F.when(F.col("person") % 2 == 0, F.struct(F.lit(7).alias("x"), F.lit(11).alias("y")))
    sides = [F.col(c) for c in ("top", "right", "bottom", "left")]
    b = v.box(spark, folder).withColumns({
        "_o": faces.original_box(*sides, F.lit(0.75), F.lit(0.5), roi), "_m": faces.midpoint(*sides)})
    return b.select("person", "frame", "_o.top", "_o.right", "_o.bottom", "_o.left", F.col("_m.y").alias("mid_y"),
                    F.col("_m.x").alias("mid_x"))


LIPS = """lips AS (SELECT event_id, [{'x': (i*13 + floor(value)::INT) % 50, 'y': (i*7 + event_id) % 40} FOR i IN range(6)] AS top,
  [{'x': (i*11 + floor(value)::INT) % 60 + 50, 'y': (i*5 + event_id) % 30 + 40} FOR i IN range(6)] AS bot FROM events)"""


def _landmarks(spark, folder):
    e = v.table(spark, folder, "events").select("event_id", F.floor("value").cast("long").alias("_v"))
    points = lambda a, b, sx, sy, ox, oy: F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.struct(
        ((i * a + F.col("_v")) % sx + ox).alias("x"), ((i * b + F.col("event_id")) % sy + oy).alias("y")))
    return e.select("event_id", points(13, 7, 50, 40, 0, 0).alias("top"), points(11, 5, 60, 30, 50, 40).alias("bot"))


@query(with_views(LIPS) + """, d AS (SELECT event_id, [sqrt(pow(top[p[1]+1].x - bot[p[2]+1].x, 2) + pow(top[p[1]+1].y - bot[p[2]+1].y, 2))
  FOR p IN [[2,4],[3,3],[4,2],[0,0]]] AS d FROM lips)
SELECT event_id, round((d[1] + d[2] + d[3]) / 3 / d[4], 6) AS mar FROM d""")
def mouth_aspect_ratio(spark, folder):
    lips = _landmarks(spark, folder)
    return lips.select("event_id", F.round(faces.mouth_aspect_ratio(F.col("top"), F.col("bot")), 6).alias("mar"))


@query(with_views(LIPS) + """SELECT event_id, 100 + (list_max([p.x FOR p IN bot]) + list_min([p.x FOR p IN top])) // 2 AS x,
  200 + (list_min([p.y FOR p IN list_concat(top, bot)]) + list_max([p.y FOR p IN list_concat(top, bot)])) // 2 AS y FROM lips""")
def eye_centre(spark, folder):
    c = _landmarks(spark, folder).select("event_id", faces.eye_centre(F.col("top"), F.col("bot"), F.lit(100), F.lit(200)).alias("_c"))
    return c.select("event_id", "_c.x", "_c.y")


@query("""SELECT vec_id, ['Negative','Negative','Normal','Positive','Normal','Normal','Normal'][list_position(embedding[1:7], list_max(embedding[1:7]))] AS emotion
  FROM embeddings""")
def emotion_of_scores(spark, folder):
    e = v.table(spark, folder, "embeddings")
    return e.select("vec_id", faces.emotion(F.slice("embedding", 1, 7)).alias("emotion"))


@query(with_views(v.FRM) + """SELECT person, frame, last_value(CASE WHEN mouth > 20 THEN x END IGNORE NULLS) OVER w AS x,
  last_value(CASE WHEN mouth > 20 THEN y END IGNORE NULLS) OVER w AS y,
  CASE WHEN mouth > 20 THEN prediction ELSE 'Unknown' END AS prediction FROM frm WINDOW w AS (PARTITION BY person ORDER BY frame)""")
def carry_last_known(spark, folder):
    f = v.frm(spark, folder, "x", "y", "mouth", "prediction").withColumn("seen", F.col("mouth") > 20)
    return (ft.carry_known(f, P, "frame", ["x", "y"], "seen", "prediction")
            .select("person", "frame", "x", "y", "prediction"))


@query(with_views(v.FRM) + """, t AS (SELECT person, frame, 20*log10((mouth + 0.01)/500) AS db FROM frm),
lv AS (SELECT t.*, d, -40 - d AS th FROM t, (SELECT unnest([0,5,10,15,20,25,30]) AS d)),
isl AS (SELECT person, th, min(frame) AS start, max(frame) AS last, count(*) AS "rows" FROM (
  SELECT *, frame - row_number() OVER (PARTITION BY person, th ORDER BY frame) AS g FROM lv WHERE db <= th) GROUP BY person, th, g HAVING count(*) >= 2)
SELECT person, start, last, "rows" FROM isl QUALIFY th = max(th) OVER (PARTITION BY person)""")
def silent_ranges(spark, folder):
    f = v.frm(spark, folder, "mouth").select("person", "frame", (F.log10((F.col("mouth") + 0.01) / 500) * 20).alias("db"))
    return ft.silent_ranges(f, P, "frame", "db", -40.0, 2)


@query(with_views(v.VEC) + """, s AS (SELECT meeting, vec - min(vec) OVER (PARTITION BY meeting) AS pos, count(*) OVER (PARTITION BY meeting) AS n, encoding FROM vec),
w AS (SELECT s.meeting, s.pos, i AS win, encoding FROM s, unnest(range(0, 200)) AS r(i) WHERE pos >= floor(i*4.8 + 0.5) AND pos < floor(i*4.8 + 0.5) + 12 AND floor(i*4.8 + 0.5) + 12 <= n)
SELECT meeting, win, pos, round((encoding[1] - list_avg(encoding)) / (list_stddev_pop(encoding) + 1e-5), 6) AS first,
  round((encoding[64] - list_avg(encoding)) / (list_stddev_pop(encoding) + 1e-5), 6) AS last FROM w""")
def real_hop_windows(spark, folder):
    vec = v.vec(spark, folder).select("meeting", (F.col("vec") % 200).alias("pos"), "encoding")
    w = ft.real_hop_windows(vec, ["meeting"], "pos", "encoding", 12, 4.8)
    return w.select("meeting", "win", "pos", F.round(F.element_at("encoding", 1), 6).alias("first"),
                    F.round(F.element_at("encoding", -1), 6).alias("last"))


@query(with_views(v.LAB) + """, n AS (SELECT person, label, row_number() OVER (PARTITION BY person ORDER BY t, event_id) - 1 AS idx FROM lab),
b AS (SELECT *, idx - row_number() OVER (PARTITION BY person, label ORDER BY idx) AS g FROM n)
SELECT person, label, min(idx) AS "from", max(idx) AS "to", count(*) AS size FROM b GROUP BY person, label, g""")
def index_blocks(spark, folder):
    n = numbered(v.lab(spark, folder), P, ["t", "event_id"], "idx").select("person", "label", "idx")
    b = ft.index_blocks(n, ["person", "label"], "idx", "idx")
    return b.groupBy("person", "label", "block").agg(F.min("idx").alias("from"), F.max("idx").alias("to"),
                                                     F.count(F.lit(1)).alias("size")).drop("block")


PERMUTED = ("""idx AS (SELECT person, label, row_number() OVER (PARTITION BY person ORDER BY t, event_id) - 1 AS idx FROM lab),
placed AS (SELECT *, row_number() OVER w - 1 AS "at", idx - row_number() OVER w AS g FROM idx WINDOW w AS (PARTITION BY person, label ORDER BY idx)),
blk AS (SELECT person, label, idx, "at", dense_rank() OVER (PARTITION BY person, label ORDER BY g) - 1 AS block FROM placed),
sizes AS (SELECT person, label, block, count(*) AS size, min("at") AS lo FROM blk GROUP BY ALL),
drawn AS (SELECT *, count(*) OVER (PARTITION BY person, label) AS blocks FROM sizes),
base AS (SELECT * FROM drawn, (SELECT unnest(range(3))::INT AS sample))""",
            permuted_sql("base", "block", "blocks", 7, "person * 3 + sample"))


@query(with_views(v.LAB, *PERMUTED, recursive=True) + """, laid AS (SELECT person, label, block, sample, lo, (sum(size) OVER (PARTITION BY person, label, sample
  ORDER BY place) - size)::BIGINT AS base FROM perm)
SELECT person, label, idx, "at", block, sample, base + "at" - lo AS place FROM blk JOIN laid USING (person, label, block)""")
def permuted_blocks(spark, folder):
    n = numbered(v.lab(spark, folder), P, ["t", "event_id"], "idx").select("person", "label", "idx")
    ranked = along(n, ["person", "label"], ["idx"], rank="at")
    b = ft.index_blocks(ranked, ["person", "label"], "idx", "idx")
    return ft.permuted_blocks(b, ["person", "label"], "at", 3, 7, tweak=F.col("person"))
