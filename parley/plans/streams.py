"""Streaming queries: the events arrive as a stream, frames are numbered by event."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import stateful as st
from . import views as v
from .registry import query
from .views import DAY_MS, with_views

P = ["person"]



def _stream(spark, folder):
    schema = v.table(spark, folder, "events").schema
    s = spark.readStream.schema(schema).parquet(f"{folder}/events.parquet*")
    return s.select(F.col("user_id").alias("person"), F.col("event_id").alias("frame"), "ts", "value", "event_type")


LIVE = """ev AS (SELECT user_id AS person, event_id AS frame, value, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n,
  (floor(value)::BIGINT % 640) AS x, (floor(value*7)::BIGINT % 480) AS y, ts FROM events)"""
NOD = """st AS (SELECT person, n, frame, x, y, 0::BIGINT AS mx, 0::DOUBLE AS my, 0 AS gesture, 15 AS hold FROM ev WHERE n = 1
  UNION ALL
  SELECT person, n, frame, x, y, mx, CASE WHEN hit THEN 0 ELSE my2 END, CASE WHEN hold3 <= 0 THEN 0 ELSE gesture2 END, hold3 FROM (
    SELECT *, CASE WHEN gesture2 = 1 AND hold2 > 0 THEN hold2 - 1 ELSE hold2 END AS hold3 FROM (
      SELECT *, CASE WHEN hit THEN 1 ELSE gesture END AS gesture2, CASE WHEN hit THEN 15 ELSE hold END AS hold2 FROM (
        SELECT *, my2 > 20 AS hit FROM (
          SELECT p.person, p.n, p.frame, p.x, p.y, greatest(0, s.mx + abs(s.x - p.x) - 8)::BIGINT AS mx,
            CASE WHEN trunc(s.my + abs(s.y - p.y) - 8) > 0 THEN trunc(s.my + abs(s.y - p.y) - 8) + 4 ELSE 0 END::DOUBLE AS my2,
            s.gesture, s.hold FROM st s JOIN ev p ON p.person = s.person AND p.n = s.n + 1)))))"""


@query(with_views(LIVE, NOD, recursive=True) + "SELECT person, frame, mx AS x_movement, my AS y_movement, gesture FROM st")
def nod_stream(spark, folder):
    points = _stream(spark, folder).select("person", "ts", "frame", (F.floor("value") % 640).alias("x"),
                                           (F.floor(F.col("value") * 7) % 480).alias("y"), F.lit(100).alias("height"))
    return st.drain(lambda s: st.nod_stream(s, P, k=1, slot_ms=DAY_MS), points, spark, "nods")


HIST = """h AS (SELECT *, (n - 1) % 2 = 0 AS looked, (n - 1) % 2 = 0 AND frame % 3 <> 0 AS used,
  greatest(0, least(49, trunc(value * 50 / 500)))::INT AS bin FROM ev),
c AS (SELECT a.person, a.n AS place, a.value, b.bin, count(*) OVER (PARTITION BY a.person, a.n ORDER BY b.bin) AS upto,
  count(b.bin) OVER (PARTITION BY a.person, a.n) AS k FROM h a LEFT JOIN h b ON b.person = a.person AND b.used AND b.n <= a.n WHERE a.looked),
med AS (SELECT person, place, CASE max(k) WHEN 0 THEN 5 WHEN 1 THEN any_value(value)
  ELSE min(bin) FILTER (upto >= (k + 1) // 2) * 10 + 5 END AS median FROM c GROUP BY person, place)"""


@query(with_views(LIVE, HIST) + """SELECT h.person, h.frame, round(med.median, 6)::DOUBLE AS median FROM h JOIN med
  ON med.person = h.person AND med.place = h.n - (h.n - 1) % 2""")
def median_stream(spark, folder):
    rows = _stream(spark, folder).select("person", "ts", "frame", "value", (F.col("frame") % 3 != 0).alias("success"))
    return st.drain(lambda s: st.median_stream(s, P, 50, 0.0, 500.0, slot_ms=DAY_MS), rows, spark, "medians").withColumn("median", F.round("median", 6))


FIX = """au AS (SELECT person, n, frame, value/50 - 1 AS au, greatest(0, least(199, trunc((value/50 - 1 + 3) * 200 / 8.0)))::INT AS bin FROM ev),
q AS (SELECT a.person, a.frame, a.au, b.bin, count(*) OVER (PARTITION BY a.person, a.n ORDER BY b.bin) AS upto,
  count(*) OVER (PARTITION BY a.person, a.n) AS k FROM au a JOIN au b ON b.person = a.person AND b.n <= a.n),
lift AS (SELECT person, frame, any_value(au) AS au, CASE WHEN max(k) >= 10 THEN -3 + min(bin) FILTER (upto > trunc(0.10 * k)) * (8.0/200) ELSE 0 END AS lift
  FROM q GROUP BY person, frame)"""


@query(with_views(LIVE, FIX) + "SELECT person, frame, round(greatest(least(au - lift, 5), 0), 6)::DOUBLE AS corrected FROM lift")
def correction_stream(spark, folder):
    rows = _stream(spark, folder).select("person", "ts", "frame", (F.col("value") / 50 - 1).alias("value"))
    return st.drain(lambda s: st.correction_stream(s, P, slot_ms=DAY_MS), rows, spark, "corrections").withColumn("corrected", F.round("corrected", 6))


@query(with_views(LIVE) + """SELECT person, frame, last_value(CASE WHEN value > 20 THEN x END IGNORE NULLS) OVER w::DOUBLE AS x,
  last_value(CASE WHEN value > 20 THEN y END IGNORE NULLS) OVER w::DOUBLE AS y,
  CASE WHEN value > 20 THEN event_type ELSE 'Unknown' END AS label FROM ev WINDOW w AS (PARTITION BY person ORDER BY n)""")
def carry_stream(spark, folder):
    rows = _stream(spark, folder).select("person", "ts", "frame", (F.floor("value") % 640).alias("x"), (F.floor(F.col("value") * 7) % 480).alias("y"),
                                         (F.col("value") > 20).alias("seen"), F.col("event_type").alias("label"))
    return st.drain(lambda s: st.carry_stream(s, P, ["x", "y"], slot_ms=DAY_MS), rows, spark, "carried")


@query(with_views(v.UTT) + """, met AS (SELECT time_bucket(INTERVAL 1 HOUR, e.ts) AS start, u.meeting, u.ord, e.event_type AS label
  FROM (SELECT *, user_id % 100 AS meeting, epoch_us(ts) // 1000 % 60000 AS time_ms FROM events) e JOIN utt u
  ON u.meeting = e.meeting AND e.time_ms >= u.start_ms AND e.time_ms < u.end_ms)
SELECT start, meeting, ord, label, count(*) AS n FROM met GROUP BY ALL""")
def live_panel(spark, folder):
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    events = _stream(spark, folder).select(
        F.timestamp_micros(micros).alias("ts"), (F.col("person") % 100).alias("meeting"),
        (F.floor(micros / 1000) % 60000).alias("time_ms"), F.col("event_type").alias("label"))
    said = v.utt(spark, folder)
    return st.drain(lambda s: st.live_panel(s, said, "1 hour", "10 minutes", 5_000), events, spark, "panel").withColumn("start", F.col("start").cast("timestamp_ntz"))
