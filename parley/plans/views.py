"""The meeting tables as views of the driver tables, once as DataFrames and once as SQL text for the check.

utt   utterances of a meeting            from conversations
frm   frames of a person                 from events
seg   speech segments of a microphone    from events
lab   labels of a person over time       from events
vec   face vectors in frames             from embeddings
box   face boxes of a person             from lineitem
sent  distinct words of a sentence       from documents
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import texts
from ..operators.series import along

DAY_MS = 86_400_000
HOUR_MS = 3_600_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def utt(spark, folder, text: bool = False) -> DataFrame:
    """Utterances; the text only where it is wanted, so that the scan skips it elsewhere."""
    c = table(spark, folder, "conversations").select(
        F.col("conv_id").alias("meeting"), F.col("turn").alias("ord"),
        F.expr("CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END").alias("speaker"),
        *(["text"] if text else []), (F.length("text") * 50).cast("long").alias("_len"))
    return (along(c, ["meeting"], ["ord"], total={"end_ms": F.col("_len")})
            .withColumn("start_ms", F.col("end_ms") - F.col("_len")).drop("_len"))


UTT = """utt AS (SELECT conv_id AS meeting, turn AS ord,
  CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END AS speaker, text,
  (SUM(length(text)*50) OVER w - length(text)*50)::BIGINT AS start_ms, (SUM(length(text)*50) OVER w)::BIGINT AS end_ms
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"""


def _events(spark, folder) -> DataFrame:
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return table(spark, folder, "events").withColumn("us", micros)


FRAME_COLUMNS = {
    "meeting": "user_id % 100",
    "speaker": "CAST(user_id % 3 AS INT)",
    "prediction": "CASE WHEN event_type IN ('purchase','signup') THEN 'Positive' WHEN event_type = 'error' THEN"
                  " 'Negative' WHEN event_type = 'click' THEN 'Normal' ELSE 'Unknown' END",
    "mouth": "value",
    "gesture": "CAST(value > 50 AS INT)",
    "x": "CAST(floor(value) % 640 AS INT)",
    "y": "CAST(floor(value * 7) % 480 AS INT)",
}


def frm(spark, folder, *columns: str) -> DataFrame:
    """Frames of each person with the wanted columns of ``FRAME_COLUMNS``, and event_id and time_ms."""
    e = _events(spark, folder).select(F.col("user_id").alias("person"), "us", "event_id",
                                      *[F.expr(FRAME_COLUMNS[c]).alias(c) for c in columns])
    return (along(e, ["person"], ["us", "event_id"], rank="frame").drop("us")
            .withColumn("time_ms", F.col("frame") * 333))


FRM = """frm AS (SELECT user_id % 100 AS meeting, user_id AS person, frame, frame*333 AS time_ms, event_id,
  CASE WHEN event_type IN ('purchase','signup') THEN 'Positive' WHEN event_type = 'error' THEN 'Negative'
       WHEN event_type = 'click' THEN 'Normal' ELSE 'Unknown' END AS prediction,
  value AS mouth, (value > 50)::INT AS gesture, (floor(value)::BIGINT % 640)::INT AS x,
  (floor(value*7)::BIGINT % 480)::INT AS y, (user_id % 3)::INT AS speaker
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame FROM events))"""


def seg(spark, folder) -> DataFrame:
    start = F.floor(F.col("us") / 1000).cast("long")
    return _events(spark, folder).select(
        (F.col("user_id") % 10).alias("meeting"), F.col("event_id").alias("id"), F.col("event_type").alias("speaker"),
        start.alias("start_ms"), (start + F.floor(F.col("value") * 100000).cast("long")).alias("end_ms"), "value")


SEG = """seg AS (SELECT user_id % 10 AS meeting, event_id AS id, event_type AS speaker, epoch_us(ts)//1000 AS start_ms,
  epoch_us(ts)//1000 + floor(value*100000)::BIGINT AS end_ms, value FROM events)"""


def lab(spark, folder) -> DataFrame:
    return _events(spark, folder).select(F.col("user_id").alias("person"), F.col("us").alias("t"),
                                         F.col("event_type").alias("label"), "event_id")


LAB = "lab AS (SELECT user_id AS person, epoch_us(ts) AS t, event_type AS label, event_id FROM events)"


def vec(spark, folder) -> DataFrame:
    v = F.col("vec_id")
    return table(spark, folder, "embeddings").select(
        v.alias("vec"), F.floor(v / 200).cast("long").alias("meeting"), F.floor(v % 200 / 5).cast("long").alias("frame"),
        (v % 5).cast("int").alias("slot"), (F.floor(v % 200 / 5) * 2000).cast("long").alias("time_ms"),
        F.col("embedding").cast("array<double>").alias("encoding"), F.col("label").cast("int").alias("label"))


VEC = """vec AS (SELECT vec_id AS vec, vec_id // 200 AS meeting, (vec_id % 200) // 5 AS frame, (vec_id % 5)::INT AS slot,
  ((vec_id % 200) // 5) * 2000 AS time_ms, embedding::DOUBLE[] AS encoding, label::INT AS label FROM embeddings)"""


def raw_boxes(spark, folder, *extra: str) -> DataFrame:
    """Face boxes without frame numbers."""
    top, left = (F.col("l_partkey") % 480).cast("int"), (F.col("l_partkey") * 7 % 1280).cast("int")
    size = F.col("l_quantity").cast("int")
    return table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("person"), top.alias("top"), (left + size).alias("right"), (top + size).alias("bottom"),
        left.alias("left"), *extra)


def box(spark, folder) -> DataFrame:
    rest = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    days = F.expr("timestampdiff(DAY, TIMESTAMP_NTZ'1970-01-01 00:00:00', l_shipdate)")
    rows = raw_boxes(spark, folder, "l_shipdate", *rest).withColumn("day", days)
    return (along(rows.drop("l_shipdate"), ["person"], ["day", *rest], rank="frame")
            .select("person", "frame", "top", "right", "bottom", "left"))


BOX = """box AS (SELECT person, frame, t AS top, l + s AS right, t + s AS bottom, l AS left FROM (
  SELECT l_suppkey AS person, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber,
    l_partkey, l_quantity, l_extendedprice, l_discount, l_tax) - 1 AS frame, (l_partkey % 480)::INT AS t,
    (l_partkey * 7 % 1280)::INT AS l, l_quantity::INT AS s FROM lineitem))"""


def documents(spark, folder) -> DataFrame:
    return table(spark, folder, "documents")


def sentences(spark, folder) -> DataFrame:
    """Sentences of the documents. Texts are dealt to tasks first: a compressed file is often one scan task, and splitting
    the texts is the work that all word queries share."""
    texts_ = documents(spark, folder).select("doc_id", "text").repartition("doc_id")
    return texts_.select("doc_id", F.posexplode(F.split("text", "[.\n]")).alias("pos", "sentence"))


def sent(spark, folder) -> DataFrame:
    w = F.array_distinct(texts.words(F.col("sentence")))
    return (sentences(spark, folder).select("doc_id", "pos", w.alias("words")).filter(F.size("words") > 0))


SENT = r"""sentences AS (SELECT doc_id, unnest(range(len(p)))::INT AS pos, unnest(p) AS sentence
  FROM (SELECT doc_id, string_split_regex(text, '[.\n]') AS p FROM documents)),
sent AS (SELECT doc_id, pos, words FROM (SELECT doc_id, pos,
  list_distinct(regexp_extract_all(lower(sentence), '[a-zà-ÿ]+')) AS words FROM sentences) WHERE len(words) > 0)"""


def with_views(*ctes: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) + "\n"
