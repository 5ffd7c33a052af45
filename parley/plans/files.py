"""Sources and sinks: tables written in the file layouts and read back, and the nod classifier on window files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import texts
from ..operators import classify, features as ft
from ..session import cut_lineage
from ..sources import tables as tb
from . import frames as fr, views as v
from .registry import query
from .views import with_views

HMS = "printf('%02d:%02d:%02d', ({0} // 1000 % 86400) // 3600, ({0} // 1000 % 3600) // 60, {0} // 1000 % 60)"


@query(with_views(v.UTT) + f"""SELECT meeting, (row_number() OVER (PARTITION BY meeting ORDER BY ord) - 1)::INT AS "Order",
  {HMS.format("start_ms")} AS start_hms, {HMS.format("end_ms")} AS end_hms, text AS "Text", speaker AS "Speaker", start_ms, end_ms FROM utt""")
def transcript_file(spark, folder):
    path = tb.scratch(spark, "transcript")
    tb.write_csv(tb.transcript_table(v.utt(spark, folder, text=True)), path)
    back = tb.read_csv(spark, path, "meeting BIGINT, " + tb.TRANSCRIPT, multi_line=True)
    return back.select("meeting", "Order", F.col("`Start time(HH:MM:SS)`").alias("start_hms"), F.col("`End time(HH:MM:SS)`").alias("end_hms"),
                       "Text", "Speaker", F.col("`Start time(ms)`").alias("start_ms"), F.col("`End time(ms)`").alias("end_ms"))


@query(with_views(v.UTT) + f""", quiet AS (SELECT meeting, speaker, last_end AS s, start_ms AS e FROM (SELECT *, lag(end_ms) OVER
  (PARTITION BY meeting, speaker ORDER BY ord) AS last_end FROM utt) WHERE start_ms - last_end >= 3000)
SELECT meeting, (row_number() OVER (PARTITION BY meeting ORDER BY s, speaker, e) - 1)::INT AS "Order", {HMS.format("s")} AS start_hms,
  speaker AS "Speaker", s AS start_ms, e AS end_ms FROM quiet""")
def silence_file(spark, folder):
    from .dashboards import _silence

    path = tb.scratch(spark, "silence")
    tb.write_csv(tb.silence_table(_silence(spark, folder)), path)
    back = tb.read_csv(spark, path, "meeting BIGINT, " + tb.SILENCE)
    return back.select("meeting", "Order", F.col("`Start time(HH:MM:SS)`").alias("start_hms"), "Speaker",
                       F.col("`Start time(ms)`").alias("start_ms"), F.col("`End time(ms)`").alias("end_ms"))


@query(with_views(v.FRM) + """SELECT person, frame AS frame_number, time_ms, prediction, mouth, gesture FROM frm""")
def person_series_file(spark, folder):
    path = tb.scratch(spark, "series")
    f = v.frm(spark, folder, "prediction", "mouth", "gesture")
    tb.write_csv(f.select("person", F.col("frame").alias("frame_number"), F.col("time_ms").alias("time(ms)"), "prediction",
                          F.col("mouth").alias("mouse opening"), "gesture"), path, encoding="Shift_JIS")
    schema = "person BIGINT, frame_number BIGINT, `time(ms)` BIGINT, prediction STRING, `mouse opening` DOUBLE, gesture INT"
    back = tb.read_csv(spark, path, schema, encoding="Shift_JIS")
    return back.select("person", "frame_number", F.col("`time(ms)`").alias("time_ms"), "prediction", F.col("`mouse opening`").alias("mouth"), "gesture")


@query(with_views(v.VEC) + """SELECT frame + meeting * 1000 AS frame_number, slot * 200 AS top, label = 3 AS is_detected,
  round(list_sum(encoding), 6) AS total, len(encoding) AS size FROM vec""")
def face_file(spark, folder):
    path = tb.scratch(spark, "faces")
    f = v.vec(spark, folder).select((F.col("frame") + F.col("meeting") * 1000).alias("frame_number"),
                                    F.array(F.col("slot") * 200, F.col("slot") * 200 + 90).alias("location"),
                                    (F.col("label") == 3).alias("is_detected"), "encoding")
    tb.write_faces(f, path)
    total = F.aggregate("encoding", F.lit(0.0), lambda s, x: s + x)
    return tb.read_faces(spark, path).select("frame_number", F.col("location")[0].alias("top"), "is_detected",
                                             F.round(total, 6).alias("total"), F.size("encoding").cast("long").alias("size"))


@query(with_views(v.VEC) + "SELECT round(encoding[1], 6) AS first, round(encoding[64], 6) AS last FROM vec")
def vector_lines(spark, folder):
    path = tb.scratch(spark, "vectors")
    tb.write_vectors(v.vec(spark, folder), "encoding", path)
    return tb.read_vectors(spark, path).select(F.round(F.col("vector")[0], 6).alias("first"), F.round(F.element_at("vector", -1), 6).alias("last"))


@query(with_views(v.VEC) + "SELECT meeting, vec, label, round(encoding[1], 6) AS first FROM vec")
def vector_table(spark, folder):
    path = tb.scratch(spark, "vector-table")
    v.vec(spark, folder).write.partitionBy("meeting").parquet(path)
    back = spark.read.parquet(path)
    return back.select(F.col("meeting").cast("long").alias("meeting"), "vec", "label", F.round(F.col("encoding")[0], 6).alias("first"))


@query(with_views(v.SENT) + """SELECT len(w) AS n_words, count(*) AS n_lines FROM (SELECT words AS w FROM sent) WHERE len(w) > 1 GROUP BY ALL""")
def token_lines(spark, folder):
    path = tb.scratch(spark, "tokens")
    tb.write_lines(v.sent(spark, folder), "words", path)
    return tb.read_lines(spark, path).groupBy(F.size("words").cast("long").alias("n_words")).agg(F.count(F.lit(1)).alias("n_lines"))


@query("""SELECT o_custkey % 100 AS person, o_orderstatus AS status, count(*) AS n, sum(o_custkey)::BIGINT AS total FROM orders GROUP BY ALL""")
def split_text(spark, folder):
    path = tb.scratch(spark, "split")
    o = v.table(spark, folder, "orders").select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("status"))
    tb.write_split_text(o, path, ["o_orderkey", "o_custkey"], "status")
    back = spark.read.schema("o_orderkey LONG, o_custkey LONG, status STRING").option("sep", " ").csv(f"{path}/split")
    return back.groupBy((F.col("o_custkey") % 100).alias("person"), "status").agg(F.count(F.lit(1)).alias("n"), F.sum("o_custkey").alias("total"))


@query("""SELECT 'run' || (c_nationkey) AS video_path, c_nationkey AS "offset", 'p' || c_custkey AS person, 'a' || c_custkey || '.wav' AS audio_path,
  (c_custkey % 640)::INT AS x, 3 AS sides FROM customer""")
def run_parameters(spark, folder):
    path = tb.scratch(spark, "runs")
    key = F.col("c_custkey")
    c = v.table(spark, folder, "customer").select(
        F.concat(F.lit("run"), F.col("c_nationkey").cast("string")).alias("video_path"), F.col("c_nationkey").cast("int").alias("offset"),
        F.concat(F.lit("p"), key.cast("string")).alias("person"), F.concat(F.lit("a"), key.cast("string"), F.lit(".wav")).alias("audio_path"),
        F.array(F.lit(0), F.lit(128), F.lit(255)).alias("rgb"), F.array((key % 640).cast("int"), F.lit(0), F.lit(100), F.lit(100)).alias("roi"))
    tb.write_run_parameters(c, path)
    back = tb.read_run_parameters(spark, path, lines=True)
    return back.select("video_path", "offset", "person", "audio_path", F.col("roi")[0].alias("x"), F.size("rgb").alias("sides"))


@query("""SELECT 'data/' || l_returnflag || '/' || l_linestatus || '.wav' AS file, l_linenumber AS label, count(*) AS n FROM lineitem GROUP BY ALL""")
def labelled_list(spark, folder):
    path = tb.scratch(spark, "list")
    li = v.table(spark, folder, "lineitem")
    li.select(F.concat_ws(" ", F.concat("l_returnflag", F.lit("/"), "l_linestatus", F.lit(".wav")), F.col("l_linenumber").cast("string"))
              .alias("value")).write.text(path)
    back = tb.read_labelled_list(spark, path, "data")
    return back.groupBy("file", "label").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT part, o_orderkey AS key, o_totalprice AS price FROM (SELECT *, CASE WHEN o_orderdate < '1998-01-01' THEN 0 ELSE 1 END AS part FROM orders)""")
def concat_parts(spark, folder):
    path = tb.scratch(spark, "parts")
    o = v.table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    early = F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")
    for i, condition in enumerate((early, ~early)):
        tb.write_csv(o.filter(condition).drop("o_orderdate"), f"{path}/{i}")
    parts = [tb.read_csv(spark, f"{path}/{i}", "o_orderkey LONG, o_totalprice DOUBLE") for i in (0, 1)]
    whole = tb.concat_parts(parts, "o_orderkey")
    return whole.select("part", F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("price"))


@query("""SELECT user_id % 10 AS person, (user_id % 2)::INT AS label, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def labelled_pose_files(spark, folder):
    path = tb.scratch(spark, "pose")
    e = v.table(spark, folder, "events").select((F.col("user_id") % 10).alias(" person"), F.col("value").alias(" pose_Rx"), "user_id")
    # Files named by label, header names with a leading blank, as the tracker writes them.
    for mark, odd in (("nod", 1), ("other", 0)):
        e.filter(F.col("user_id") % 2 == odd).drop("user_id").write.option("header", True).option(
            "ignoreLeadingWhiteSpace", False).csv(f"{path}/{mark}")
    raw = tb.read_pose(spark, [f"{path}/nod", f"{path}/other"])
    tagged = tb.read_pose(spark, f"{path}/nod").withColumn("label", F.lit(1)).unionByName(
        tb.read_pose(spark, f"{path}/other").withColumn("label", F.lit(0)))
    if raw.columns != ["person", "pose_Rx"]:
        raise ValueError(raw.columns)
    return tagged.groupBy(F.col("person").cast("long").alias("person"), "label").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("pose_Rx"), 4).alias("total"))


@query(with_views(v.UTT) + """SELECT meeting, ord, speaker, start_ms FROM utt""")
def ordered_transcript(spark, folder):
    return v.utt(spark, folder).orderBy("meeting", "ord").select("meeting", "ord", "speaker", "start_ms")


@query(with_views(v.FRM) + """SELECT person, frame FROM frm JOIN (SELECT person, max(frame) + 1 AS length FROM frm GROUP BY person) USING (person)
  WHERE frame % greatest(length // 7, 1) = 0""")
def evenly_spaced_frames(spark, folder):
    return tb.every_nth(v.frm(spark, folder).select("person", "frame"), ["person"], "frame", 7)


@query(with_views(v.FRM) + """SELECT person % 12 AS person, frame AS frame_number, time_ms, prediction, mouth, gesture FROM frm""")
def person_series_folder(spark, folder):
    """A folder of result<person>_<part>.csv, persons 0 to 11, so that result10 would come before result2 in a listing."""
    path = tb.scratch(spark, "persons")
    f = v.frm(spark, folder, "prediction", "mouth", "gesture").withColumn("person", F.col("person") % 12)
    columns = {"frame": "frame_number", "time_ms": "time(ms)", "mouth": "mouse opening"}
    rows = f.select("person", *[F.col(c).alias(columns.get(c, c)) for c in ("frame", "time_ms", "prediction", "mouth", "gesture")])
    tb.write_named(tb.with_columns(rows, tb.PERSON_SERIES, ["person"]), path, "person", "result{by}_{part}.csv", encoding="Shift_JIS")
    back = tb.read_person_series(spark, path)
    return back.select(F.col("person").cast("long").alias("person"), "frame_number", F.col("`time(ms)`").alias("time_ms"), "prediction",
                       F.col("`mouse opening`").alias("mouth"), "gesture")


@query("""SELECT file_place, label, person, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT user_id % 12 AS file_place, (user_id % 2)::INT AS label,
  user_id % 12 AS person, value FROM events) GROUP BY ALL""")
def labelled_pose_folder(spark, folder):
    """Files <person>-nod_0.csv and <person>-other_0.csv below a folder called nods: only the file names label."""
    path = f"{tb.scratch(spark, 'poses')}/nods"
    person = F.col("user_id") % 12
    e = v.table(spark, folder, "events").select(F.concat_ws("-", person.cast("string"), F.when(F.col("user_id") % 2 == 1, "nod").otherwise("other")).alias("file"),
                                                person.alias(" person"), F.col("value").alias(" pose_Rx"))
    tb.write_named(e.repartition("file"), path, "file", "{by}_{part}.csv")
    found = tb.read_labelled_pose(spark, path)
    return found.groupBy("file_place", "label", F.col("person").cast("long").alias("person")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("pose_Rx"), 4).alias("total"))


@query("""SELECT c_nationkey AS nation, dense_rank() OVER (ORDER BY 'id' || c_nationkey) - 1 AS speaker, count(*) AS files FROM (
  SELECT DISTINCT c_nationkey FROM customer) GROUP BY c_nationkey""")
def speaker_folders(spark, folder):
    """Folders id<nation>/audio with a file each; folders are numbered in the order of their names."""
    path = tb.scratch(spark, "speakers")
    c = v.table(spark, folder, "customer").select("c_nationkey", "c_custkey").repartition("c_nationkey")
    tb.write_named(c, path, "c_nationkey", "id{by}/audio/{part}.wav")
    found = tb.speaker_files(spark, path)
    return found.groupBy(F.regexp_extract("folder", "[0-9]+", 0).cast("int").alias("nation"), "speaker").agg(F.count(F.lit(1)).alias("files"))


@query("""SELECT p_partkey AS part, least(w[i], w[j]) AS word1, greatest(w[i], w[j]) AS word2 FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part),
  LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i) a, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS j) b WHERE i < j""")
def name_word_pairs(spark, folder):
    p = v.table(spark, folder, "part").select(F.col("p_partkey").alias("part"), F.explode(texts.word_pairs(F.split("p_name", " "))).alias("pair"))
    return p.select("part", "pair.word1", "pair.word2")


@query()
def nod_classifier(spark, folder):
    """Windows of head pose, labelled by whether their gesture share is above the mean: trained on some persons, scored on others."""
    rows = cut_lineage(fr.pose_windows(spark, folder, "timestamp", "rx", "ry", "rz", "gesture"))
    share = ft.window_success(rows, ["person"], "gesture")
    windows = ft.window_statistics(rows, ["person"], fr.AXES, "frame", "timestamp").join(share, ["person", "win"])
    mean = share.groupBy(F.lit(0).alias("_one")).agg(F.avg("success").alias("_mean"))
    windows = windows.withColumn("_one", F.lit(0)).join(F.broadcast(mean), "_one")  # one row
    windows = cut_lineage(windows.withColumn("label", (F.col("success") > F.col("_mean")).cast("int")).drop("success", "_one", "_mean"))
    return classify.validated(windows, [f"{s}_{a}" for a in fr.AXES for s in ft.STATISTICS], "person")[1]
