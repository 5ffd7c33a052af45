"""Schemas, readers and writers of the meeting tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions import texts
from ..functions.times import hms
from ..operators.ranks import ranked
from ..operators.series import along
from ..operators.skew import lookup_join, salted_join

# Character sets Spark reads without a setting.
PLAIN_CHARSETS = {"utf-8", "us-ascii", "iso-8859-1", "utf-16", "utf-16be", "utf-16le", "utf-32"}

TRANSCRIPT = "Order INT, `Start time(HH:MM:SS)` STRING, `End time(HH:MM:SS)` STRING, Text STRING, Speaker INT, `Start time(ms)` BIGINT, `End time(ms)` BIGINT"
SILENCE = "Order INT, `Start time(HH:MM:SS)` STRING, `End time(HH:MM:SS)` STRING, Speaker INT, `Start time(ms)` BIGINT, `End time(ms)` BIGINT"
DIARIZATION = "`time(ms)` BIGINT, `speaker class` INT"
COMPACT = "Speaker INT, `Start time(ms)` BIGINT, `End time(ms)` BIGINT, `Start time(HH:MM:SS)` STRING, `End time(HH:MM:SS)` STRING"
PERSON_SERIES = ("frame_number BIGINT, `time(ms)` BIGINT, prediction STRING, x INT, y INT, absolute_x INT, relative_x INT, "
                 "x_movement INT, absolute_y INT, relative_y INT, y_movement DOUBLE, `mouse opening` DOUBLE, gesture INT, "
                 "top INT, bottom INT, left INT, right INT, gesture_threshold INT")
RUN_PARAMETERS = ("video_path STRING, offset INT, result MAP<STRING, STRUCT<audio_path: STRING, rgb: ARRAY<INT>, roi: ARRAY<INT>>>")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared checkpoint folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        import tempfile

        root = tempfile.mkdtemp(prefix="parley-")
    return f"{root.rstrip('/')}/parley-{name}-{uuid.uuid4().hex}"


def read_csv(spark: SparkSession, path, schema: str, encoding: str = "UTF-8", columns: list[str] | None = None,
             multi_line: bool = False) -> DataFrame:
    """CSV with a header line; only the wanted columns are parsed.

    ``multi_line`` is for cells with line breaks, as transcript texts may have; such files cannot be split.
    """
    if encoding.lower() not in PLAIN_CHARSETS:
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")  # Shift_JIS and other Java charsets
    # Quotes are doubled inside quoted cells, as the files are written.
    df = (spark.read.schema(schema).option("header", True).option("encoding", encoding).option("multiLine", multi_line)
          .option("escape", '"').csv(path))
    return df.select(*[f"`{c}`" for c in columns]) if columns else df


def read_person_series(spark: SparkSession, folder: str, encoding: str = "Shift_JIS") -> DataFrame:
    """All ``result<person>.csv`` (or ``result<person>_<part>.csv``) of a folder as one table with person and part.

    The person is the number in the file name, not the place in a sorted listing, where result10 comes before result2.
    """
    name = F.col("_metadata.file_name")
    if encoding.lower() not in PLAIN_CHARSETS:
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    df = (spark.read.schema(PERSON_SERIES).option("header", True).option("encoding", encoding)
          .option("pathGlobFilter", "result*.csv").csv(folder))
    return df.select("*", F.regexp_extract(name, r"result(\d+)", 1).cast("int").alias("person"),
                     F.coalesce(F.try_to_number(F.regexp_extract(name, r"result\d+_(\d+)", 1), F.lit("999999")).cast("int"), F.lit(0)).alias("part"))


def numbered_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """0-based Order column."""
    return along(df, keys, order, rank="Order")


def transcript_table(utterances: DataFrame) -> DataFrame:
    """Utterances in the layout of the transcript file, numbered per meeting."""
    rows = along(utterances, ["meeting"], ["ord"], rank="Order")
    return rows.select("meeting", F.col("Order").cast("int").alias("Order"), hms(F.col("start_ms")).alias("Start time(HH:MM:SS)"),
                       hms(F.col("end_ms")).alias("End time(HH:MM:SS)"), F.col("text").alias("Text"),
                       F.col("speaker").alias("Speaker"), F.col("start_ms").alias("Start time(ms)"), F.col("end_ms").alias("End time(ms)"))


def silence_table(silence: DataFrame, least_ms: int = 3000) -> DataFrame:
    """Silence of at least ``least_ms`` in the layout of the silence file, numbered per meeting."""
    rows = along(silence.filter(F.col("end_ms") - F.col("start_ms") >= least_ms), ["meeting"],
                 ["start_ms", "speaker", "end_ms"], rank="Order")
    return rows.select("meeting", F.col("Order").cast("int").alias("Order"), hms(F.col("start_ms")).alias("Start time(HH:MM:SS)"),
                       hms(F.col("end_ms")).alias("End time(HH:MM:SS)"), F.col("speaker").alias("Speaker"),
                       F.col("start_ms").alias("Start time(ms)"), F.col("end_ms").alias("End time(ms)"))


def write_csv(df: DataFrame, path: str, encoding: str = "UTF-8", by: list[str] | None = None,
              order: list[str] | None = None) -> None:
    """CSV with a header. Null and empty text stay apart only in Parquet.

    With ``by`` there is one folder per value. Rows are then ranged by (by, order) first, so a small key is one file
    and a large one is split over several tasks.
    """
    if encoding.lower() not in PLAIN_CHARSETS:
        df.sparkSession.conf.set("spark.sql.legacy.javaCharsets", "true")
    if by:
        df = df.repartitionByRange(*by, *(order or []))
    writer = df.write.option("header", True).option("encoding", encoding).option("escape", '"')
    (writer.partitionBy(*by) if by else writer).csv(path)


def write_named(df: DataFrame, folder: str, by: str, name: str, encoding: str = "UTF-8", keep: bool = False) -> None:
    """CSV files below ``folder`` whose names the rows decide: ``name`` with {by} and {part} filled in.

    The rows of a value may fill several files, numbered by {part}; ``keep`` leaves the column inside the files, too. Tasks
    write in parallel, and the driver only renames the files once they are complete. A value must be fit for a path.
    """
    spark = df.sparkSession
    if encoding.lower() not in PLAIN_CHARSETS:
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    work = scratch(spark, "named")
    tagged = df.withColumn("_by", F.col(by)) if keep else df.withColumnRenamed(by, "_by")
    tagged.write.partitionBy("_by").option("header", True).option("encoding", encoding).option("escape", '"').option(
        "ignoreLeadingWhiteSpace", False).csv(work)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    Path = jvm.org.apache.hadoop.fs.Path
    fs = Path(work).getFileSystem(conf)
    for values in fs.listStatus(Path(work)):
        if not values.isDirectory():
            continue
        value = values.getPath().getName().split("=", 1)[1]
        parts = sorted((f.getPath() for f in fs.listStatus(values.getPath()) if f.getPath().getName().startswith("part-")), key=str)
        for number, part in enumerate(parts):
            target = Path(f"{folder}/{name.format(by=value, part=number)}")
            fs.mkdirs(target.getParent())
            if not fs.rename(part, target):
                raise OSError(f"cannot name {target}")
    fs.delete(Path(work), True)


def write_split_text(df: DataFrame, path: str, columns: list[str], by: str) -> None:
    """Blank-separated text without header: everything below ``all``, and once more per value of ``by``."""
    options = {"sep": " ", "header": False, "escape": '"'}
    df.select(*columns).write.options(**options).csv(f"{path}/all")
    df.select(by, *columns).repartitionByRange(by, *columns).write.partitionBy(by).options(**options).csv(f"{path}/split")


def concat_parts(parts: list[DataFrame], order: str) -> DataFrame:
    """Part tables one after the other: ``part`` keeps the order of the list, sort by (part, order) to read it."""
    tagged = [p.withColumn("part", F.lit(i)) for i, p in enumerate(parts)]
    whole = tagged[0]
    for p in tagged[1:]:
        whole = whole.unionByName(p)
    return whole


def read_faces(spark: SparkSession, path) -> DataFrame:
    """Face observations whose box and vector are printed as ``[1 2 3]``, over several lines where long."""
    raw = (spark.read.option("header", True).option("multiLine", True).option("escape", '"')
           .schema("`_index` BIGINT, frame_number BIGINT, location STRING, is_detected STRING, encoding STRING").csv(path))
    return raw.select("frame_number", texts.float_list(F.col("location")).cast("array<int>").alias("location"),
                      (F.lower("is_detected") == "true").alias("is_detected"), texts.float_list(F.col("encoding")).alias("encoding"))


def write_faces(df: DataFrame, path: str) -> None:
    """Face observations in the printed layout ``read_faces`` takes."""
    shown = lambda c: F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: x.cast("string")), " "), F.lit("]"))
    df.select(F.monotonically_increasing_id().alias("_index") if "_index" not in df.columns else "_index",
              "frame_number", shown("location").alias("location"), "is_detected",
              shown("encoding").alias("encoding")).write.option("header", True).option("escape", '"').csv(path)


def read_pose(spark: SparkSession, path) -> DataFrame:
    """Head-pose series; the header names start with a blank, which is cut, and every column is a number."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select(*[F.col(f"`{c}`").cast("double").alias(c.strip()) for c in raw.columns])


def read_labelled_pose(spark: SparkSession, folder: str, mark: str = "nod") -> DataFrame:
    """Head-pose files with ``file``, ``label`` (1 when the file name holds the mark) and ``file_place``.

    Only the file name counts: a folder called nod does not label its files. ``file_place`` numbers the files by the
    numbers in their names, so that 10 comes after 9; names without numbers come first, and the name decides among equals.
    """
    raw = spark.read.option("header", True).csv(folder)
    name = F.col("_metadata.file_name")
    rows = raw.select(*[F.col(f"`{c}`").cast("double").alias(c.strip()) for c in raw.columns], name.alias("file"),
                      F.contains(name, F.lit(mark)).cast("int").alias("label"))
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file")).distinct()
    places = ranked(files.withColumn("_numbers", texts.numbers_of(F.col("file"))), ["_numbers", "file"], "file_place").drop("_numbers")
    return lookup_join(rows, places, ["file"])


def read_run_parameters(spark: SparkSession, path, lines: bool = False) -> DataFrame:
    """One row per person of a run: (video_path, offset, person, audio_path, rgb, roi).

    A file is one object, or with ``lines`` one object per line.
    """
    raw = spark.read.schema(RUN_PARAMETERS).option("multiLine", not lines).json(path)
    return raw.select("video_path", "offset", F.explode("result").alias("person", "_r")).select(
        "video_path", "offset", "person", "_r.audio_path", "_r.rgb", "_r.roi")


def write_run_parameters(people: DataFrame, path: str) -> None:
    """The inverse of ``read_run_parameters`` with ``lines``: one object per run; a run has a handful of people."""
    entry = F.struct("person", F.struct("audio_path", "rgb", "roi"))
    runs = people.groupBy("video_path", "offset").agg(F.map_from_entries(F.collect_list(entry)).alias("result"))
    runs.write.json(path)


def read_lines(spark: SparkSession, path, skip: str = "見出し", sep: str = ",") -> DataFrame:
    """Token lines as word lists; heading lines and lines of one word are left out."""
    lines = spark.read.text(path).filter(~F.col("value").contains(skip))
    return lines.select(F.split("value", sep).alias("words")).filter(F.size("words") > 1)


def write_lines(df: DataFrame, words: str, path: str, sep: str = ",") -> None:
    df.select(F.array_join(words, sep).alias("value")).write.text(path)


def write_vectors(df: DataFrame, vector: str, path: str) -> None:
    """One vector per line, tab-separated."""
    df.select(F.array_join(F.transform(vector, lambda x: x.cast("string")), "\t").alias("value")).write.text(path)


def read_vectors(spark: SparkSession, path) -> DataFrame:
    return spark.read.text(path).select(F.split("value", "\t").cast("array<double>").alias("vector"))


def speaker_files(spark: SparkSession, folder: str, most: int | None = None) -> DataFrame:
    """Files of all speaker folders, or of the first ``most``, with the speaker's place in the sorted folder names.

    Lists names only: the content column is never read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    named = files.withColumn("folder", F.regexp_extract("path", r"([^/]+)/audio/[^/]+$", 1)).filter("folder <> ''")
    folders = named.select("folder").distinct()
    if most is not None:
        folders = folders.orderBy("folder").limit(most)
    return named.join(ranked(folders, ["folder"], "speaker"), "folder")


def read_labelled_list(spark: SparkSession, path, root: str = "", tail: int | None = None) -> DataFrame:
    """``path label`` lines as (file, label); ``tail`` keeps that many last parts of the path."""
    parts = F.split(F.trim("value"), r"\s+")
    name = parts[0] if tail is None else F.array_join(F.slice(F.split(parts[0], "/"), -tail, tail), "/")
    return (spark.read.text(path).filter(F.trim("value") != "")
            .select(F.concat(F.lit(f"{root.rstrip('/')}/" if root else ""), name).alias("file"), parts[1].cast("int").alias("label")))


def every_nth(df: DataFrame, keys: list[str], order: str, count: int) -> DataFrame:
    """Rows at evenly spaced places of each key: step ``length // count`` from 0, with the length from the key's last place."""
    length = df.groupBy(*keys).agg((F.max(order) + 1).alias("_length"))
    step = F.greatest(F.floor(F.col("_length") / count), F.lit(1))
    return salted_join(df, length, keys).filter(F.col(order) % step == 0).drop("_length")


def with_columns(df: DataFrame, schema: str, also: list[str]) -> DataFrame:
    """All columns of a file layout in its order, NULL where the table lacks them, after the columns of ``also``."""
    fields = T._parse_datatype_string(schema).fields
    return df.select(*also, *[(F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def with_schema(df: DataFrame, schema: str) -> DataFrame:
    """Columns and types of a table definition, in its order."""
    return df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in T._parse_datatype_string(schema).fields])
