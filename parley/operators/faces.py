"""Face vectors: galleries, identity matching, clustering, distances."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.vectors import norm
from .clustering import ROWS, kmeans, matrix, meet, placed, squares
from .skew import salted_join

BLOCK = 2048  # reference vectors held by one task at a time


def faces_per_frame(df: DataFrame, keys: list[str]) -> DataFrame:
    """Detections of each frame as one list; a frame holds a handful of faces."""
    found = F.sort_array(F.collect_list(F.struct("slot", "vec")))
    return df.groupBy(*keys, "frame").agg(F.count(F.lit(1)).alias("faces"), found.alias("found"))


def most_faces(df: DataFrame, keys: list[str]) -> DataFrame:
    """Highest number of faces in any frame: the default person count."""
    per_frame = df.groupBy(*keys, "frame").agg(F.count(F.lit(1)).alias("faces"))
    return per_frame.groupBy(*keys).agg(F.max("faces").alias("persons"))


def reference_faces(df: DataFrame, rois: DataFrame, keys: list[str], until_ms: int = 30_000) -> DataFrame:
    """Gallery from the opening of a recording: per frame and person the first face whose centre is in the person's ROI."""
    early = df.filter(F.col("time_ms") < until_ms)
    near = early.join(rois, keys).filter((F.col("face_x") >= F.col("roi_from")) & (F.col("face_x") < F.col("roi_to")))
    return near.groupBy(*keys, "person", "frame").agg(F.min("vec").alias("sample"), F.min_by("encoding", "vec").alias("encoding"))


def person_distances(vectors: DataFrame, gallery: DataFrame, keys: list[str], width: int, within: float | None = None) -> DataFrame:
    """Distance of every vector to every person of its recording: the smallest over the person's samples.

    With ``within`` only vectors that near leave the tasks.

    Vectors are cut into chunks of ``width`` frames and the gallery of a recording into blocks of about ``BLOCK`` samples; a task compares
    one chunk with one block as matrices and returns one row per vector and person, so no sample pairs are written.
    """
    chunk = F.floor(F.col("frame") / width).cast("long")
    sizes = gallery.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_blocks"))
    blocks = salted_join(gallery.select(*keys, "person", "sample", "encoding"), sizes, keys)
    blocks = blocks.withColumn("_block", F.pmod(F.xxhash64("person", "sample"), F.col("_blocks")).cast("int")).drop("_blocks")
    queries = salted_join(vectors.select(*keys, "frame", "vec", F.col("encoding").alias("query"), chunk.alias("_chunk")), sizes, keys)
    queries = queries.withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_blocks")
    chunks = vectors.select(*keys, chunk.alias("_chunk")).distinct()
    blocks = salted_join(blocks, chunks, keys)
    blocks = blocks.select(*[F.col(c).alias(c) for c in blocks.columns])  # the gallery may stem from the same vectors
    group = [*keys, "_chunk", "_block"]
    types = {f.name: f.dataType.simpleString() for f in [*vectors.schema.fields, *gallery.schema.fields]}
    schema = ", ".join(f"{c} {types[c]}" for c in [*keys, "frame", "vec", "person"]) + ", distance double"

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(columns=[*keys, "frame", "vec", "person", "distance"])
        asked = np.vstack(left["query"].to_numpy()).astype(float)
        parts = []
        for person, rows in right.groupby("person", sort=False):
            known = np.vstack(rows["encoding"].to_numpy()).astype(float)
            nearest = np.full(len(asked), np.inf)
            step = max(1, (1 << 22) // known.size)  # at most 32 MB of differences at a time
            for at in range(0, len(asked), step):
                gap = asked[at:at + step, None, :] - known[None, :, :]
                nearest[at:at + step] = np.sqrt((gap * gap).sum(axis=2)).min(axis=1)
            found = left[[*keys, "frame", "vec"]].assign(person=person, distance=nearest)
            parts.append(found if within is None else found[nearest <= within])
        return pd.concat(parts, ignore_index=True)

    compared = queries.groupBy(*group).cogroup(blocks.groupBy(*group)).applyInPandas(compare, schema)
    return compared.groupBy(*keys, "frame", "vec", "person").agg(F.min("distance").alias("distance"))


def gallery_match(vectors: DataFrame, gallery: DataFrame, keys: list[str], threshold: float, width: int) -> DataFrame:
    """Name the vectors of each frame: every person claims its nearest vector if close enough.

    A vector claimed by several persons goes to the last of them. Persons without samples claim nothing.
    """
    near = person_distances(vectors, gallery, keys, width, threshold)
    claims = near.groupBy(*keys, "frame", "person").agg(F.min(F.struct("distance", "vec")).alias("_best"))
    return (claims.groupBy(*keys, "frame", F.col("_best.vec").alias("vec"))
            .agg(F.max("person").alias("person"), F.max_by("_best.distance", "person").alias("distance")))


def densest_faces(df: DataFrame, keys: list[str], persons: int, budget: int = 1000) -> DataFrame:
    """Up to ``budget`` vectors per recording, from the fullest frames first; frames with more faces than persons are
    skipped."""
    full = df.withColumn("faces", F.count(F.lit(1)).over(Window.partitionBy(*keys, "frame"))).filter(F.col("faces") <= persons)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("faces"), "frame", "vec"))
    return full.withColumn("_place", place).filter(F.col("_place") <= budget).drop("_place")


def cluster_faces(df: DataFrame, keys: list[str], rows: int = 0) -> DataFrame:
    """k-means labels ``person`` of all vectors of each recording, with as many clusters as its fullest frame has faces.

    Every vector takes part, whatever the number of faces in its frame; a vector that cannot be measured has no person.
    """
    wanted = most_faces(df, keys).withColumnRenamed("persons", "wanted")
    found, _ = kmeans(df, keys, "vec", "encoding", wanted, out="person", **({"rows": rows} if rows else {}))
    return df.select(*keys, "vec", "encoding").join(found.select(*keys, "vec", "person"), [*keys, "vec"])


def centres(df: DataFrame, keys: list[str]) -> DataFrame:
    """Mean vector per key, summed up inside the tasks."""
    return df.groupBy(*keys).agg(vector_to_array(Summarizer.mean(array_to_vector(F.col("encoding")))).alias("centre"))


def nearest_to(df: DataFrame, targets: DataFrame, out: str = "nearest", rows: int = ROWS) -> DataFrame:
    """For each target (name, centre) the nearest row of ``df``, the lowest one on a tie: (name, out, distance).

    Chunks of vectors meet the targets as matrices and hand back one row per target, so neither pairs nor targets pass
    the driver.
    """
    kind = df.select("vec").limit(0).toArrow().schema.field(0).type
    data, sizes = placed(df.withColumn("_all", F.lit(0)), ["_all"], "vec", "encoding", rows)

    def best(left, right):
        if left is None:
            return {"name": pa.array([], pa.string()), out: pa.array([], kind), "distance": pa.array([], pa.float64())}
        left = left.sort_by("_id")
        gap = squares(matrix(right.column("centre")), matrix(left.column("_x")))
        at = gap.argmin(axis=1)
        return {"name": right.column("name"), out: left.column("_id").take(pa.array(at)), "distance": pa.array(np.sqrt(gap[np.arange(len(at)), at]))}

    wanted = targets.select(F.lit(0).alias("_all"), F.col("name").cast("string").alias("name"), "centre")
    found = meet(data, wanted, sizes, ["_all"], best, f"name string, {out} {df.schema['vec'].dataType.simpleString()}, distance double")
    return (found.groupBy("name").agg(F.min(F.struct("distance", out)).alias("_b"))
            .select("name", f"_b.{out}", "_b.distance"))


def nearest_orientation(vector: Column, references: list[list[float]]) -> Column:
    """Number of the nearest reference orientation; the first one wins a tie."""
    gap = [F.aggregate(F.zip_with(vector, F.array(*[F.lit(float(x)) for x in r]), lambda a, b: (a - b) * (a - b)),
                       F.lit(0.0), lambda s, x: s + x) for r in references]
    gaps = F.array(*gap)
    return (F.array_position(gaps, F.array_min(gaps)) - 1).cast("int")


def speaker_distances(df: DataFrame, keys: list[str], speaker: str) -> DataFrame:
    """Root mean square distance between the vectors of every two speakers of a recording, and within each speaker.

    From the count, the mean vector and the mean squared length of each speaker, in one pass over the vectors:
    E|x - y|^2 = E|x|^2 + E|y|^2 - 2 E[x].E[y]. No vector pairs are formed.
    """
    rows = df.select(*keys, F.col(speaker).alias("speaker"), "encoding")
    middle = centres(rows, [*keys, "speaker"])
    size = rows.groupBy(*keys, "speaker").agg(F.avg(norm(F.col("encoding")) * norm(F.col("encoding"))).alias("square"))
    each = middle.join(size, [*keys, "speaker"])
    a = each.withColumnsRenamed({"speaker": "speaker1", "centre": "c1", "square": "q1"})
    b = each.withColumnsRenamed({"speaker": "speaker2", "centre": "c2", "square": "q2"})
    dot = F.aggregate(F.zip_with("c1", "c2", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    both = a.join(b, keys).filter("speaker1 <= speaker2")
    return both.select(*keys, "speaker1", "speaker2",
                       F.sqrt(F.greatest(F.col("q1") + F.col("q2") - dot * 2, F.lit(0.0))).alias("distance"))
