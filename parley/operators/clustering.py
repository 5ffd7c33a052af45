"""Clusters of vectors inside each key, for keys of any size.

The rows of a key are cut into chunks of bounded size by the hash of their id; a chunk meets its key's small table (centres,
landmarks) in a task and hands back sums, so a pass over a hot key is as many tasks as it has chunks, and only the sums
of chunks meet per key. Rows whose vector is null, empty or holds a null or non-finite component belong to no cluster and
get a null label; they are never dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage
from .skew import lookup_join

ROWS = 4096  # vectors of a chunk
LANDMARKS = 256  # of a key, in spectral clustering
NEAR = 7  # the neighbour whose distance is a landmark's local scale
TIES = 10  # landmarks a vector is tied to at least


def usable(vector: Column) -> Column:
    return F.coalesce(F.size(vector) > 0, F.lit(False)) & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))), F.lit(False))


def placed(df: DataFrame, keys: list[str], id_: str, vector: str, rows: int) -> tuple[DataFrame, DataFrame]:
    """The usable rows with their chunk, placed by it, and the number of chunks of each key."""
    good = df.filter(usable(F.col(vector))).select(*keys, F.col(id_).alias("_id"), F.col(vector).cast("array<double>").alias("_x"))
    sizes = cut_lineage(good.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("_chunks")))
    dealt = lookup_join(good, sizes, keys, by=["_id"]).withColumn("_chunk", F.pmod(F.xxhash64("_id"), F.col("_chunks")).cast("int"))
    return cut_lineage(dealt.drop("_chunks").repartition(*keys, "_chunk")), sizes


def meet(data: DataFrame, table: DataFrame, sizes: DataFrame, keys: list[str], work, schema: str) -> DataFrame:
    """``work(left, right) -> dict of columns`` for each chunk of ``data`` and its key's rows of ``table``."""
    group = [*keys, "_chunk"]
    copies = table.join(sizes, keys).withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1))).drop("_chunks")
    copies = copies.select(*[F.col(c).alias(c) for c in copies.columns])  # the table may stem from the same rows
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in data.select(*keys).schema.fields)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = work(left, right) if left.num_rows and right.num_rows else work(None, None)
        n = len(next(iter(found.values())))
        own = {k: pa.array([left.column(k)[0].as_py()] * n if n else [], left.schema.field(k).type) for k in keys}
        return pa.table({**own, **found})

    return data.groupBy(*group).cogroup(copies.groupBy(*group)).applyInArrow(run, f"{types}, {schema}")


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A column of equally long lists as rows of a matrix."""
    whole = column.combine_chunks()
    return whole.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(whole), -1)


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tolist() for r in rows], pa.list_(pa.float64()))


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances between the rows of two matrices."""
    out = np.zeros((len(x), len(y)))
    step = max(1, (1 << 21) // max(1, y.size))
    for at in range(0, len(x), step):
        gap = x[at:at + step, None, :] - y[None, :, :]
        out[at:at + step] = (gap * gap).sum(axis=2)
    return out


def _spread_starts(x: np.ndarray, weight: np.ndarray, k: int, rounds: int = 20) -> np.ndarray:
    """Centres of a few weighted points: the farthest by weight one after another, then plain k-means."""
    chosen = [int(weight.argmax())]
    gap = ((x - x[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < k and (gap * weight).max() > 0:
        chosen.append(int((gap * weight).argmax()))
        gap = np.minimum(gap, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    centres = x[chosen]
    for _ in range(rounds):
        label = squares(x, centres).argmin(axis=1)
        moved = np.stack([np.average(x[label == c], axis=0, weights=weight[label == c]) if (weight[label == c]).sum() > 0 else centres[c]
                          for c in range(len(centres))])
        if np.allclose(moved, centres):
            break
        centres = moved
    return centres


def _starts(data: DataFrame, sizes: DataFrame, keys: list[str], wanted: DataFrame, rounds: int = 3) -> DataFrame:
    """Starting centres (keys, centre, _c) in the manner of k-means||: a few rounds that each draw about twice as many points
    as centres are wanted, the far ones more likely, then a weighted choice among the points drawn."""
    seed = cut_lineage(data.groupBy(*keys).agg(F.min_by("_x", F.struct(F.xxhash64("_id"), "_id")).alias("_c")))
    drawn = seed
    for number in range(rounds):
        table = drawn.join(wanted, keys).groupBy(*keys).agg(F.collect_list("_c").alias("_cs"), F.max("_k").alias("_k"))  # a few times _k points a key

        def draw(left, right, number=number):
            if left is None:
                return {"_score": pa.array([], pa.float64()), "_c": pa.array([], pa.list_(pa.float64()))}
            x = matrix(left.column("_x"))
            known = np.array(right.column("_cs")[0].as_py())
            gap = squares(x, known).min(axis=1)
            draw_ = left.column("_u").to_numpy()
            # the rows of the largest u^(1/gap) are a sample without replacement by gap
            score = np.where(gap > 0, np.log(draw_) / np.where(gap > 0, gap, 1), -np.inf)
            best = np.argsort(-score, kind="stable")[:2 * int(right.column("_k")[0].as_py())]
            best = best[np.isfinite(score[best])]
            return {"_score": pa.array(score[best]), "_c": _lists(x[best])}

        u = (F.pmod(F.xxhash64("_id", F.lit(number + 11)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
        found = meet(data.withColumn("_u", u), table, sizes, keys, draw, "_score double, _c array<double>").join(wanted, keys)
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_score"), "_c"))
        best = found.withColumn("_place", place).filter(F.col("_place") <= 2 * F.col("_k")).select(*keys, "_c")
        drawn = cut_lineage(drawn.unionByName(best))
    numbered = drawn.dropDuplicates([*keys, "_c"]).withColumn("centre", (F.row_number().over(Window.partitionBy(*keys).orderBy("_c")) - 1).cast("int"))
    numbered = cut_lineage(numbered)
    weights = _sums(data, numbered, sizes, keys).groupBy(*keys, "centre").agg(F.sum("_n").alias("_n"))
    weighed = numbered.join(weights, [*keys, "centre"]).join(wanted, keys)
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in data.select(*keys).schema.fields)

    def choose(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("centre")
        chosen = _spread_starts(matrix(rows.column("_c")), rows.column("_n").to_numpy().astype(float), int(rows.column("_k")[0].as_py()))
        own = {k: pa.array([rows.column(k)[0].as_py()] * len(chosen), rows.schema.field(k).type) for k in keys}
        return pa.table({**own, "centre": pa.array(range(len(chosen)), pa.int32()), "_c": _lists(chosen)})

    return cut_lineage(weighed.groupBy(*keys).applyInArrow(choose, f"{types}, centre int, _c array<double>"))


def _sums(data: DataFrame, centres: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    """Per chunk and centre: rows nearest to it, their mean and their summed squared distance."""

    def work(left, right):
        if left is None:
            return {"centre": pa.array([], pa.int32()), "_n": pa.array([], pa.int64()), "_mean": pa.array([], pa.list_(pa.float64())),
                    "_cost": pa.array([], pa.float64())}
        right = right.sort_by("centre")
        x, number = matrix(left.column("_x")), right.column("centre").to_numpy()
        gap = squares(x, matrix(right.column("_c")))
        label = gap.argmin(axis=1)
        used = np.unique(label)
        return {"centre": pa.array(number[used], pa.int32()), "_n": pa.array([int((label == c).sum()) for c in used], pa.int64()),
                "_mean": _lists(np.stack([x[label == c].mean(axis=0) for c in used])),
                "_cost": pa.array([float(gap[label == c, c].sum()) for c in used])}

    return meet(data, centres, sizes, keys, work, "centre int, _n long, _mean array<double>, _cost double")


def _moved(data: DataFrame, centres: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    """The centres as the means of the rows nearest to them; a centre without rows stays. ``_shift`` is the squared move."""
    sums = _sums(data, centres, sizes, keys)
    mean = vector_to_array(Summarizer.mean(array_to_vector(F.col("_mean")), F.col("_n").cast("double")))
    means = sums.groupBy(*keys, "centre").agg(mean.alias("_new"))
    both = centres.select(*keys, "centre", "_c").join(means, [*keys, "centre"], "left")
    moved = F.aggregate(F.zip_with("_c", "_new", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    return cut_lineage(both.select(*keys, "centre", F.coalesce("_new", "_c").alias("_c"), F.coalesce(moved, F.lit(0.0)).alias("_shift")))


def _settled(data, centres, sizes, keys, rounds: int, tolerance: float) -> DataFrame:
    for _ in range(rounds):
        centres = _moved(data, centres, sizes, keys)
        if (centres.agg(F.max("_shift")).first()[0] or 0.0) <= tolerance:
            break
    return centres.select(*keys, "centre", "_c")


def _assigned(data, centres, sizes, keys, id_type: pa.DataType | None, id_sql: str) -> DataFrame:
    """(keys, _id, centre, distance) of every row."""

    def work(left, right):
        if left is None:
            return {"_id": pa.array([], id_type), "centre": pa.array([], pa.int32()), "distance": pa.array([], pa.float64())}
        right = right.sort_by("centre")
        gap = squares(matrix(left.column("_x")), matrix(right.column("_c")))
        label = gap.argmin(axis=1)
        return {"_id": left.column("_id"), "centre": pa.array(right.column("centre").to_numpy()[label], pa.int32()),
                "distance": pa.array(np.sqrt(gap[np.arange(len(label)), label]))}

    return meet(data, centres, sizes, keys, work, f"_id {id_sql}, centre int, distance double")


def _labelled(df: DataFrame, found: DataFrame, keys: list[str], id_: str, vector: str, out: str) -> DataFrame:
    """``found`` under the caller's names, with the rows that have no usable vector."""
    rest = df.filter(~usable(F.col(vector))).select(*keys, id_, F.lit(None).cast("int").alias(out), F.lit(None).cast("double").alias("distance"))
    return found.select(*keys, F.col("_id").alias(id_), F.col("centre").alias(out), "distance").unionByName(rest)


def kmeans(df: DataFrame, keys: list[str], id_: str, vector: str, k: int | DataFrame, out: str = "cluster", rounds: int = 25,
           tolerance: float = 1e-12, starts: DataFrame | None = None, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """k-means inside each key over all its vectors: (keys, id, out, distance) of every row, and (keys, out, centre).

    ``k`` is a number or a table of the keys with a column ``wanted``; a key with fewer distinct vectors has fewer clusters.
    ``starts`` (keys, centre, _c) replaces the drawn starting centres. Equal distances go to the lower number.
    """
    data, sizes = placed(df, keys, id_, vector, rows)
    if starts is None:
        wanted = k.select(*keys, F.col("wanted").cast("int").alias("_k")) if isinstance(k, DataFrame) else sizes.select(*keys, F.lit(k).alias("_k"))
        starts = _starts(data, sizes, keys, wanted)
    centres = _settled(data, starts, sizes, keys, rounds, tolerance)
    kind = df.select(id_).limit(0).toArrow().schema.field(0).type
    found = _assigned(data, centres, sizes, keys, kind, df.schema[id_].dataType.simpleString())
    return (_labelled(df, found, keys, id_, vector, out),
            centres.select(*keys, F.col("centre").alias(out), F.col("_c").alias("centre")))


# --- spectral clustering ------------------------------------------------------------------------------------------

def _affinity(x: np.ndarray, landmarks: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """The nearest landmarks of each unit vector (those beyond the percentile) and their weights, which sum to 1."""
    p = len(landmarks)
    between = np.maximum(0.0, 2 - 2 * landmarks @ landmarks.T)
    scale = np.maximum(np.sort(between, axis=1)[:, min(NEAR, p - 1)], 1e-9)
    gap = np.maximum(0.0, 2 - 2 * x @ landmarks.T)
    kept = min(p, max(TIES, int(np.ceil(share * p))))
    at = np.argsort(gap, axis=1, kind="stable")[:, :kept]
    near = np.take_along_axis(gap, at, axis=1)
    own = np.maximum(near[:, min(NEAR, kept) - 1:min(NEAR, kept)], 1e-9)
    weight = np.exp(-near / np.sqrt(own * scale[at]))
    return at, weight / weight.sum(axis=1, keepdims=True)


def _units(column: pa.ChunkedArray) -> np.ndarray:
    x = matrix(column)
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(length > 0, length, 1)


def _spectrum(gram: np.ndarray, least: int, most: int) -> tuple[np.ndarray, int]:
    """Landmark features and the number of clusters, which the largest drop between neighbouring eigenvalues tells."""
    degree = gram.sum(axis=1)
    root = 1 / np.sqrt(np.maximum(degree, 1e-12))
    value, vector = np.linalg.eigh(gram * root[:, None] * root[None, :])
    value, vector = np.maximum(value[::-1], 1e-9), vector[:, ::-1]
    most = max(1, min(most, len(value)))
    least = min(least, most)
    drop = value[:most] - np.append(value, 0.0)[1:most + 1]
    k = int(np.argmax(drop[least - 1:])) + least
    return root[:, None] * vector[:, :k] / np.sqrt(value[:k]), k


def spectral(df: DataFrame, keys: list[str], id_: str, vector: str, least: int = 1, most: int = 100, percentile: float = 0.95,
             out: str = "speaker", landmarks: int = LANDMARKS, rows: int = ROWS) -> DataFrame:
    """Spectral clusters of each key's vectors by cosine, their number unknown: (keys, id, out, clusters).

    The affinity graph is sparse: a vector is tied to its nearest of at most ``landmarks`` vectors of its key (drawn by
    the hash of the id), namely those beyond the ``percentile`` of its affinities, with weights by the landmarks' local
    scale. Two vectors are alike as far as they share landmarks, so the graph's eigenvectors follow from the landmarks'
    own matrix, summed over all vectors. The number of clusters between ``least`` and ``most`` is where neighbouring
    eigenvalues drop most; every vector is then placed in the eigenvectors' space and clustered there by k-means.

    Cost grows with vectors times landmarks; no pairs of vectors are formed. Clusters are numbered by their first id. A key
    with one vector is one cluster; a zero vector is like no landmark and goes where its equal weights lead. The smallest
    cluster to be found is one that the landmarks reach (a few of them), so raise ``landmarks`` for many small clusters.
    """
    share = 1 - percentile
    data, sizes = placed(df, keys, id_, vector, rows)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64("_id"), "_id"))
    marks = cut_lineage(data.withColumn("_at", (place - 1).cast("int")).filter(F.col("_at") < landmarks).select(*keys, "_at", F.col("_x").alias("_mark")))

    def gram(left, right):
        if left is None:
            return {"_i": pa.array([], pa.int32()), "_j": pa.array([], pa.int32()), "_w": pa.array([], pa.float64())}
        known = _units(right.sort_by("_at").column("_mark"))
        at, weight = _affinity(_units(left.column("_x")), known, share)
        dense = np.zeros((len(at), len(known)))
        np.put_along_axis(dense, at, weight, axis=1)
        i, j = np.nonzero(total := dense.T @ dense)
        return {"_i": pa.array(i, pa.int32()), "_j": pa.array(j, pa.int32()), "_w": pa.array(total[i, j])}

    cells = (meet(data, marks, sizes, keys, gram, "_i int, _j int, _w double").groupBy(*keys, "_i", "_j").agg(F.sum("_w").alias("_w")))
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in data.select(*keys).schema.fields)

    def solve(rows: pa.Table) -> pa.Table:  # at most landmarks x landmarks cells of a key
        i, j = rows.column("_i").to_numpy(), rows.column("_j").to_numpy()
        n = int(max(i.max(), j.max())) + 1
        whole = np.zeros((n, n))
        whole[i, j] = rows.column("_w").to_numpy()
        feature, k = _spectrum((whole + whole.T) / 2, least, most)
        unit = feature / np.maximum(np.linalg.norm(feature, axis=1, keepdims=True), 1e-12)
        used = whole.sum(axis=1) > 0
        start = _spread_starts(unit[used], np.ones(int(used.sum())), k)
        pad = [start[c].tolist() if c < len(start) else None for c in range(n)]
        own = {c: pa.array([rows.column(c)[0].as_py()] * n, rows.schema.field(c).type) for c in keys}
        return pa.table({**own, "_at": pa.array(range(n), pa.int32()), "_feature": _lists(feature), "_start": pa.array(pad, pa.list_(pa.float64())),
                         "_k": pa.array([k] * n, pa.int32())})

    solved = cut_lineage(cells.groupBy(*keys).applyInArrow(solve, f"{types}, _at int, _feature array<double>, _start array<double>, _k int"))
    kind = df.select(id_).limit(0).toArrow().schema.field(0).type

    def place_(left, right):
        if left is None:
            return {"_id": pa.array([], kind), "_y": pa.array([], pa.list_(pa.float64()))}
        right = right.sort_by("_at")
        at, weight = _affinity(_units(left.column("_x")), _units(right.column("_mark")), share)
        feature = matrix(right.column("_feature"))
        y = (feature[at] * weight[:, :, None]).sum(axis=1)
        return {"_id": left.column("_id"), "_y": _lists(y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12))}

    known = marks.join(solved.select(*keys, "_at", "_feature"), [*keys, "_at"], "left")
    # landmarks that no vector is tied to have no feature
    width = solved.groupBy(*keys).agg(F.max(F.size("_feature")).alias("_d"))
    known = known.join(width, keys).withColumn("_feature", F.coalesce("_feature", F.array_repeat(F.lit(0.0), F.col("_d")))).drop("_d")
    sql = df.schema[id_].dataType.simpleString()
    spread = cut_lineage(meet(data, known, sizes, keys, place_, f"_id {sql}, _y array<double>"))
    starts = solved.filter("_start IS NOT NULL").select(*keys, F.col("_at").alias("centre"), F.col("_start").alias("_c"))
    found, _ = kmeans(spread, keys, "_id", "_y", 0, starts=starts, rounds=10, out="_label", rows=rows)
    found = cut_lineage(found)
    order = found.groupBy(*keys, "_label").agg(F.min("_id").alias("_first"))
    number = (F.row_number().over(Window.partitionBy(*keys).orderBy("_first")) - 1).cast("int")
    names = order.select(*keys, "_label", number.alias(out), F.count(F.lit(1)).over(Window.partitionBy(*keys)).cast("int").alias("clusters"))
    done = lookup_join(found.select(*keys, F.col("_id").alias(id_), "_label"), names, [*keys, "_label"], by=[id_]).drop("_label")
    rest = df.filter(~usable(F.col(vector))).select(*keys, id_, F.lit(None).cast("int").alias(out), F.lit(None).cast("int").alias("clusters"))
    return done.select(*keys, id_, out, "clusters").unionByName(rest)
