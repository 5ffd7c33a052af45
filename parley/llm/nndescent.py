"""Near-duplicate vectors by NN-descent: a graph of nearest neighbours, refined through neighbours of neighbours.

Equal vectors of a label are one node. The graph starts from the leaves of random projections. In each round, a node's
neighbours, forwards and backwards, meet in a local join: each learns which of the others are nearer than its worst
neighbour so far, until lists stop changing. A list that is saturated, that is full of links, would lose further ones: each
local join also returns a spanning forest of the links in it, and at the end the lists are enlarged to the whole group
that neighbour edges within the threshold connect, compared block against block in double precision. Only the number
of links and a forest of them leave the tasks. The recall of links is measured: a stated set of query nodes is compared
with all nodes of their label, in blocks. Below ``RECALL`` the search goes on with new projections and longer lists.

Only equal, non-null labels are compared, and only vectors of the same length. A vector that is null, empty, zero or
has null or non-finite components links with nothing; it still has its row. Rows with the same id are rows of their own.
A component without any id has none. An empty table gives an empty one. Columns besides the three are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut_lineage
from .common import bounded_batches
from .graphs import components
from .simhash import forest

LIST = 8  # neighbours of a node at first
LEAF = 256
TREES = 6
ROUNDS = 6  # at most, in one attempt
TILE = 64  # neighbours that meet in one local join
ENOUGH = 0.002  # share of lists that change when the rounds end
RECALL = 0.99
ATTEMPTS = 3
QUERIES = 50  # one node of so many is a query of the audit
BLOCK = 2048


def prepared(rows: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(row, id, label, vec): all rows; vec is null where the vector links with nothing."""
    v = F.col(vector).cast("array<double>")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.col(label).isNotNull() & v.isNotNull() & ~odd & F.exists(v, lambda x: x != 0)
    return rows.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"), F.col(label).cast("string").alias("label"),
                       F.when(F.coalesce(good, F.lit(False)), v).alias("vec"))


def unit_rows(vectors: DataFrame) -> DataFrame:
    """(node, space, unit, unit64): unit vectors in single and double precision as bytes; a space is a label and a length."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for b in batches:
            out = []
            for v in b.column(2).to_pylist():
                x = np.array(v)
                x = x / np.abs(x).max()
                out.append(x / np.sqrt(x @ x))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x.astype("<f4").tobytes() for x in out], pa.binary()),
                                              pa.array([x.astype("<f8").tobytes() for x in out], pa.binary())], names=["node", "space", "unit", "unit64"])

    space = F.concat_ws(" ", F.size("vec"), "label")
    return vectors.select("node", space.alias("space"), "vec").mapInArrow(run, "node bigint, space string, unit binary, unit64 binary")


def dealt(units: DataFrame, depths: DataFrame, seed: int) -> DataFrame:
    """(node, unit, place, part): the leaf of each node by the signs of random projections; crowded leaves come in parts."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for b in batches:
            code = []
            for d, u in zip(b.column(3).to_pylist(), b.column(2).to_pylist()):
                x = np.frombuffer(u, "<f4")
                planes = np.random.default_rng(seed).standard_normal((d, len(x)))
                code.append("".join("1" if s > 0 else "0" for s in planes @ x))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(1), pa.array(code, pa.string())], names=["node", "unit", "space", "code"])

    rows = units.join(depths, "space").select("node", "space", "unit", "depth")
    rows = rows.mapInArrow(run, "node bigint, unit binary, space string, code string")
    rows = rows.select("node", "unit", F.concat_ws("/", "space", "code").alias("place"))
    return parted(rows, "place", LEAF, seed)


def parted(rows: DataFrame, place: str, most: int, seed: int) -> DataFrame:
    """Add ``part``: places of more than ``most`` rows are cut at random into parts of about that size."""
    sizes = rows.groupBy(place).agg(F.ceil(F.count(F.lit(1)) / most).alias("_parts"))
    return rows.join(sizes, place).withColumn("part", F.pmod(F.xxhash64("node", F.lit(seed)), "_parts")).drop("_parts")


def local_join(tiles: DataFrame, most: int, near: float) -> DataFrame:
    """(u, v, sim, kind) for the nodes of each tile (place, part, node, unit, worst).

    kind 0   for each node the nearest others, at most ``most``, that are nearer than its worst neighbour so far
    kind 1   a spanning forest of the pairs of at least ``near``, so that a list that is full loses no cluster
    """
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for b in batches:
            u, v, s, kind = [], [], [], []
            bounds, flat = b.column(0).offsets.to_numpy(), b.column(0).values
            node, worst = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("node", "worst"))
            unit = flat.field("unit").to_pylist()
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                x, mine = np.frombuffer(b"".join(unit[lo:hi]), "<f4").reshape(hi - lo, -1), node[lo:hi]
                sim = x @ x.T
                np.fill_diagonal(sim, -2)
                k = min(most, hi - lo - 1)
                top = np.argpartition(-sim, k - 1, axis=1)[:, :k]
                value = np.take_along_axis(sim, top, axis=1)
                use = value > worst[lo:hi, None]
                u.append(np.repeat(mine, use.sum(axis=1)))
                v.append(mine[top][use])
                s.append(value[use])
                kind.append(np.zeros(len(u[-1]), np.int32))
                i, j = np.nonzero(np.triu(sim >= near))
                if len(i):
                    i, j = forest(i, j)
                    u.append(mine[i])
                    v.append(mine[j])
                    s.append(sim[i, j])
                    kind.append(np.ones(len(i), np.int32))
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v)), pa.array(np.concatenate(s).astype(np.float64)),
                                                  pa.array(np.concatenate(kind))], names=["u", "v", "sim", "kind"])

    one = F.collect_list(F.struct("node", "unit", "worst")).alias("members")
    grouped = tiles.groupBy("place", "part").agg(one).filter(F.size("members") > 1).select("members")
    return grouped.mapInArrow(run, "u bigint, v bigint, sim double, kind int")


def merged(graph: DataFrame | None, found: DataFrame, most: int) -> DataFrame:
    """(u, v, sim, kind, new): the best ``most`` of the old and new neighbours of each node, and all of kind 1."""
    both = found.withColumn("new", F.lit(1))
    if graph is not None:
        both = graph.withColumn("new", F.lit(0)).unionByName(both)
    each = both.groupBy("u", "v", "kind").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
    lists = each.filter("kind = 0")
    number = F.row_number().over(Window.partitionBy("u").orderBy(F.col("sim").desc(), "v"))
    return lists.withColumn("_n", number).filter(F.col("_n") <= most).drop("_n").unionByName(each.filter("kind = 1"))


def descended(units: DataFrame, near: float, graph: DataFrame | None, seed: int, most: int) -> DataFrame:
    """The neighbour graph (u, v, sim, kind, new) after one attempt."""
    sizes = units.groupBy("space").agg(F.count(F.lit(1)).alias("n"))
    depths = sizes.select("space", F.greatest(F.lit(1), F.ceil(F.log2(F.col("n") / (LEAF / 2)))).cast("int").alias("depth"))
    trees = [dealt(units, depths, seed * 1000 + t).withColumn("place", F.concat(F.lit(f"{t} "), "place")) for t in range(TREES)]
    tiles = trees[0]
    for t in trees[1:]:
        tiles = tiles.unionByName(t)
    graph = cut_lineage(merged(graph, local_join(tiles.withColumn("worst", F.lit(-2.0)), most, near), most))
    total = max(1, units.count())
    for r in range(ROUNDS):
        lists = graph.filter("kind = 0")
        changed = lists.filter("new = 1").select("u").distinct().count()
        if changed <= ENOUGH * total:
            break
        worst = lists.groupBy("u").agg(F.min("sim").alias("sim"), F.count(F.lit(1)).alias("n"))
        known = units.select("node", "unit").join(worst.withColumnRenamed("u", "node"), "node", "left")
        known = known.select("node", "unit", F.when(F.col("n") >= most, F.col("sim")).otherwise(F.lit(-2.0)).alias("worst"))
        back = lists.select(F.col("u").alias("place"), F.col("v").alias("node"), "new")
        both = back.unionByName(lists.select(F.col("v").alias("place"), F.col("u").alias("node"), "new"))
        both = both.groupBy("place", "node").agg(F.max("new").alias("new"))
        busy = both.groupBy("place").agg(F.max("new").alias("any"), F.ceil(F.count(F.lit(1)) / TILE).alias("_parts")).filter("any = 1")
        members = both.join(busy.select("place", "_parts"), "place")
        members = members.select("place", "node", F.pmod(F.xxhash64("node", F.lit(seed * 1000 + r)), "_parts").alias("part"))
        centre = busy.select("place", F.col("place").alias("node"), F.lit(0).cast("long").alias("part"))
        tiles = members.unionByName(centre).join(known, "node")
        graph = cut_lineage(merged(graph, local_join(tiles, most, near), most))
    return graph


def audit(units: DataFrame, threshold: float) -> DataFrame:
    """(u, v): all links of the query nodes, found by comparing them with all nodes of their space, in blocks."""
    import numpy as np
    import pyarrow as pa

    def packed(rows, name):
        sizes = rows.groupBy("space").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("_parts"))
        block = F.pmod(F.xxhash64("node"), "_parts")
        return (rows.join(sizes, "space").groupBy("space", block.alias("block")).agg(F.collect_list(F.struct("node", "unit")).alias(name)).drop("block"))

    def compare(batches):
        for b in batches:
            for i in range(b.num_rows):
                q, a = (b.column(c)[i].values for c in (0, 1))
                x, y = (np.frombuffer(b"".join(p.field("unit").to_pylist()), "<f4").reshape(len(p), -1) for p in (q, a))
                n, m = (p.field("node").to_numpy() for p in (q, a))
                j, k = np.nonzero(x @ y.T >= threshold)
                use = n[j] != m[k]
                yield pa.RecordBatch.from_arrays([pa.array(n[j][use]), pa.array(m[k][use])], names=["u", "v"])

    asked = units.filter(F.pmod(F.xxhash64("node", F.lit(7)), F.lit(QUERIES)) == 0)
    pairs = packed(asked, "q").join(packed(units, "a"), "space").select("q", "a")
    return pairs.mapInArrow(compare, "u bigint, v bigint")


def grouped(units: DataFrame, threshold: float) -> tuple[DataFrame, float]:
    """(node, place): groups of nodes that hold all links found, and the measured recall of links.

    A group is a component of the neighbour graph's edges within the threshold, in single precision.
    """
    near = threshold - 1e-5
    graph, most, truth = None, LIST, cut_lineage(audit(units, threshold))
    total = truth.count()
    for attempt in range(ATTEMPTS):
        graph = descended(units, near, graph, attempt + 1, most)
        edges = graph.filter(F.col("sim") >= near).select(F.col("u").alias("a"), F.col("v").alias("b"))
        places = cut_lineage(components(edges).select("node", F.col("component").alias("place")))
        one = truth.join(places.withColumnsRenamed({"node": "u", "place": "_p"}), "u").join(places.withColumnRenamed("node", "v"), "v")
        recall = one.filter(F.col("_p") == F.col("place")).count() / total if total else 1.0
        if recall >= RECALL:
            break
        most *= 4
    return places, recall


def compared(members: DataFrame, threshold: float) -> DataFrame:
    """(u, v, n): exact links inside each place, for rows (node, place, unit64, copies), block against block.

    Rows without v hold how many vectors node u is linked to in a pair of blocks; the others are a spanning forest of links.
    Lists of saturated nodes are thus as long as their group, without a list of all pairs.
    """
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for b in batches:
            u, v, n = [], [], []
            for i in range(b.num_rows):
                p, q = (b.column(c)[i].values for c in (1, 3))
                same = b.column(0)[i].as_py() == b.column(2)[i].as_py()
                x, y = (np.frombuffer(b"".join(z.field("unit64").to_pylist()), "<f8").reshape(len(z), -1) for z in (p, q))
                left, right = (z.field("node").to_numpy() for z in (p, q))
                near = x @ y.T >= threshold
                if same:
                    np.fill_diagonal(near, False)
                for nodes, sums in ((left, near @ q.field("copies").to_numpy()), (right, p.field("copies").to_numpy() @ near))[:1 if same else 2]:
                    u.append(nodes[sums > 0])
                    n.append(sums[sums > 0])
                    v.append(np.full(len(u[-1]), -1))
                j, k = np.nonzero(near)
                if len(j):
                    a, c = forest(left[j], right[k])
                    u.append(a)
                    v.append(c)
                    n.append(np.zeros(len(a), np.int64))
            if u:
                u, v, n = (np.concatenate(z).astype(np.int64) for z in (u, v, n))
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v, mask=v < 0), pa.array(n)], names=["u", "v", "n"])

    packed = (parted(members, "place", BLOCK // 2, 5).groupBy("place", "part")
              .agg(F.collect_list(F.struct("node", "unit64", "copies")).alias("rows")))
    other = packed.select("place", F.col("part").alias("part2"), F.col("rows").alias("rows2"))
    pairs = packed.join(other, "place").filter("part <= part2").select("part", "rows", "part2", "rows2")
    return pairs.mapInArrow(run, "u bigint, v bigint, n bigint")


def near_duplicates(rows: DataFrame, threshold: float = 0.98, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(id, n_links, component, kept, recall) for each row: its links to other rows, the smallest id that links reach."""
    bounded_batches(rows.sparkSession)
    every = cut_lineage(prepared(rows, key, vector, label))
    usable = every.filter("vec IS NOT NULL")
    classes = usable.groupBy("label", "vec").agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("copies"), F.min("id").alias("first"))
    classes = cut_lineage(classes)
    units = cut_lineage(unit_rows(classes))
    bounded = None
    places, recall = grouped(units, threshold)
    members = places.join(units.select("node", "unit64"), "node").join(classes.select("node", "copies"), "node")
    found = cut_lineage(compared(members, threshold))
    sums = found.filter("v IS NULL").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("others"))
    groups = components(found.filter("v IS NOT NULL").select(F.col("u").alias("a"), F.col("v").alias("b")))
    known = classes.join(sums, "node", "left").join(groups.withColumnRenamed("component", "group"), "node", "left").withColumn("group", F.coalesce("group", "node"))
    known = known.join(known.groupBy("group").agg(F.min("first").alias("component")), "group")
    known = known.select("label", "vec", "component", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    mine = usable.join(known, ["label", "vec"]).select("id", "n_links", "component")
    alone = every.filter("vec IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return mine.unionByName(alone).select("id", "n_links", "component", F.col("id").eqNullSafe(F.col("component")).alias("kept"), F.lit(recall).alias("recall"))
