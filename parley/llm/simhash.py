"""Near-duplicates by SimHash: exact comparison of fingerprints in tiles.

A fingerprint has a bit set if more than half of the hashes of the text's shingles have it. Equal fingerprints are one row.
The distinct ones are sorted by the numbers of set bits in their four quarters and cut into tiles. Two fingerprints within
the radius differ by no more than the radius in these counts, summed over the quarters, so pairs of tiles whose ranges of
counts are farther apart are passed over. What is left is compared exactly: exclusive-or and bit counts, tile against tile.
Tiles are dealt out as pairs of groups of tiles, one task a pair; a task returns a spanning forest of the links it found,
which keeps all components and never lists all pairs of a large group.

Every pair of distinct fingerprints that the counts do not rule out is compared, so the work grows with the square of the
distinct texts; the counts leave about a tenth of it at a radius of 4 and most of it beyond 10.

Shingles: A-Z become lower case, words are runs of other bytes than ASCII white space, shingles have ``words`` words
joined by blanks and count as often as they occur. A text with fewer words is one shingle; a null text or one without words
has fingerprint 0 and is linked like any other. Rows that repeat are linked by their equal fingerprints. A row with a null
id takes part like any other, but an id is smallest only among the others; a group of rows without any id has none. An
empty table gives an empty one. Only id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .common import blocks, bounded_batches, free_name, utf8
from .graphs import components

TILE = 1024
GROUP_ROWS = 250_000  # distinct fingerprints of a group of tiles, of which a task gets two
QUARTERS = 4
SLOTS = 64  # of a text's sketch: the least hash of its shingles in each slot, two bytes each
NO_SHINGLE = 0xFFFF


def shingle_hashes(text, words: int):
    """Parts of the unsigned XXH64 hashes (seed 42) of the shingles of a text, in order."""
    import numpy as np
    from xxhash import xxh64_intdigest as digest

    parts = utf8(text).lower().split()
    if not parts:
        return
    joined = b" ".join(parts)
    if len(parts) <= words:
        yield np.array([digest(joined, 42)], np.uint64)
        return
    size = np.array([len(p) + 1 for p in parts])
    ends = np.cumsum(size)
    starts = (ends - size)[:len(parts) - words + 1].tolist()
    ends = (ends[words - 1:] - 1).tolist()
    for lo in range(0, len(starts), 1 << 16):
        yield np.array([digest(joined[a:b], 42) for a, b in zip(starts[lo:lo + (1 << 16)], ends[lo:lo + (1 << 16)])], np.uint64)


def fingerprint(text, words: int, sketched: bool = False):
    """The fingerprint as an unsigned number, and the sketch if asked for."""
    import numpy as np

    counts, n = np.zeros((8, 256), np.int64), 0
    least = np.full(SLOTS, NO_SHINGLE, np.uint16)
    for h in shingle_hashes(text, words):
        codes = h.astype("<u8").view(np.uint8).reshape(-1, 8) + np.arange(8, dtype=np.int64) * 256
        counts += np.bincount(codes.ravel(), minlength=2048).reshape(8, 256)
        n += len(h)
        if sketched:
            # another mix than the fingerprint's bits
            m = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            np.minimum.at(least, (m >> np.uint64(58)).astype(np.int64), np.minimum((m >> np.uint64(20)) & np.uint64(0xFFFF), NO_SHINGLE - 1).astype(np.uint16))
    bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
    set_bits = (counts @ bits).ravel()  # of bit 0, bit 1, ...
    value = sum(1 << i for i in np.flatnonzero(2 * set_bits > n).tolist())
    return value, least.tobytes() if sketched else None


def fingerprints(docs: DataFrame, words: int = 4, key: str = "doc_id", text: str = "text", sketched: bool = False) -> DataFrame:
    """(id, fp, sketch): the fingerprint as a signed 64-bit number; the sketch is null unless asked for."""
    import numpy as np
    import pyarrow as pa

    bounded_batches(docs.sparkSession)

    def run(batches):
        for b in blocks(batches, "text"):
            found = [fingerprint(t, words, sketched) for t in b.column(1).to_pylist()]
            prints = np.array([f for f, _ in found], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints), pa.array([s for _, s in found], pa.binary())], names=["id", "fp", "sketch"])

    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp bigint, sketch binary")


def tiles(distinct: DataFrame, groups: int) -> DataFrame:
    """Tiles of the rows (fp, sketch): the group, the first fingerprint, the ranges of the four counts, and the packed rows."""
    import numpy as np
    import pyarrow as pa

    counts = [F.bit_count(F.shiftrightunsigned("fp", 16 * q).bitwiseAND(F.lit(0xFFFF))).alias(f"c{q}") for q in range(QUARTERS)]
    order = [f"c{q}" for q in range(QUARTERS)] + ["fp"]
    rows = distinct.select("fp", "sketch", *counts).repartitionByRange(groups, *order).sortWithinPartitions(*order)
    rows = rows.withColumn("group", F.spark_partition_id())

    def pack(batches):
        def out(part):
            fp = part.column(0).to_numpy().astype(np.int64)
            c = np.stack([part.column(2 + q).to_numpy() for q in range(QUARTERS)], axis=1)
            packed = b"".join(s or b"" for s in part.column(1).to_pylist())
            return pa.RecordBatch.from_pylist([{"group": part.column(6)[0].as_py(), "first": int(fp[0]), "low": c.min(axis=0).tolist(),
                                                "high": c.max(axis=0).tolist(), "fps": fp.tobytes(), "sketches": packed}], schema=schema)

        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            while held.num_rows >= TILE:
                yield out(held.slice(0, TILE).combine_chunks())
                held = held.slice(TILE)
        if held is not None and held.num_rows:
            yield out(held.combine_chunks())

    schema = pa.schema([("group", pa.int32()), ("first", pa.int64()), ("low", pa.list_(pa.int32())), ("high", pa.list_(pa.int32())), ("fps", pa.binary()), ("sketches", pa.binary())])
    packed = cut_lineage(rows.mapInArrow(pack, "group int, first bigint, low array<int>, high array<int>, fps binary, sketches binary"))
    parts = (packed.agg(F.max("group")).first()[0] or 0) + 1  # the range partitions there are, which may be more than asked for
    return packed.withColumn("group", F.floor(F.col("group") * groups / parts).cast("int"))


def forest(a, b):
    """A spanning forest of the links (a, b) between numbers, as two arrays: each node with the smallest of its component."""
    import numpy as np

    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = roots(at[:len(a)], at[len(a):], len(nodes))
    rest = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[rest], nodes[label[rest]]


def roots(a, b, n: int):
    """The smallest number that each of the numbers below n reaches by the links (a, b)."""
    import numpy as np

    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return label
        label = new


def alike(x, y, similarity: float):
    """Whether the estimated Jaccard similarity of two sketches, row by row, is high enough."""
    import numpy as np

    same = ((x == y) & (x != NO_SHINGLE)).sum(axis=1)
    some = ((x != NO_SHINGLE) | (y != NO_SHINGLE)).sum(axis=1)
    return same >= similarity * np.maximum(some, 1)


def confirmed(a, b, sketches, similarity: float):
    """Links that join all pairs (a, b) of similar sketches. Pairs that are joined already are not looked at again."""
    import numpy as np

    if not len(a):
        return a, b
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, sketches, n, kept = at[:len(a)], at[len(a):], sketches[nodes], len(nodes), []
    while len(a):
        _, first = np.unique(a, return_index=True)  # one pair of each node at a time
        good = alike(sketches[a[first]], sketches[b[first]], similarity)
        kept.append((a[first][good], b[first][good]))
        label = roots(*(np.concatenate(k) for k in zip(*kept)), n)
        rest = np.ones(len(a), bool)
        rest[first] = False
        rest &= label[a] != label[b]
        a, b = a[rest], b[rest]
    return tuple(nodes[np.concatenate(k)] for k in zip(*kept))


def links(packed: DataFrame, groups: int, radius: int, similarity: float | None = None) -> DataFrame:
    """(a, b): pairs of fingerprints that join all those within the radius (and of similar sketches, if asked for)."""
    import numpy as np
    import pyarrow as pa

    def matches(x, y):
        """Places of the rows of two tiles within the radius."""
        found = [np.nonzero(np.bitwise_count(x[s:s + 128, None] ^ y) <= radius) for s in range(0, len(x), 128)]
        return np.concatenate([i + 128 * k for k, (i, _) in enumerate(found)]), np.concatenate([j for _, j in found])

    def compare(key, table):
        rows = table.select(["group", "first", "low", "high"]).to_pydict()
        order = sorted(range(table.num_rows), key=lambda i: (rows["group"][i], rows["low"][i], rows["high"][i], rows["first"][i]))
        group, low, high = (np.array([rows[k][i] for i in order]) for k in ("group", "low", "high"))
        fps = [np.frombuffer(table.column("fps")[i].as_py(), np.uint64) for i in order]
        starts = np.cumsum([0, *map(len, fps)])
        everything = np.concatenate(fps)
        sketches = None
        if similarity is not None:
            sketches = np.concatenate([np.frombuffer(table.column("sketches")[i].as_py(), np.uint16) for i in order]).reshape(-1, SLOTS)
        a, b, held = [], [], 0

        def fold():
            u, v = np.concatenate(a), np.concatenate(b)
            if sketches is not None:
                u, v = confirmed(u, v, sketches, similarity)
            if len(u):
                label = roots(u, v, len(everything))
                u = np.flatnonzero(label != np.arange(len(label)))
                v = label[u]
            return u, v

        lone = key[0].as_py() == key[1].as_py()
        done = []
        for i in range(len(order)):
            gap = np.maximum(0, np.maximum(low[i] - high, low - high[i])).sum(axis=1)
            meet = (gap <= radius) & ((np.arange(len(order)) >= i) if lone else (group != group[i]) & (np.arange(len(order)) > i))
            for j in np.flatnonzero(meet):
                u, v = matches(fps[i], fps[j])
                use = (u + starts[i]) < (v + starts[j])
                if use.any():
                    a.append(u[use] + starts[i])
                    b.append(v[use] + starts[j])
                    held += int(use.sum())
            if held > 1 << 20:  # keep memory bounded where very many are near each other
                done.append(fold())
                a, b, held = [], [], 0
        if a:
            done.append(fold())
        u, v = (np.concatenate(k) for k in zip(*done)) if done else (np.zeros(0, np.int64),) * 2
        if len(u):
            u, v = forest(u, v)
        value = everything.view(np.int64)
        return pa.table({"a": pa.array(value[u], pa.int64()), "b": pa.array(value[v], pa.int64())})

    other = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("other")
    cells = packed.select("*", other).select(F.least("group", "other").alias("x"), F.greatest("group", "other").alias("y"), *packed.columns)
    return cells.groupBy("x", "y").applyInArrow(compare, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, key: str = "doc_id", text: str = "text",
                    similarity: float | None = None) -> DataFrame:
    """(id, fp, component): each row's fingerprint and the smallest id that links of at most ``radius`` bits reach.

    With ``similarity``, links must also have that Jaccard similarity of shingles, estimated from sketches of 64 slots;
    a radius that takes in all such texts also takes in others by chance.
    """
    prints = cut_lineage(fingerprints(docs, words, key, text, similarity is not None))
    reps = prints.groupBy("fp").agg(F.min("id").alias("first"), F.min("sketch").alias("sketch"))
    groups = max(6, math.ceil(prints.select("fp").distinct().count() / GROUP_ROWS))
    pairs = links(tiles(reps, groups), groups, radius, similarity)
    found = components(pairs).select(F.col("node").alias("fp"), F.col("component").alias("group"))
    whole = reps.select("fp", "first").join(found, "fp", "left").withColumn("group", F.coalesce("group", "fp"))
    whole = whole.join(whole.groupBy("group").agg(F.min("first").alias("component")), "group").select("fp", "component")
    return prints.select("id", "fp").join(whole, "fp").select("id", "fp", "component")


def representatives(docs: DataFrame, words: int = 5, radius: int = 14, similarity: float = 0.75) -> DataFrame:
    """The documents without all but one of each group of near-duplicates: the one of the smallest id, nulls last, stays.

    Rows are told apart by their place in the table, so rows with equal or null ids are documents of their own; ``docs`` must
    be a stored table, which reads the same twice. The
    similarity is what sketches of texts of at least 0.8 show but for an error of their size.
    """
    row, name = F.monotonically_increasing_id(), free_name(docs, "_row")
    key = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), row.alias("r"))
    found = near_duplicates(docs.select(key.alias("_key"), "text"), words, radius, "_key", "text", similarity)
    gone = found.filter("id <> component").select(F.col("id.r").alias(name))
    return docs.withColumn(name, row).join(gone, name, "left_anti").drop(name)
