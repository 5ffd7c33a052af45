"""A manifest of a dataset: Merkle trees per source under one root, and every row's proof.

H is the lower-case hex SHA-256 of texts put together. A row's leaf is H of its columns, each as its UTF-8 length, a colon
and its value, or ``-`` if null. Within a source, rows ascend by id; runs of ``FAN`` nodes become their H until one is
left, the subroot. Subroots, ordered by source, become the root the same way.

Leaves are numbered by a range-partitioned sort, so a source of any size is many tasks' work. Every node then holds the
siblings on its step to its parent. Pointer jumping makes those into proofs: in each round a node appends the segment of the
ancestor it points to and points to where that ancestor points, which doubles its distance; the rounds grow with the
logarithm of the height. The sixteen leaves of a run share the path of the run's node, so paths are joined once per run.

Nulls: a null id comes first in its source, a null source is a source of its own and comes first. Rows with equal ids are
ordered by their leaf; rows that repeat are leaves of their own. Empty texts have the length 0; texts are read whole. A table
of one row has that leaf as its root and an empty proof; an empty table gives an empty manifest. Only the named columns are
read, so names cannot clash.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.ranks import ranked
from ..operators.skew import lookup_join
from ..session import cut_lineage

FAN = 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
TOP = "t"  # the tree of subroots; trees of sources are "n" (null) and "s" with the source, which sort in their order
SMALL = 10_000  # nodes with their paths (at most FAN digests a level) that may be broadcast

STEPS = "array<struct<left:string,right:string>>"


def leaf_of(columns: list[Column]) -> Column:
    """Digest of a row's values."""
    text = [c.cast("string") for c in columns]
    field = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]
    return F.sha2(F.concat(*field), 256)


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf leads to along its proof."""
    return F.aggregate(steps, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def _levels(nodes: DataFrame) -> list[DataFrame]:
    """All levels of trees (tree, pos, n, hash), the given one included; ``n`` counts a tree's nodes on the level."""
    levels = [nodes.withColumns({"level": F.lit(0), "members": F.lit(None).cast("array<string>")})]
    while True:
        below = levels[-1].filter("n > 1")
        run = F.array_sort(F.collect_list(F.struct("pos", "hash")))
        up = (below.groupBy("tree", F.floor(F.col("pos") / FAN).cast("long").alias("pos"),
                            F.ceil(F.col("n") / FAN).cast("long").alias("n"))
              .agg(F.transform(run, lambda r: r["hash"]).alias("members")))
        up = cut_lineage(up.select("tree", "pos", "n", F.sha2(F.concat_ws("", "members"), 256).alias("hash"),
                                   F.lit(len(levels)).alias("level"), "members"))
        if up.isEmpty():
            return levels
        levels.append(up)


def _id(tree, level, pos) -> Column:
    return F.struct(tree.alias("tree"), level.cast("int").alias("level"), pos.cast("long").alias("pos"))


def _siblings(members: Column, index: Column) -> Column:
    """The members of a run before and after one of them, as one step of a proof."""
    return F.struct(F.concat_ws("", F.slice(members, F.lit(1), index)).alias("left"),
                    F.concat_ws("", F.slice(members, index + 2, F.lit(FAN))).alias("right"))


def _paths(nodes: DataFrame) -> DataFrame:
    """(id, steps): the steps from each node (id, up, index, members) to the root."""
    parents = nodes.filter("members IS NOT NULL").select(F.col("id").alias("up"), F.col("members").alias("run"))
    state = nodes.select("id", "up", "index").join(parents, "up", "left")
    step = F.when(F.col("up").isNotNull(), F.array(_siblings(F.col("run"), F.col("index")))).otherwise(F.array().cast(STEPS))
    state = cut_lineage(state.select("id", "up", step.alias("steps")))
    while not state.filter("up IS NOT NULL").isEmpty():
        # Only what is pointed to is looked up: after each round those are fewer, and more nodes point to each.
        wanted = state.filter("up IS NOT NULL").select(F.col("up").alias("id")).distinct()
        aims = cut_lineage(state.join(wanted, "id", "left_semi").select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("steps").alias("_steps")))
        state = cut_lineage(lookup_join(state, aims, ["up"], "left", limit=SMALL, by=["id"]).select(
            "id", F.col("_up").alias("up"), F.concat("steps", F.coalesce("_steps", F.array().cast(STEPS))).alias("steps")))
    return state.select("id", "steps")


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, carry: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot, root, and ``proof``, its steps of left and right siblings.

    ``columns`` names the id, the source and the further columns that a leaf covers. ``carry`` adds columns that are
    computed from the row and stay beside its leaf.
    """
    key, source = columns[:2]
    carry = dict(carry or {})
    tree = F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n"))
    leaves = cut_lineage(docs.select(F.col(key).alias("doc_id"), tree.alias("tree"), leaf_of([F.col(c) for c in columns]).alias("leaf"),
                                     F.struct(F.lit(0).alias("_none"), *[c.alias(n) for n, c in carry.items()]).alias("extra")))
    leaves = cut_lineage(ranked(leaves, ["doc_id", "leaf"], "pos", ["tree"], size="n"))
    levels = _levels(leaves.select("tree", "pos", "n", F.col("leaf").alias("hash")))
    subroots = cut_lineage(reduce(DataFrame.unionByName, [x.filter("n = 1") for x in levels])
                           .select("tree", "level", F.col("pos").alias("_pos"), "hash"))
    tops = cut_lineage(ranked(subroots, ["tree"], "pos", size="n"))
    top = _levels(tops.select(F.lit(TOP).alias("tree"), "pos", "n", "hash"))
    last = top[-1].select("hash").first()
    root = F.lit(last[0] if last else None).cast("string")

    # Nodes of the sources above the leaves, then those above the subroots (which are known from below).
    inner = [levels[0].filter("n = 1"), *levels[1:]]
    own = reduce(DataFrame.unionByName, inner).join(tops.select("tree", F.col("pos").alias("place"), F.col("n").alias("sources")), "tree")
    above = (F.when(F.col("n") > 1, _id(F.col("tree"), F.col("level") + 1, F.floor(F.col("pos") / FAN)))
             .when(F.col("sources") > 1, _id(F.lit(TOP), F.lit(1), F.floor(F.col("place") / FAN))))
    own = own.select(_id(F.col("tree"), F.col("level"), F.col("pos")).alias("id"), above.alias("up"),
                     (F.when(F.col("n") > 1, F.col("pos")).otherwise(F.col("place")) % FAN).cast("int").alias("index"), "members")
    over = [x.select(_id(F.col("tree"), F.col("level"), F.col("pos")).alias("id"),
                     F.when(F.col("n") > 1, _id(F.col("tree"), F.col("level") + 1, F.floor(F.col("pos") / FAN))).alias("up"),
                     (F.col("pos") % FAN).cast("int").alias("index"), "members") for x in top[1:]]
    paths = _paths(reduce(DataFrame.unionByName, [own, *over]))

    # The leaves of a run share its node's path; a leaf that is its source's only one is that node itself.
    alone = F.col("n") == 1
    home = _id(F.col("tree"), F.when(alone, 0).otherwise(1), F.floor(F.col("pos") / FAN))
    kids = F.array_sort(F.collect_list(F.struct("pos", "leaf", "doc_id", "extra")))
    runs = leaves.groupBy(home.alias("id"), alone.alias("alone")).agg(kids.alias("kids")).join(paths, "id")
    runs = runs.withColumn("tree", F.col("id")["tree"])
    runs = lookup_join(runs, subroots.select("tree", F.col("hash").alias("subroot")), ["tree"], by=["id"])
    each = runs.select("alone", "steps", "subroot", F.transform("kids", lambda k: k["leaf"]).alias("members"), F.posexplode("kids").alias("at", "kid"))
    first = F.when(F.col("alone"), F.array().cast(STEPS)).otherwise(F.array(_siblings(F.col("members"), F.col("at"))))
    return each.select(F.col("kid.doc_id").alias("doc_id"), F.col("kid.leaf").alias("leaf"), "subroot", root.alias("root"),
                       F.concat(first, "steps").alias("proof"), *[F.col(f"kid.extra.{n}").alias(n) for n in carry])


def proof_digest(steps: Column) -> Column:
    """H of all siblings of a proof, level by level and from left to right."""
    return F.sha2(F.concat_ws("", F.transform(steps, lambda s: F.concat(s["left"], s["right"]))), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Unsigned crc32 of a decimal number, byte by byte and bit by bit.
CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda acc, b: list_reduce([xor(acc, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
    lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""


def _leaf_sql(text: str) -> str:
    fields = [f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(fields)})"


SQL = f"""
WITH RECURSIVE leaves AS (SELECT doc_id, coalesce('s' || source, 'n') AS tree, {_leaf_sql('text')} AS leaf,
    CASE WHEN doc_id IS NOT NULL AND {CRC32} % 5 = 0
      THEN {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {_leaf_sql('text')} END AS changed FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
low AS (SELECT tree, 0 AS level, pos, n, leaf AS hash FROM placed
  UNION ALL SELECT tree, level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(hash, '' ORDER BY pos)) FROM low WHERE n > 1
  GROUP BY tree, level, pos // 16, n),
subroots AS (SELECT tree, level, hash, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS sources FROM low WHERE n = 1),
high AS (SELECT 0 AS level, place AS pos, sources AS n, hash FROM subroots
  UNION ALL SELECT level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(hash, '' ORDER BY pos)) FROM high WHERE n > 1
  GROUP BY level, pos // 16, n),
runs AS (SELECT tree, level, pos // 16 AS run, string_agg(hash, '' ORDER BY pos) AS members FROM low WHERE n > 1 GROUP BY ALL
  UNION ALL SELECT NULL, level, pos // 16, string_agg(hash, '' ORDER BY pos) FROM high WHERE n > 1 GROUP BY ALL),
walk AS (SELECT placed.tree, pos AS leaf_pos, r.level AS step, pos // (16 ** r.level)::BIGINT % 16 AS i, members
    FROM placed JOIN runs r ON r.tree = placed.tree AND r.run = pos // (16 ** (r.level + 1))::BIGINT
  UNION ALL SELECT placed.tree, pos, s.level + r.level, place // (16 ** r.level)::BIGINT % 16, members
    FROM placed JOIN subroots s USING (tree) JOIN runs r ON r.tree IS NULL AND r.run = place // (16 ** (r.level + 1))::BIGINT),
steps AS (SELECT tree, leaf_pos, step, members[1:(64 * i)::INT] AS l, members[(64 * i + 65)::INT:] AS r FROM walk),
proofs AS (SELECT tree, leaf_pos, sha256(string_agg(l || r, '' ORDER BY step)) AS proof, max(step) AS top FROM steps GROUP BY tree, leaf_pos),
fold AS (SELECT tree, pos, 0 AS step, changed AS h FROM placed
  UNION ALL SELECT f.tree, f.pos, f.step + 1, sha256(s.l || f.h || s.r) FROM fold f JOIN steps s ON s.tree = f.tree AND s.leaf_pos = f.pos AND s.step = f.step),
ends AS (SELECT tree, pos, arg_max(h, step) AS folded FROM fold GROUP BY tree, pos)
SELECT doc_id, leaf, s.hash AS subroot, (SELECT hash FROM high WHERE n = 1) AS root, coalesce(proof, sha256('')) AS proof_sha256,
  folded AS folded_root, folded = (SELECT hash FROM high WHERE n = 1) AS verified
FROM placed JOIN subroots s USING (tree) JOIN ends USING (tree, pos) LEFT JOIN proofs ON proofs.tree = placed.tree AND leaf_pos = placed.pos
"""
