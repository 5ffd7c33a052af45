"""Connected components of a graph given as pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage


def components(pairs: DataFrame) -> DataFrame:
    """(node, component) for every node of ``pairs`` (a, b): the smallest node that can be reached.

    Large-star and small-star rounds: each node links its larger neighbours, then its smaller ones, to the smallest of them,
    until nothing changes. Only minima per node are joined back, so a node with very many links is summed up before the
    shuffle and its links are dealt out by the skew join. Every round is written to the checkpoint folder.
    """
    edges = cut_lineage(pairs.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: (u, v) with v > u becomes (v, m); as edges are kept as u > v, the roles swap
        large = (edges.select(F.col("u").alias("v"), F.col("v").alias("u")).join(least, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        # small star: u with all smaller neighbours: they and u go to the smallest
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        stars = large.join(small, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        edges = cut_lineage(stars.select("e.u", "e.v").filter("u <> v").distinct())
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
