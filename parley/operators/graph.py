"""Rank of the nodes of a weighted undirected graph."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .skew import fits


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-6,
             checkpoint_every: int = 5) -> DataFrame:
    """Weighted PageRank of (src, dst, weight), each edge taken in both directions: (word, rank).

    Stops after ``rounds`` or when the ranks move by less than ``tolerance`` per node in total. Every node has an edge,
    so no rank is lost at dead ends. Nodes become numbers and edges are dealt by their source once and kept on the
    executors' disks; a round moves the ranks to the edges, never the edges. A node has at most as many edges as there are nodes.
    """
    edges = cut_lineage(edges.select("src", "dst", "weight"))
    words = edges.select(F.explode(F.array("src", "dst")).alias("word")).filter("word IS NOT NULL").distinct()
    nodes = cut_lineage(words.withColumn("id", F.monotonically_increasing_id()))
    n = nodes.count()
    if not n:
        return nodes.select("word", F.lit(0.0).alias("rank"))
    small = fits(nodes)
    met = lambda rows, side, on: rows.join(F.broadcast(side) if small else side, on)
    coded = edges
    for end in ("src", "dst"):
        coded = met(coded, nodes.select(F.col("word").alias(end), F.col("id").alias(f"_{end}")), end)
    coded = cut_lineage(coded.select(F.col("_src").alias("src"), F.col("_dst").alias("dst"), "weight"))
    both = coded.unionByName(coded.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    out = both.groupBy("src").agg(F.sum("weight").alias("_out"))
    tasks = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    flow = both.repartition(tasks, "src").join(out, "src").select("src", "dst", (F.col("weight") / F.col("_out")).alias("share"))
    flow = flow.repartition(tasks, "src").persist(StorageLevel.DISK_ONLY)
    ranks = nodes.select("id", F.lit(1.0 / n).alias("rank"))
    for number in range(1, rounds + 1):
        moved = met(flow, ranks.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(
            (F.sum(F.col("rank") * F.col("share")) * damping + (1 - damping) / n).alias("rank"))
        look = number % checkpoint_every == 0 or number == rounds
        if look or (number + 1) % checkpoint_every == 0 or number + 1 == rounds:  # ranks that are compared are computed once
            moved = cut_lineage(moved)
        if look:
            last = ranks.withColumnRenamed("rank", "_was")
            change = moved.join(last, "id").agg(F.sum(F.abs(F.col("rank") - F.col("_was")))).first()[0]
        ranks = moved
        if look and change < tolerance * n:
            break
    flow.unpersist()
    return met(ranks, nodes, "id").select("word", "rank")
