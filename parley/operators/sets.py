"""Label sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def missing(df: DataFrame, keys: list[str], label: str, labels: list | DataFrame) -> DataFrame:
    """Labels of a fixed set (a list, or the column ``label`` of a table) that a key does not have, for filling with zeros."""
    have = df.groupBy(*keys).agg(F.collect_set(label).alias("_have"))  # at most the fixed set
    if isinstance(labels, DataFrame):
        every = labels.groupBy(F.lit(0).alias("_one")).agg(F.collect_set(label).alias("_every"))
        have = have.withColumn("_one", F.lit(0)).join(F.broadcast(every), "_one")  # one row
    else:
        have = have.withColumn("_every", F.array(*[F.lit(x) for x in labels]))
    return have.select(*keys, F.explode(F.array_except("_every", "_have")).alias(label))
