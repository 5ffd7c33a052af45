"""Sample tables of microphones."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .skew import salted_join


def mixed(samples: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Sum of all microphones per sample, clipped to the sample range, as long as microphone 0."""
    length = samples.filter(F.col("mic") == 0).groupBy(*keys).agg(F.max("t_ms").alias("_last"))
    total = samples.groupBy(*keys, "t_ms").agg(F.sum("amplitude").alias("amplitude"))
    kept = salted_join(total, length, keys).filter(F.col("t_ms") <= F.col("_last")).drop("_last")
    return kept.withColumn("amplitude", F.greatest(F.least("amplitude", F.lit(limit)), F.lit(-limit)))


def trimmed(samples: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """Samples of the half-open range, counted from its start."""
    inside = samples.filter((F.col("t_ms") >= start_ms) & (F.col("t_ms") < end_ms))
    return inside.withColumn("t_ms", F.col("t_ms") - start_ms)
