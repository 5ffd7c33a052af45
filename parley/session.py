"""Session settings and lineage control."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, **settings) -> SparkSession:
    """A session with the settings the operators are tuned for.

    ``master`` is left to spark-submit unless given. Shuffle partitions are left to adaptive execution, which
    coalesces small ones, so only tests and benches set the count.
    """
    builder = (
        SparkSession.builder.appName("parley")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and read it back.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Only a local session without that setting
    gets a folder of its own; a cluster session without it is an error, since a lost executor could not be replaced.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
            folder = tempfile.mkdtemp(prefix="parley-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
