"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
import fcntl
import mmap
import os
import pickle
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import cut_lineage

BATCH_BYTES = 16 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound the bytes of the Arrow batches that Python tasks get; long texts would else fill a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def remainder(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % n


def remainder_of(key, n: int) -> int:
    return zlib.crc32(b"" if key is None else str(key).encode()) % n


def blocks(batches, column: str, most: int = 2 << 20, rows: int = 1 << 30):
    """Slices of Arrow batches whose texts hold about ``most`` bytes; a longer text is a slice of its own."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        at = batch.schema.get_field_index(column)
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start, done = 0, 0
        while start < batch.num_rows:
            end = min(max(start + 1, int(np.searchsorted(ends, done + most, side="right"))), start + rows)
            yield batch.slice(start, end - start)
            start, done = end, int(ends[end - 1])


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer name that the table does not have yet (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def ddl(df: DataFrame) -> str:
    """The columns of a table as the start of a schema text."""
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema.fields)


def once_per_executor(name: str, make):
    """What ``make`` returns, made by one worker; all workers of the executor share the memory of its arrays.

    They map a file in the executor's own local folder, which Spark deletes with the executor. The arrays cannot be written.
    """
    folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
    if not os.path.isdir(folder):
        return make()
    path = os.path.join(folder, name)
    with open(path + ".lock", "w") as lock:
        fcntl.flock(lock, fcntl.LOCK_EX)
        if not os.path.exists(path):
            buffers = []
            head = pickle.dumps(make(), protocol=5, buffer_callback=buffers.append)
            buffers = [b.raw() for b in buffers]
            with open(path + ".part", "wb") as out:
                pickle.dump((head, [b.nbytes for b in buffers]), out)
                for b in buffers:
                    out.write(bytes(-out.tell() % 64))
                    out.write(b)
            os.rename(path + ".part", path)
    with open(path, "rb") as made:
        head, sizes = pickle.load(made)
        at, whole, parts = made.tell(), memoryview(mmap.mmap(made.fileno(), 0, access=mmap.ACCESS_READ)), []
    for size in sizes:
        at += -at % 64
        parts.append(whole[at:at + size])
        at += size
    return pickle.loads(head, buffers=parts)


def give_back() -> None:
    """Give a worker's free memory back to the system: workers serve many stages, and what one of them let go of is no other process's."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim:
        trim(0)


def utf8(text) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass") if isinstance(text, str) else bytes(text)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the checkpoint folder, which all executors reach."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        cut_lineage(spark.range(0))  # sets the folder
    return f"{context.getCheckpointDir()}/{uuid.uuid4()}"


def remove_folder(spark: SparkSession, folder: str) -> None:
    jvm, context = spark.sparkContext._jvm, spark.sparkContext
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
