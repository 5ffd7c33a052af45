"""Row numbers of a total order without a window over a whole key.

The rows are sorted in ranges that Spark cuts from a sample of the data, so a range holds about as many rows as any
other, whatever the keys and however many rows tie in the first columns of the order. A row's number is its place in
its range plus the rows of its key in the ranges before; only those sums, one per range and key, are ordered per key.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage


def ranked(df: DataFrame, order: list, out: str = "rank", keys: tuple[str, ...] | list[str] = (), size: str | None = None,
           total: Mapping[str, Column] | None = None) -> DataFrame:
    """Add ``out``, the 0-based number of each row among the rows of its ``keys`` in the order of ``order``.

    order   names or sort expressions; rows equal in all of them are numbered in any order
    size    name for the number of rows of the key
    total   name -> value: running sums in that order, up to and with the row (NULL counts as 0)

    A null key is a key of its own, and a null in the order comes where the sort expression puts it. The sorted rows are
    written to the checkpoint folder, so the ranges are cut once. An empty table stays empty.
    """
    total = dict(total or {})
    names = df.columns
    taken = set(names) | {out, size, *total}
    part, at, group = (_free(n, taken) for n in ("_part", "_at", "_key"))
    keyed = df.withColumn(group, F.struct(*keys) if keys else F.lit(0))
    ranges = keyed.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = cut_lineage(ranges.select(F.struct(*names).alias("_row"), group, F.spark_partition_id().alias(part), place.alias(at),
                                     *[F.coalesce(c, c * 0, F.lit(0)).alias(f"_total_{n}") for n, c in total.items()]))
    sums = rows.groupBy(part, group).agg(F.count(F.lit(1)).alias("_n"), F.min(at).alias("_first"),
                                         *[F.sum(f"_total_{n}").alias(f"_sum_{n}") for n in total])
    ranges_of_key = Window.partitionBy(group)
    before = ranges_of_key.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select(F.col(part).alias("_p"), F.col(group).alias("_g"),
                        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_carry"),
                        F.sum("_n").over(ranges_of_key).alias("_size"),
                        *[F.sum(f"_sum_{n}").over(before).alias(f"_carry_{n}") for n in total])
    joined = rows.join(carry, (F.col(part) == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")))
    columns = ["_row.*", (F.col(at) + F.col("_carry")).cast("long").alias(out)]
    if size:
        columns.append(F.col("_size").alias(size))
    if total:
        upto = Window.partitionBy(part, group).orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        for n in total:
            inner = F.sum(f"_total_{n}").over(upto)
            columns.append((inner + F.coalesce(F.col(f"_carry_{n}"), inner * 0)).alias(n))
    return joined.select(*columns)


def _free(name: str, taken: set) -> str:
    while name in taken:
        name = "_" + name
    taken.add(name)
    return name
