"""Ordered-series operators.

A window over a whole meeting or person would sort that key in one task, and a single meeting may hold a third of all
rows. ``along`` gives the same columns as such a window but looks at the data first: keys of at most ``ROWS`` rows are
whole windows; where a key has more, it is cut into chunks of at most that many rows, rows are sorted only within a chunk,
one summary row per chunk carries the state, and the summaries are the only thing ordered per key.

The cuts follow the data, not the clock: a key is cut evenly between its lowest and highest value of the order, a piece
that still holds too many rows (a burst) is cut again between its own bounds, and so on; where all values of the first
order column are equal, the next one is cut. Only the bounds of the pieces to cut travel, one row each.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..session import cut_lineage
from .skew import lookup_join

Breaks = Callable[[Column, Column], Column]

ROWS = 65536  # most rows of a chunk, but for rows that are equal in all numeric columns of the order
LEVELS = 64  # times a piece may be cut again; each time it becomes at least two


def chunked(df: DataFrame, key: str, order: list[str], rows: int = 0) -> DataFrame | None:
    """Add ``_chunk``, which ascends with ``order`` inside a key and holds at most ``rows`` rows; None if no key has more.

    ``key`` is one column that is never null (a struct of the keys). The order's numeric columns are cut, from the first
    on; rows without a value come before all others.
    """
    rows = rows or ROWS
    numeric = []
    for name in order:
        if not isinstance(df.schema[name].dataType, T.NumericType):
            break
        numeric.append(name)
    value = {f"_v{i}": F.col(c).cast("double") for i, c in enumerate(numeric)}
    path: list[str] = []
    pieces, left = df, df
    for level in range(LEVELS):
        # Bounds of every piece that is too large, and the first column that is not the same throughout.
        stats = [F.count(F.lit(1)).alias("_n")]
        for i, c in enumerate(value.values()):
            stats += [F.min(c).alias(f"_lo{i}"), F.max(c).alias(f"_hi{i}"), F.count(c).alias(f"_k{i}")]
        large = left.groupBy(key, *path).agg(*stats).filter(F.col("_n") > rows)
        which = F.lit(None).cast("int")
        lo, hi = F.lit(None).cast("double"), F.lit(None).cast("double")
        for i in reversed(range(len(value))):
            varied = (F.col(f"_lo{i}") < F.col(f"_hi{i}")) | ((F.col(f"_k{i}") > 0) & (F.col(f"_k{i}") < F.col("_n")))
            which, lo, hi = F.when(varied, i).otherwise(which), F.when(varied, F.col(f"_lo{i}")).otherwise(lo), F.when(varied, F.col(f"_hi{i}")).otherwise(hi)
        cuts = large.select(key, *path, which.alias("_which"), lo.alias("_lo"), hi.alias("_hi"),
                            F.ceil(F.col("_n") * 2.0 / rows).cast("double").alias("_parts")).filter("_which IS NOT NULL")
        if cuts.isEmpty():
            break
        cuts = cut_lineage(cuts)
        at = F.lit(None).cast("double")
        for i, c in enumerate(value.values()):
            at = F.when(F.col("_which") == i, c).otherwise(at)
        place = F.when(F.col("_hi") > F.col("_lo"), F.floor((at - F.col("_lo")) * (F.col("_parts") / (F.col("_hi") - F.col("_lo"))))).otherwise(0)
        step = f"_c{level}"
        here = F.when(F.col("_which").isNull(), F.lit(0)).when(at.isNull(), F.lit(-1)).otherwise(place).cast("long")
        pieces = lookup_join(pieces, cuts, [key, *path], "left").withColumn(step, here)
        left = pieces.filter("_which IS NOT NULL").drop("_which", "_lo", "_hi", "_parts")
        pieces = pieces.drop("_which", "_lo", "_hi", "_parts")
        path.append(step)
    if not path:
        return None
    return pieces.withColumn("_chunk", F.struct(*path)).drop(*path)


def along(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    *,
    rank: str | None = None,
    lag: Mapping[str, Column] | None = None,
    lead: Mapping[str, Column] | None = None,
    total: Mapping[str, Column] | None = None,
    last: Mapping[str, Column] | None = None,
    first: Mapping[str, Column] | None = None,
    high: Mapping[str, Column] | None = None,
    high_before: Mapping[str, Column] | None = None,
    runs: Mapping[str, tuple[Column, Breaks]] | None = None,
    rows: int = 0,
) -> DataFrame:
    """Add ordered-window columns per ``keys`` in the order of ``order``.

    order   columns that are unique together within a key; the numeric ones it starts with are what a large key is cut by
    rank    name of a 0-based row number
    lag     value in the previous row;            lead   value in the next row
    total   running sum up to and with the row (NULL counts as 0)
    last    last non-NULL value up to and with the row; first   first non-NULL value from the row on
    high    running maximum up to and with the row; high_before   running maximum of the rows before it
    runs    name -> (value, breaks): 0-based number of the run of rows, where ``breaks(previous, current)`` says
            that a new run starts
    rows    most rows of a chunk (``ROWS`` if 0)

    ``lag``/``lead`` keep NULL values. A NULL key is a key of its own, and rows without an order value come first in
    their key: filter before where they should not count.
    """
    lag, lead, total, last = dict(lag or {}), dict(lead or {}), dict(total or {}), dict(last or {})
    first, runs = dict(first or {}), dict(runs or {})
    high, past = dict(high or {}), dict(high_before or {})
    names = df.columns
    inputs = {f"_lag_{n}": c for n, c in lag.items()}
    inputs |= {f"_lead_{n}": c for n, c in lead.items()}
    inputs |= {f"_total_{n}": F.coalesce(c, c * 0, F.lit(0)) for n, c in total.items()}
    inputs |= {f"_last_{n}": c for n, c in last.items()}
    inputs |= {f"_first_{n}": c for n, c in first.items()}
    inputs |= {f"_high_{n}": c for n, c in (high | past).items()}
    inputs |= {f"_run_{n}": c for n, (c, _) in runs.items()}
    keyed = df.withColumn("_key", F.struct(*keys) if keys else F.struct(F.lit(0)))
    cut = chunked(keyed, "_key", order, rows)
    whole = cut is None
    # Whole keys are grouped by their own columns, so that layers over the same keys share one shuffle and sort.
    group = (keys or ["_key"]) if whole else ["_key", "_chunk"]
    series = (cut if not whole else df if keys else keyed).select("*", *[c.alias(n) for n, c in inputs.items()])
    if not whole:
        series = series.repartition(*group)

    inside = Window.partitionBy(*group).orderBy(*order)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    onward = inside.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    # The first row of a chunk cannot know yet whether it breaks a run: that is settled between the chunks.
    breaks = {f"_break_{n}": F.when(F.row_number().over(inside) == 1, False)
              .otherwise(F.coalesce(rule(F.lag(f"_run_{n}").over(inside), F.col(f"_run_{n}")), F.lit(False)))
              .cast("long") for n, (_, rule) in runs.items()}
    flagged = series.withColumns(breaks) if breaks else series

    if whole:
        joined, carried = flagged, lambda name: F.lit(None)
    else:
        joined, carried = flagged.join(_carries(flagged, group, order, rank, lag, lead, total, last, first, high | past, runs), group), F.col

    out = [F.col(c) for c in names]
    if rank:
        out.append((F.row_number().over(inside) - 1 + F.coalesce(carried("_carry_rank"), F.lit(0))).cast("long").alias(rank))
    for n in lag:
        before = F.lag(F.struct(f"_lag_{n}")).over(inside)
        out.append((before if whole else F.coalesce(before, F.col(f"_carry_lag_{n}")))[f"_lag_{n}"].alias(n))
    for n in lead:
        after = F.lead(F.struct(f"_lead_{n}")).over(inside)
        out.append((after if whole else F.coalesce(after, F.col(f"_carry_lead_{n}")))[f"_lead_{n}"].alias(n))
    for n in total:
        inner = F.sum(f"_total_{n}").over(upto)
        out.append((inner + F.coalesce(carried(f"_carry_total_{n}"), inner * 0)).alias(n))
    for n in last:
        out.append(F.coalesce(F.last(f"_last_{n}", ignorenulls=True).over(upto), carried(f"_carry_last_{n}")).alias(n))
    for n in first:
        out.append(F.coalesce(F.first(f"_first_{n}", ignorenulls=True).over(onward), carried(f"_carry_first_{n}")).alias(n))
    for n in high:
        out.append(F.greatest(F.max(f"_high_{n}").over(upto), carried(f"_carry_high_{n}")).alias(n))
    for n in past:
        out.append(F.greatest(F.max(f"_high_{n}").over(earlier), carried(f"_carry_high_{n}")).alias(n))
    for n in runs:
        out.append((F.sum(f"_break_{n}").over(upto) + F.coalesce(carried(f"_carry_run_{n}"), F.lit(0))).alias(n))
    return joined.select(*out)


def _carries(flagged: DataFrame, group: list[str], order: list[str], rank, lag, lead, total, last, first, high, runs) -> DataFrame:
    """What each chunk takes over from the chunks before (or after) it."""
    place = F.struct(*order)
    summary = [F.count(F.lit(1)).alias("_rows")]
    for n in lag:
        summary.append(F.max_by(F.struct(f"_lag_{n}"), place).alias(f"_lag_{n}"))
    for n in lead:
        summary.append(F.min_by(F.struct(f"_lead_{n}"), place).alias(f"_lead_{n}"))
    for n in total:
        summary.append(F.sum(f"_total_{n}").alias(f"_total_{n}"))
    for n in last:
        summary.append(F.max_by(f"_last_{n}", F.when(F.col(f"_last_{n}").isNotNull(), place)).alias(f"_last_{n}"))
    for n in first:
        summary.append(F.min_by(f"_first_{n}", F.when(F.col(f"_first_{n}").isNotNull(), place)).alias(f"_first_{n}"))
    for n in high:
        summary.append(F.max(f"_high_{n}").alias(f"_high_{n}"))
    for n in runs:
        summary += [F.min_by(F.struct(f"_run_{n}"), place).alias(f"_open_{n}"),
                    F.max_by(F.struct(f"_run_{n}"), place).alias(f"_close_{n}"),
                    F.sum(f"_break_{n}").alias(f"_inner_{n}")]
    # Both readers of the shuffled rows touch every column, so that Spark plans one shuffle for the summaries and the
    # rows: everything before it runs once.
    plain = [f.name for f in flagged.schema.fields if not isinstance(f.dataType, T.MapType)]
    summary.append(F.max(F.xxhash64(*plain)).alias("_all"))
    chunks = flagged.groupBy(*group).agg(*summary).filter(F.col("_all").isNotNull())

    between = Window.partitionBy("_key").orderBy("_chunk")
    before = between.rowsBetween(Window.unboundedPreceding, -1)
    after = between.rowsBetween(1, Window.unboundedFollowing)
    carry = []
    if rank:
        carry.append(F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_carry_rank"))
    carry += [F.lag(f"_lag_{n}").over(between).alias(f"_carry_lag_{n}") for n in lag]
    carry += [F.lead(f"_lead_{n}").over(between).alias(f"_carry_lead_{n}") for n in lead]
    carry += [F.sum(f"_total_{n}").over(before).alias(f"_carry_total_{n}") for n in total]
    carry += [F.last(f"_last_{n}", ignorenulls=True).over(before).alias(f"_carry_last_{n}") for n in last]
    carry += [F.first(f"_first_{n}", ignorenulls=True).over(after).alias(f"_carry_first_{n}") for n in first]
    carry += [F.max(f"_high_{n}").over(before).alias(f"_carry_high_{n}") for n in high]
    if runs:
        edge = {f"_edge_{n}": F.coalesce(rule(F.lag(f"_close_{n}").over(between)[f"_run_{n}"],
                                              F.col(f"_open_{n}")[f"_run_{n}"])
                                         & F.lag(f"_close_{n}").over(between).isNotNull(), F.lit(False)).cast("long")
                for n, (_, rule) in runs.items()}
        chunks = chunks.withColumns(edge)
        for n in runs:
            carry.append((F.coalesce(F.sum(F.col(f"_inner_{n}") + F.col(f"_edge_{n}")).over(before), F.lit(0))
                          + F.col(f"_edge_{n}")).alias(f"_carry_run_{n}"))
    return chunks.select(*group, *carry)


def differs(previous: Column, current: Column) -> Column:
    """Run rule: a new run starts when the value changes; NULL equals NULL."""
    return ~previous.eqNullSafe(current)


def neighbours(df: DataFrame, keys: list[str], pos: str, reach: int, value: Column, out: str = "around",
               span: int = 65536) -> DataFrame:
    """Values of the rows within ``reach`` positions, as an array ordered by position.

    ``pos`` is a gapless row number. A key is cut into chunks of ``span`` positions, and only the rows next to a cut
    are copied to the chunk beyond it, so one shuffle does and no key is sorted as a whole.
    """
    if span < reach:
        raise ValueError("span must not be shorter than reach")
    home = F.floor(F.col(pos) / span).cast("long")
    near = F.array(home, F.when(F.col(pos) % span < reach, home - 1), F.when(F.col(pos) % span >= span - reach, home + 1))
    copies = df.withColumns({"_v": value, "_chunk": F.explode(F.filter(near, lambda c: c.isNotNull()))})
    frame = Window.partitionBy(*keys, "_chunk").orderBy(pos).rowsBetween(-reach, reach)
    return (copies.withColumn(out, F.collect_list("_v").over(frame)).filter(F.col("_chunk") == home)
            .drop("_v", "_chunk"))
