"""Frame-series features: filters, sliding windows, smoothing, interpolation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.permute import permuted
from ..functions.vectors import bind, standardised
from ..session import cut_lineage
from .series import along, neighbours
from .skew import lookup_join, salted_join

NARROW_ROWS = 1_000_000  # rows of two or three numbers that may be broadcast

STATISTICS = ["mean", "std", "mad", "max", "min", "energy", "entropy", "iqr", "range", "skewness", "kurtosis"]


def confident(df: DataFrame, column: str = "confidence", threshold: float = 0.8) -> DataFrame:
    """Drop rows below the threshold; a missing or NaN confidence is kept."""
    return df.filter(~(F.col(column) < threshold) | F.col(column).isNull())


def _bad(column: str) -> Column:
    return F.col(column).isNull() | F.isnan(column) | (F.abs(F.col(column)) == F.lit(math.inf))


def finite_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Drop rows with a missing, NaN or infinite value in any of the columns."""
    for c in columns:
        df = df.filter(~_bad(c))
    return df


def finite_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Drop those of the columns that hold a missing, NaN or infinite value anywhere; one pass, one result row."""
    found = df.agg(*[F.max(_bad(c)).alias(c) for c in columns]).first()
    return df.drop(*[c for c in columns if found[c]])


def sliding_windows(df: DataFrame, keys: list[str], order: list[str], width: int = 32,
                    hop: int = 16) -> DataFrame:
    """Rows with the numbers of the positional windows they are in: column ``win``, one row per row and window.

    Positions count the rows that are left in ``df``. ``(n - width) // hop`` windows are kept, so the last full one is
    left out. A row is in ``width / hop`` windows, worked out from its position without any join.
    """
    pos = along(df, keys, order, rank="_pos")
    counts = df.groupBy(*keys).agg(F.floor((F.count(F.lit(1)) - width) / hop).cast("long").alias("_windows"))
    last = F.floor(F.col("_pos") / hop).cast("long")
    each = F.array(*[last - d for d in range(math.ceil(width / hop))])
    rows = pos.withColumn("win", F.explode(each)).filter(
        (F.col("win") >= 0) & (F.col("_pos") < F.col("win") * hop + width))
    return salted_join(rows, counts, keys).filter("win < _windows").drop("_windows")


def window_statistics(rows: DataFrame, keys: list[str], axes: dict[str, str], frame: str | None = None,
                      time: str | None = None) -> DataFrame:
    """Eleven statistics per window and axis, named ``<statistic>_<axis>``, with the frame and time bounds.

    ``axes`` maps the axis name to its column. Entropy, skewness and kurtosis of a constant window are NULL.
    """
    first, rest = [], []
    if frame:
        first += [F.min_by(frame, "_pos").alias("frame_in"), F.max_by(frame, "_pos").alias("frame_out")]
    if time:
        first += [F.min_by(time, "_pos").alias("timestamp_in"), F.max_by(time, "_pos").alias("timestamp_out")]
    for axis, column in axes.items():
        x = F.col(column)
        first += [F.avg(x).alias(f"mean_{axis}"), F.stddev_pop(x).alias(f"std_{axis}"), F.max(x).alias(f"max_{axis}"),
                  F.min(x).alias(f"min_{axis}"), F.avg(x * x).alias(f"energy_{axis}"),
                  F.skewness(x).alias(f"skewness_{axis}"), F.kurtosis(x).alias(f"kurtosis_{axis}"),
                  F.sort_array(F.collect_list(x)).alias(f"_{axis}")]  # at most one window of values
        values = F.col(f"_{axis}")
        gap = F.col(f"max_{axis}") - F.col(f"min_{axis}")
        spread = F.transform(values, lambda e: F.abs(e - _quantile(values, 0.5)))
        total = F.aggregate(values, F.lit(0.0), lambda s, e: s + (e - F.col(f"min_{axis}")))
        parts = bind(total, lambda t: F.transform(values, lambda e: F.try_divide(e - F.col(f"min_{axis}"), t)))
        rest += [_quantile(F.sort_array(spread), 0.5).alias(f"mad_{axis}"),
                 F.aggregate(parts, F.lit(0.0), lambda s, p: s + F.when(p > 0, -p * F.ln(p)).otherwise(
                     F.when(p.isNull(), F.lit(None).cast("double")).otherwise(0.0))).alias(f"entropy_{axis}"),
                 (_quantile(values, 0.75) - _quantile(values, 0.25)).alias(f"iqr_{axis}"), gap.alias(f"range_{axis}")]
    grouped = rows.groupBy(*keys, "win").agg(*first)
    bounds = [c for c in ("frame_in", "frame_out", "timestamp_in", "timestamp_out") if c in grouped.columns]
    made = grouped.select("*", *rest)
    return made.select(*keys, "win", *bounds, *[f"{s}_{a}" for a in axes for s in STATISTICS])


def _quantile(ordered: Column, q: float) -> Column:
    """Quantile of a sorted array by linear interpolation."""
    place = (F.size(ordered) - 1) * F.lit(q)
    low = F.floor(place).cast("int")
    a = ordered[low]
    b = ordered[F.least(low + 1, F.size(ordered) - 1)]
    return a + (b - a) * (place - low)


def window_faces(rows: DataFrame, keys: list[str], x: str, y: str, chin: str) -> DataFrame:
    """Median face centre and radius per window."""
    return rows.groupBy(*keys, "win").agg(F.median(x).alias("face_x"), F.median(y).alias("face_y"),
                                          F.median(F.abs(F.col(chin) - F.col(y))).alias("face_radius"))


def window_success(rows: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """Share of non-zero flags per window."""
    return rows.groupBy(*keys, "win").agg(F.avg(F.when(F.col(flag) != 0, 1.0).otherwise(0.0)).alias("success"))


def window_votes(windows: DataFrame, keys: list[str]) -> DataFrame:
    """Window predictions to frames: the first window's face, cut to whole numbers, its prediction plus one for each later
    positive window."""
    frames = (windows.filter(F.col("frame_out") >= F.col("frame_in"))
              .withColumn("frame", F.explode(F.sequence("frame_in", "frame_out"))))
    votes = frames.groupBy(*keys, "frame").agg(
        *[F.min_by(c, "win").cast("long").alias(c) for c in ("face_x", "face_y", "face_radius")],
        F.min_by("pred", "win").alias("_first"), F.sum(F.when(F.col("pred") == 1, 1).otherwise(0)).alias("_ones"))
    pred = F.col("_first") + F.col("_ones") - F.when(F.col("_first") == 1, 1).otherwise(0)
    return votes.withColumn("pred", pred).drop("_first", "_ones").withColumn("is_nod", F.col("pred") > 1)


def changed_values(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Drop zeros, then rows that repeat the previous value; the first row stays."""
    seen = along(df.filter(F.col(value) != 0), keys, [order], lag={"_was": F.col(value)})
    return seen.filter(F.col("_was").isNull() | (F.col("_was") != F.col(value))).drop("_was")


def standardise(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """(value - mean) / sample standard deviation per key."""
    spread = df.groupBy(*keys).agg(F.avg(value).alias("_mu"), F.stddev_samp(value).alias("_sd"))
    return (salted_join(df, spread, keys)
            .withColumn(out, F.try_divide(F.col(value) - F.col("_mu"), F.col("_sd"))).drop("_mu", "_sd"))


def motion(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """Signed (previous - current) and absolute step of each column; NULL in the first row."""
    seen = along(df, keys, [order], lag={f"_{c}": F.col(c) for c in columns})
    for c in columns:
        step = F.col(f"_{c}") - F.col(c)
        seen = seen.withColumns({f"relative_{c}": step, f"absolute_{c}": F.abs(step)}).drop(f"_{c}")
    return seen


def moving_average(df: DataFrame, keys: list[str], pos: str, value: str, out: str) -> DataFrame:
    """Centred mean of three; the two ends stay as they are."""
    near = neighbours(df, keys, pos, 1, F.col(value))
    mean = F.aggregate("around", F.lit(0.0), lambda s, x: s + x) / 3
    return near.withColumn(out, F.when(F.size("around") < 3, F.col(value)).otherwise(mean)).drop("around")


def majority(df: DataFrame, keys: list[str], pos: str, flag: str, out: str) -> DataFrame:
    """Centred majority of seven 0/1 values, a half counting as 1; the three rows at each end stay as they are."""
    near = neighbours(df, keys, pos, 3, F.col(flag))
    mean = F.aggregate("around", F.lit(0.0), lambda s, x: s + x) / 7
    voted = F.when(mean < 0.5, 0).otherwise(1)
    return near.withColumn(out, F.when(F.size("around") < 7, F.col(flag)).otherwise(voted)).drop("around")


def order_statistics(df: DataFrame, keys: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """Exact order statistics per key: ``ranks`` maps a name to a 0-based rank in terms of the row count ``n``.

    Equal values are counted before anything is sorted and the distinct values are swept in chunks, so neither a hot
    key nor a hot value ends up in one task.
    """
    known = df.filter(F.col(value).isNotNull())
    counts = known.groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    swept = along(counts, keys, ["_v"], total={"_upto": F.col("_c")})
    sizes = counts.groupBy(*keys).agg(F.sum("_c").alias("n"))
    placed = salted_join(swept, sizes, keys)
    pick = lambda r: F.max(F.when((F.col("_upto") - F.col("_c") <= r) & (r < F.col("_upto")), F.col("_v")))
    return placed.groupBy(*keys).agg(*[pick(r).alias(name) for name, r in ranks.items()])


def medians(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Exact medians of several columns per key, found in one sweep."""
    long = df.select(*keys, F.explode(F.create_map(*[c for v in values for c in (F.lit(v), F.col(v).cast("double"))]))
                     .alias("_axis", "_value"))
    n = F.col("n")
    ranks = {"_lo": F.floor((n - 1) / 2), "_hi": F.floor(n / 2)}
    both = order_statistics(long, [*keys, "_axis"], "_value", ranks)
    mid = (F.col("_lo") + F.col("_hi")) / 2
    return both.groupBy(*keys).agg(*[F.max(F.when(F.col("_axis") == v, mid)).alias(v) for v in values])


def baseline_shift(df: DataFrame, keys: list[str], value: str, valid: str, cutoff: float,
                   out: str) -> DataFrame:
    """Subtract the value at rank ``int(n * cutoff)`` of the valid ones, clip to 0..5; 0 where not valid."""
    base = order_statistics(df.filter(F.col(valid)), keys, value,
                            {"_base": F.floor(F.col("n") * F.lit(cutoff))})
    shifted = salted_join(df, base, keys, "left")
    clipped = F.greatest(F.least(F.col(value) - F.coalesce("_base", F.lit(0.0)), F.lit(5.0)), F.lit(0.0))
    return shifted.withColumn(out, F.when(F.col(valid), clipped).otherwise(0.0)).drop("_base")


def _centred(df: DataFrame) -> DataFrame:
    return df.withColumns({"_cy": (F.col("top") + F.col("bottom")) / 2, "_cx": (F.col("left") + F.col("right")) / 2})


def median_centres(df: DataFrame, keys: list[str]) -> DataFrame:
    """Median box centre (my, mx) per person."""
    return medians(_centred(df), keys, ["_cy", "_cx"]).withColumnsRenamed({"_cy": "my", "_cx": "mx"})


def near_median_boxes(df: DataFrame, middle: DataFrame, keys: list[str], width: float, reach: float = 0.1) -> DataFrame:
    """Boxes whose centre is closer to the person's median centre than ``reach`` times the frame width."""
    both = lookup_join(_centred(df), cut_lineage(middle), keys, limit=NARROW_ROWS)
    dy, dx = F.col("_cy") - F.col("my"), F.col("_cx") - F.col("mx")
    return both.filter(F.sqrt(dy * dy + dx * dx) < reach * width).select(*df.columns)


def interpolate_boxes(df: DataFrame, keys: list[str], lengths: DataFrame) -> DataFrame:
    """Every frame 0..n-1 of a person: detected boxes as they are, gaps filled linearly and cut to whole pixels.

    ``lengths`` holds ``n`` per key. Frames before the first or after the last detection have NULL boxes; persons seen
    in one frame only are left out. Each detection produces its own gap, so no frame grid is joined.
    """
    sides = ["top", "right", "bottom", "left"]
    next_box = F.struct("frame", *sides)
    known = cut_lineage(df.select(*keys, "frame", *sides))  # looked at for its counts, then swept
    seen = along(known, keys, ["frame"], lead={"_next": next_box}, lag={"_prev": F.col("frame")})
    seen = seen.filter(F.col("_next").isNotNull() | F.col("_prev").isNotNull())
    whole = lookup_join(seen, cut_lineage(lengths), keys, limit=NARROW_ROWS)
    until = F.when(F.col("_next").isNull(), F.col("n") - 1).otherwise(F.col("_next.frame") - 1)
    since = F.when(F.col("_prev").isNull(), F.lit(0)).otherwise(F.col("frame"))
    grid = whole.withColumn("_f", F.explode(F.sequence(since, F.greatest(until, F.col("frame")))))
    values = []
    for s in sides:
        slope = (F.col(f"_next.{s}") - F.col(s)) / (F.col("_next.frame") - F.col("frame"))
        filled = (slope * (F.col("_f") - F.col("frame")) + F.col(s)).cast("int")
        values.append(F.when(F.col("_f") == F.col("frame"), F.col(s)).when(F.col("_f") > F.col("frame"), filled).alias(s))
    return grid.select(*keys, F.col("_f").alias("frame"), *values, (F.col("_f") == F.col("frame")).alias("is_detected"))


def outer_boxes(df: DataFrame, keys: list[str]) -> DataFrame:
    """Smallest box (x, y, w, h) around all boxes of a key."""
    x, y = F.min("x"), F.min("y")
    return df.groupBy(*keys).agg(x.alias("x"), y.alias("y"), (F.max(F.col("x") + F.col("w")) - x).alias("w"),
                                 (F.max(F.col("y") + F.col("h")) - y).alias("h"))


def carry_known(df: DataFrame, keys: list[str], order: str, values: list[str], seen: str,
                label: str) -> DataFrame:
    """Unseen rows keep the last seen values; their label becomes Unknown."""
    known = {f"_{c}": F.when(F.col(seen), F.col(c)) for c in values}
    rows = along(df, keys, [order], last=known)
    return rows.select(*[c for c in df.columns if c not in values and c != label],
                       *[F.col(f"_{c}").alias(c) for c in values],
                       F.when(F.col(seen), F.col(label)).otherwise("Unknown").alias(label))


def silent_ranges(df: DataFrame, keys: list[str], order: str, level: str, threshold: float, min_rows: int) -> DataFrame:
    """Runs of at least ``min_rows`` rows at or below the threshold.

    The search that lowers the threshold by 5 dB until it finds silence gives the same: a lower threshold only ever
    makes fewer rows silent, so where the first threshold finds nothing, none does.
    """
    quiet = df.select(*keys, order, (F.col(level) <= threshold).alias("_quiet"))
    runs = along(quiet, keys, [order], runs={"run": (F.col("_quiet"), lambda a, b: a != b)})
    return (runs.groupBy(*keys, "run").agg(F.max("_quiet").alias("_quiet"), F.min(order).alias("start"),
                                           F.max(order).alias("last"), F.count(F.lit(1)).alias("rows"))
            .filter(F.col("_quiet") & (F.col("rows") >= min_rows)).select(*keys, "start", "last", "rows"))


def real_hop_windows(df: DataFrame, keys: list[str], pos: str, vector: str, width: int, hop: float) -> DataFrame:
    """Windows of ``width`` vectors starting at ``int(i * hop + 0.5)``, each vector standardised by itself.

    Window i is kept while it fits into the series; the windows of a row follow from its position.
    """
    sizes = df.groupBy(*keys).agg((F.max(pos) + 1).alias("_n"))
    lo = F.greatest(F.floor((F.col(pos) - width) / hop).cast("long"), F.lit(0).cast("long"))
    rows = df.withColumn("win", F.explode(F.sequence(lo, F.floor(F.col(pos) / hop).cast("long") + 1)))
    start = F.floor(F.col("win") * F.lit(hop) + 0.5).cast("long")
    inside = rows.withColumn("_start", start).filter(
        (F.col(pos) >= F.col("_start")) & (F.col(pos) < F.col("_start") + width))
    fit = salted_join(inside, sizes, keys).filter(F.col("_start") + width <= F.col("_n"))
    return fit.withColumn(vector, standardised(F.col(vector))).drop("_start", "_n")


def index_blocks(df: DataFrame, keys: list[str], order: str, index: str) -> DataFrame:
    """Number the blocks of consecutive indexes: a block ends where the next index is not one higher."""
    return along(df, keys, [order], runs={"block": (F.col(index), lambda a, b: b != a + 1)})


def permuted_blocks(df: DataFrame, keys: list[str], order: str, samples: int, seed: int, tweak: Column | int = 0) -> DataFrame:
    """Random orders of the blocks of each key, rows inside a block staying together: column ``place`` per sample.

    Block numbers are permuted by a keyed bijection, so orders are repeatable and drawn without sorting. ``tweak`` is a number
    that tells keys apart; keys with the same tweak and as many blocks get the same orders.
    """
    blocks = df.groupBy(*keys, "block").agg(F.count(F.lit(1)).alias("_size"), F.min(order).alias("_from"))
    count = blocks.groupBy(*keys).agg(F.count(F.lit(1)).alias("_blocks"))
    number = F.lit(tweak) if isinstance(tweak, int) else tweak
    each = salted_join(blocks, count, keys).withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    drawn = each.withColumn("_draw", permuted(F.col("block"), F.col("_blocks"), seed, number.cast("long") * samples + F.col("sample")))
    placed = along(drawn, [*keys, "sample"], ["_draw"], total={"_end": F.col("_size")})
    placed = placed.select(*keys, "block", "sample", "_from", (F.col("_end") - F.col("_size")).alias("_base"))
    return (df.join(placed, [*keys, "block"])
            .withColumn("place", F.col("_base") + F.col(order) - F.col("_from")).drop("_base", "_from"))
