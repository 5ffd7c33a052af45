"""Structured Streaming forms of the stateful detectors.

Frames may arrive in any order within the watermark's delay. Keys are dealt to groups by their hash, and every group keeps an
ordered buffer: rows wait in the state store by slots of event time, and an event-time timer fires when the watermark has
passed a slot. Only then are the slot's rows put in frame order and given to the detector, key after key and slot after slot
(slots of few rows together), so a task holds a slot of one group and a few small chunks at a time, and the result does not
depend on how rows were dealt to micro-batches. Rows behind the watermark are late: the stream drops and
counts them (``late_rows``). A row without event time or key has no place in a series and is left out.

A stream that ends (``drain``) gets one last marker row far in the future, so that what waits for the watermark comes out.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.replay import NOD_SCHEMA, NOD_START, lower_edges, median_bins, nod_rows
from ..sources.tables import scratch

END = "9999-01-01 00:00:00"  # event time of the marker that ends a drained stream
LATE = "1 day"
SLOT_MS = 3_600_000
GROUPS = 4096  # that keys are dealt to by their hash
FEW = 1 << 14  # rows of a group in a micro-batch that wait together
MANY = 1 << 16  # rows of slots that are over and go to the detector at once, if a slot does not hold more


class _Ordered(StatefulProcessor):
    """The buffer of one group of keys: chunks of rows by slot, the detector's state of each key, and one timer for the first slot.

    Starting a group, its timer and its output cost far more than a row, so keys share them. A key's state is read only when
    rows of it are due.
    """

    def __init__(self, keys: list[str], columns: list[str], order: str, start: dict, step, slot_ms: int, result: list[str]):
        self.keys, self.columns, self.order, self.start, self.step = keys, columns, order, start, step
        self.slot_ms, self.result, self.few, self.many = slot_ms, result, FEW, MANY
        self.places = [f"k{i}" for i in range(len(keys))]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getMapState("rows", "slot bigint, part int", "rows binary")
        self.states = handle.getMapState("states", "key string", "state string")
        self.held = handle.getValueState("held", "state string")

    def _load(self) -> dict:
        return json.loads(self.held.get()[0]) if self.held.exists() else {"slots": {}, "timer": None}

    def _save(self, held: dict) -> None:
        first = min(map(int, held["slots"]), default=None)
        timer = None if first is None else (first + 1) * self.slot_ms
        if timer != held["timer"]:
            if held["timer"] is not None:
                self.handle.deleteTimer(held["timer"])
            if timer is not None:
                self.handle.registerTimer(timer)
            held["timer"] = timer
        self.held.update((json.dumps(held),))

    def _keep(self, held: dict, rows: pd.DataFrame, slot: int) -> None:
        part = held["slots"].get(str(slot), 0)
        self.rows.updateValue((slot, part), (_packed(rows),))
        held["slots"][str(slot)] = part + 1

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self._load()
        for batch in rows:
            batch = batch[["at_ms", *self.places, *[f"c{i}" for i in range(len(self.columns))]]]
            slots = batch["at_ms"].to_numpy() // self.slot_ms
            if len(batch) <= self.few:  # a chunk under its first slot; it is small, so it may reach into later ones
                self._keep(held, batch, int(slots.min()))
            else:
                for slot in np.unique(slots):
                    self._keep(held, batch[slots == slot], int(slot))
        self._save(held)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._load()
        held["timer"] = None  # it has fired
        done = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()) // self.slot_ms  # slots before it are over
        ready = sorted(s for s in map(int, held["slots"]) if s < done)
        waiting: list[pd.DataFrame] = []
        for slot, following in zip(ready, [*ready[1:], done]):
            for part in range(held["slots"].pop(str(slot))):
                waiting.append(_unpacked(self.rows.getValue((slot, part))[0]))
                self.rows.removeKey((slot, part))
            if following < done and sum(map(len, waiting)) < self.many:
                continue  # few rows, so those of the following slot join them
            # no chunk that is still to be read reaches below the following slot
            rows = pd.concat(waiting, ignore_index=True) if len(waiting) > 1 else waiting[0]
            over = rows["at_ms"].to_numpy() < following * self.slot_ms
            waiting = [] if over.all() else [rows[~over]]
            if over.any():
                yield self._stepped(rows[over])
        if waiting:
            rows = pd.concat(waiting, ignore_index=True)
            self._keep(held, rows, int(rows["at_ms"].min()) // self.slot_ms)
        self._save(held)

    def _stepped(self, rows: pd.DataFrame) -> pd.DataFrame:
        """The results of rows whose time has come, key after key."""
        place = rows.groupby(self.places, sort=False).ngroup().to_numpy()
        table = rows[[f"c{i}" for i in range(len(self.columns))]].set_axis(self.columns, axis=1)
        sort = table[self.order].reset_index(drop=True).sort_values(kind="stable").index.to_numpy()
        sort = sort[np.argsort(place[sort], kind="stable")]
        table, names = table.iloc[sort], rows[self.places].iloc[sort]
        starts = np.flatnonzero(np.diff(place[sort], prepend=-1))
        results = []
        for name, a, b in zip(zip(*(names[c].iloc[starts] for c in self.places)), starts, [*starts[1:], len(table)]):
            name = json.dumps([str(x) for x in name])
            before = self.states.getValue((name,)) if self.states.containsKey((name,)) else None
            state, result = self.step(self.start if before is None else json.loads(before[0]), table.iloc[a:b].reset_index(drop=True))
            self.states.updateValue((name,), (json.dumps(state),))
            results.append(result)
        out = pd.concat(results, ignore_index=True)
        at = np.repeat(starts, [len(r) for r in results])
        for key, c in zip(self.keys, self.places):
            out[key] = names[c].iloc[at].to_numpy()
        return out[self.result]


def _packed(rows: pd.DataFrame) -> bytes:
    batch, sink = pa.RecordBatch.from_pandas(rows, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(rows: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(bytes(rows)).read_pandas()


def _stateful(df: DataFrame, keys: list[str], order: str, columns: list[str], start: dict, step: Callable, schema: str,
              late: str, slot_ms: int, where: Column | None = None) -> DataFrame:
    """``step(state, rows in order) -> (state, result rows)`` over each key of a stream with the event time ``ts``."""
    spark = df.sparkSession
    # Buffers wait in the state store, not in memory.
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    types = dict(df.dtypes)
    out = ", ".join(f"{k} {types[k]}" for k in keys) + ", " + schema
    timed = _timed(df, late)
    if where is not None:
        timed = timed.filter(where)
    for k in keys:
        timed = timed.filter(F.col(k).isNotNull())
    # Rows reach the processor as named tuples, so they travel under names that are fit for those.
    plain = timed.select(F.pmod(F.xxhash64(*keys), F.lit(GROUPS)).alias("dealt"), *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], "ts", F.unix_millis("ts").alias("at_ms"),
                         *[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)])
    names = [f.name for f in T._parse_datatype_string(out).fields]
    work = _Ordered(keys, columns, order, start, step, slot_ms, names)
    return plain.groupBy("dealt").transformWithStateInPandas(work, out, "Append", "EventTime")


def _timed(df: DataFrame, late: str) -> DataFrame:
    """The stream with its watermark; the marker of the end moves the watermark and goes no further.

    Every column is bound to the event time, as Spark would else move filters on it before the watermark, where they would
    take the marker away.
    """
    known = df.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    real = F.col("ts") < F.lit(END).cast("timestamp")
    return known.select(*[F.col(c) if c == "ts" else F.when(real, F.col(c)).alias(c) for c in df.columns]).filter(real)


def nod_stream(df: DataFrame, keys: list[str], k: int = 3, late: str = LATE, slot_ms: int = SLOT_MS) -> DataFrame:
    """Nod flags as frames arrive (ts, frame, x, y, height); the same step as the batch job."""
    return _stateful(df, keys, "frame", ["frame", "x", "y", "height"], NOD_START, lambda s, r: nod_rows(s, r, k), NOD_SCHEMA, late, slot_ms,
                     F.col("frame") % k == 0)


def median_stream(df: DataFrame, keys: list[str], bins: int, low: float, high: float, late: str = LATE, slot_ms: int = SLOT_MS) -> DataFrame:
    """Running histogram median of (ts, frame, value, success), taking every second row of a key."""

    def step(state: dict, rows: pd.DataFrame):
        looked = (state["seen"] + np.arange(len(rows))) % 2 == 0
        used = looked & rows["success"].to_numpy(bool)
        place = np.clip((rows["value"].to_numpy(float) - low) * bins / (high - low), 0, bins - 1).astype(int)
        counts, parts = np.array(state["counts"]), []
        for at in range(0, len(rows), 1024):
            so_far = _counted(counts, place[at:at + 1024], used[at:at + 1024])
            parts.append(median_bins(so_far, rows["value"].to_numpy(float)[at:at + 1024], bins, low, high))
            counts = so_far[-1]
        shown = pd.Series(np.concatenate([[np.nan if state["shown"] is None else state["shown"]], np.where(looked, np.concatenate(parts), np.nan)])).ffill()
        state = {"counts": counts.tolist(), "seen": (state["seen"] + len(rows)) % 2, "shown": float(shown.iloc[-1])}
        return state, pd.DataFrame({"frame": rows["frame"], "median": shown.iloc[1:].to_numpy()})

    start = {"counts": [0] * bins, "seen": 0, "shown": None}
    return _stateful(df, keys, "frame", ["frame", "value", "success"], start, step, "frame long, median double", late, slot_ms)


def correction_stream(df: DataFrame, keys: list[str], ratio: float = 0.10, bins: int = 200, low: float = -3.0,
                      high: float = 5.0, at_least: int = 10, late: str = LATE, slot_ms: int = SLOT_MS) -> DataFrame:
    """Online baseline correction of (ts, frame, value), clipped to 0..5."""

    def step(state: dict, rows: pd.DataFrame):
        value = rows["value"].to_numpy(float)
        place = np.clip((value - low) * bins / (high - low), 0, bins - 1).astype(int)
        counts, parts = np.array(state["counts"]), []
        for at in range(0, len(rows), 1024):
            so_far = _counted(counts, place[at:at + 1024], np.ones(len(place[at:at + 1024]), bool))
            parts.append(lower_edges(so_far, ratio, bins, low, high, at_least))
            counts = so_far[-1]
        fixed = np.clip(value - np.concatenate(parts), 0.0, 5.0)
        return {"counts": counts.tolist()}, pd.DataFrame({"frame": rows["frame"], "corrected": fixed})

    return _stateful(df, keys, "frame", ["frame", "value"], {"counts": [0] * bins}, step, "frame long, corrected double", late, slot_ms)


def _counted(before: np.ndarray, place: np.ndarray, used: np.ndarray) -> np.ndarray:
    """Histogram after each row of a block, as the rows of a matrix."""
    filled = np.zeros((len(place), len(before)), dtype=np.int64)
    filled[np.flatnonzero(used), place[used]] = 1
    return before + filled.cumsum(axis=0)


def carry_stream(df: DataFrame, keys: list[str], values: list[str], late: str = LATE, slot_ms: int = SLOT_MS) -> DataFrame:
    """Unseen rows (ts, frame, seen, label, values) keep the last seen values; their label becomes Unknown."""

    def step(state: dict, rows: pd.DataFrame):
        held = pd.DataFrame([state["values"]]) if state["values"] else pd.DataFrame([dict.fromkeys(values)])
        seen = rows["seen"].astype(bool)
        known = rows[values].where(seen)
        filled = pd.concat([held[values].astype(float), known.astype(float)], ignore_index=True).ffill().iloc[1:].reset_index(drop=True)
        last = {c: None if pd.isna(filled[c].iloc[-1]) else float(filled[c].iloc[-1]) for c in values}
        out = pd.DataFrame({"frame": rows["frame"], **{c: filled[c] for c in values}, "label": rows["label"].where(seen, "Unknown")})
        return {"values": last}, out

    schema = "frame long, " + ", ".join(f"{c} double" for c in values) + ", label string"
    return _stateful(df, keys, "frame", ["frame", "seen", "label", *values], {"values": None}, step, schema, late, slot_ms)


def live_panel(events: DataFrame, utterances: DataFrame, every: str, late: str, width: int) -> DataFrame:
    """Label counts per event-time window and utterance: (ts, meeting, time_ms, label) joined to the utterance at hand.

    The static utterances are spread over time buckets, so the stream meets them in an equi-join; rows later than the
    watermark are dropped.
    """
    at = lambda c: F.floor(F.col(c) / width).cast("long")
    spread = (utterances.filter("end_ms > start_ms")
              .withColumn("_bucket", F.explode(F.sequence(at("start_ms"), at("end_ms"))))
              .select(F.col("meeting").alias("_m"), "_bucket", "ord", "start_ms", "end_ms"))
    timed = _timed(events, late).withColumn("_b", at("time_ms"))
    met = timed.join(spread, (timed["meeting"] == spread["_m"]) & (timed["_b"] == spread["_bucket"])
                     & (timed["time_ms"] >= spread["start_ms"]) & (timed["time_ms"] < spread["end_ms"]))
    counts = met.groupBy(F.window("ts", every), "meeting", "ord", "label").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("window.start").alias("start"), "meeting", "ord", "label", "n")


def ending(events: DataFrame, spark: SparkSession) -> tuple[DataFrame, Callable[[], None]]:
    """The stream together with a marker that can be sent later: ``(stream, send)``.

    ``events`` has the event time ``ts``. After ``send()`` the next micro-batch carries one row that is null but for a time
    far in the future, which moves the watermark past everything that waits.
    """
    folder = scratch(spark, "end")
    schema = T.StructType([T.StructField(f.name, T.TimestampType() if f.name == "ts" else f.dataType) for f in events.schema.fields])
    spark.createDataFrame([], schema).write.parquet(folder)
    markers = spark.readStream.schema(schema).parquet(folder)
    both = events.withColumn("ts", F.col("ts").cast("timestamp")).unionByName(markers)

    def send() -> None:
        row = spark.range(1).select(*[F.lit(END).cast("timestamp").alias(f.name) if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name)
                                      for f in schema.fields])
        row.write.mode("append").parquet(folder)

    return both, send


def drain(build: Callable[[DataFrame], DataFrame], events: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    """Run ``build(events)`` over everything that is there now into a Parquet folder, let what waits come out, and read
    that back. The rows that came too late are in ``late_rows(result)``."""
    folder = scratch(spark, name)
    both, send = ending(events, spark)
    stream = build(both)
    late = 0
    for last in (False, True):
        if last:
            send()
        query = (stream.writeStream.format("parquet").option("path", f"{folder}/rows").outputMode("append")
                 .option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start())
        query.awaitTermination()
        late += sum(int(s["numRowsDroppedByWatermark"]) for p in query.recentProgress for s in p["stateOperators"])
    out = spark.read.schema(stream.schema).parquet(f"{folder}/rows")
    out._late_rows = late
    return out


def late_rows(drained: DataFrame) -> int:
    """How many rows a drained stream dropped for being behind the watermark."""
    return drained._late_rows
