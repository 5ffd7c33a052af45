"""Media columns: audio clips, their log-mel tensors and the spans in which they sound.

A clip is a WAV file of 8-bit mono samples in a binary column. Features are computed per clip: polyphase resampling by
2/5, log-mel energies of overlapping frames, and spans found by an energy threshold with hysteresis. The log-mel frames are
stored as an Arrow stream of fixed-shape tensors (frames x bands) with the time span of each tensor. A clip is read in
blocks, so its length is bounded only by the row itself.

A null text is an empty payload. Payloads are filled up with zeros to a positive multiple of 64 bytes. Equal texts give
equal clips and features, whatever rows are beside them. A clip that is null or no 8-bit mono WAV file gives null features.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

from .common import blocks, bounded_batches, ddl, free_name, utf8

UNIT = 64
RATE, UP, DOWN, TAPS = 8000, 2, 5, 16
FRAME, HOP, BANDS, TENSOR = 256, 128, 24, 32
ENTER_DB, LEAVE_DB = -8.0, -12.0  # a span opens at the first level and ends below the second
BLOCK = 1 << 15  # frames and samples that are computed at once


def wav(payload: bytes) -> bytes:
    """The samples as a WAV file."""
    n = len(payload)
    head = b"RIFF" + struct.pack("<I", (36 + n) & 0xFFFFFFFF) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8)
    return head + b"data" + struct.pack("<I", n & 0xFFFFFFFF) + payload


def samples(clip: bytes | None) -> bytes | None:
    """The samples of a WAV file, or None if it is not one of 8-bit mono samples."""
    if clip is None or clip[:4] != b"RIFF" or clip[8:12] != b"WAVE":
        return None
    at, form = 12, None
    while at + 8 <= len(clip):
        kind, n = clip[at:at + 4], struct.unpack("<I", clip[at + 4:at + 8])[0]
        if kind == b"fmt ":
            form = struct.unpack("<HHIIHH", clip[at + 8:at + 24])
        elif kind == b"data":
            return clip[at + 8:at + 8 + n] if form and form[:2] == (1, 1) and form[5] == 8 else None
        at += 8 + n + n % 2
    return None


@lru_cache(maxsize=1)
def kernels():
    """The phases of the low-pass filter, the frame window and the mel filterbank."""
    import numpy as np

    n = np.arange(UP * TAPS) - (UP * TAPS - 1) / 2
    cut = 1 / max(UP, DOWN)
    low = cut * np.sinc(cut * n) * np.hamming(UP * TAPS) * UP
    phases = np.stack([low[p::UP][::-1] for p in range(UP)]).astype(np.float32)
    rate = RATE * UP / DOWN
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), BANDS + 2) / 2595) - 1)
    bins = np.arange(FRAME // 2 + 1) * rate / FRAME
    rise = (bins[:, None] - edges[None, :-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[None, 2:] - bins[:, None]) / (edges[2:] - edges[1:-1])
    return phases, np.hanning(FRAME).astype(np.float32), np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def resample(payload: bytes):
    """The samples at 2/5 of the rate: output n is the dot product of phase (n * DOWN) % UP with the samples around it."""
    import numpy as np
    from numpy.lib.stride_tricks import sliding_window_view

    phases = kernels()[0]
    x = np.frombuffer(payload, np.uint8)
    out = np.empty(-(-len(x) * UP // DOWN), np.float32)
    step = BLOCK // DOWN * DOWN
    for start in range(0, len(x), step):
        part = np.zeros(min(step, len(x) - start) + TAPS + DOWN, np.float32)
        lo, hi = max(0, start - TAPS // 2), min(len(x), start + step + TAPS // 2)
        at = lo - (start - TAPS // 2)
        got = x[lo:hi][:len(part) - at]
        part[at:at + len(got)] = (got.astype(np.float32) - 128) / 128
        windows, first = sliding_window_view(part, TAPS), start * UP // DOWN
        count = -(-min(step, len(x) - start) * UP // DOWN)
        n = np.arange(count) * DOWN
        for p in range(UP):
            use = n % UP == p
            out[first:first + count][use] = windows[n[use] // UP] @ phases[p]
    return out


def log_mel(signal):
    """Natural log of the mel energies of overlapping frames, and the level of each frame in dB. The end is filled with zeros."""
    import numpy as np
    from numpy.lib.stride_tricks import sliding_window_view

    _, window, bank = kernels()
    frames = max(1, -(-max(0, len(signal) - FRAME) // HOP) + 1)
    padded = np.zeros((frames - 1) * HOP + FRAME, np.float32)
    padded[:len(signal)] = signal
    view = sliding_window_view(padded, FRAME)[::HOP]
    mel, level = np.empty((frames, BANDS), np.float32), np.empty(frames, np.float32)
    for s in range(0, frames, 2048):
        part = view[s:s + 2048]
        power = np.abs(np.fft.rfft(part * window, axis=1)) ** 2
        mel[s:s + 2048] = np.log(power.astype(np.float32) @ bank + 1e-6)
        level[s:s + 2048] = 10 * np.log10((part * part).mean(axis=1) + 1e-9)
    return mel, level


def sounding(level) -> list[tuple[float, float]]:
    """Spans in seconds: they open where the level reaches ``ENTER_DB`` and end where it falls below ``LEAVE_DB``."""
    import numpy as np

    mark = np.where(level >= ENTER_DB, 1, np.where(level < LEAVE_DB, -1, 0))
    known = np.flatnonzero(mark)
    if not len(known):
        return []
    last = np.concatenate([[-1], known])[np.searchsorted(known, np.arange(len(mark)), side="right")]
    on = (last >= 0) & (mark[last] == 1)
    edge = np.diff(np.concatenate([[0], on.astype(np.int8), [0]]))
    second = HOP / (RATE * UP / DOWN)
    return [(float(a) * second, float(b) * second) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]


def tensors(mel) -> bytes:
    """An Arrow stream of fixed-shape tensors of ``TENSOR`` frames with their time spans; the last is filled with silence."""
    import numpy as np
    import pyarrow as pa

    n = -(-len(mel) // TENSOR)
    full = np.full((n * TENSOR, BANDS), np.log(1e-6), np.float32)
    full[:len(mel)] = mel
    shape = pa.fixed_shape_tensor(pa.float32(), [TENSOR, BANDS], dim_names=["frame", "band"])
    values = pa.FixedSizeListArray.from_arrays(pa.array(full.ravel()), TENSOR * BANDS)
    second = HOP / (RATE * UP / DOWN)
    start = np.arange(n) * TENSOR * second
    end = np.minimum((np.arange(n) + 1) * TENSOR, len(mel)) * second
    batch = pa.RecordBatch.from_arrays([pa.ExtensionArray.from_storage(shape, values), pa.array(start), pa.array(end)],
                                       names=["log_mel", "start_s", "end_s"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def as_clips(docs, text: str = "text", clip: str = "clip"):
    """All columns, the unpadded length of ``text`` in UTF-8 and the clip whose samples are its bytes."""
    import pyarrow as pa

    names = free_name(docs, "n_bytes"), free_name(docs, clip)
    bounded_batches(docs.sparkSession)

    def run(batches):
        for b in blocks(batches, text):
            data = [utf8(t) for t in b.column(b.schema.get_field_index(text)).to_pylist()]
            clips = [wav(d + bytes(max(UNIT, -(-len(d) // UNIT) * UNIT) - len(d))) for d in data]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([len(d) for d in data], pa.int64()), pa.array(clips, pa.binary())],
                                             names=[*b.schema.names, *names])

    return docs.mapInArrow(run, f"{ddl(docs)}`{names[0]}` bigint, `{names[1]}` binary")


FEATURE_NAMES = ["payload_bytes", "payload_sha256", "tail_crc32", "tensors", "n_frames", "spans", "feature"]
FEATURE_TYPES = ["bigint", "string", "bigint", "binary", "bigint", "array<struct<start_s: double, end_s: double>>", "string"]


def features(clips, clip: str = "clip"):
    """All columns but the clip, and what is read from it.

    payload_bytes, payload_sha256, tail_crc32   of the samples read back; the crc32 of the last 64
    tensors      Arrow stream of log-mel tensors and their spans
    spans        when the clip sounds
    feature      number of frames and spans, and a digest of the log-mel values rounded to 1/16

    A name gets underscores in front where the table has it already.
    """
    import pyarrow as pa

    rest = clips.drop(clip)
    names = [free_name(rest, n) for n in FEATURE_NAMES]
    bounded_batches(clips.sparkSession)

    def of(data):
        import numpy as np

        raw = samples(data)
        if raw is None:
            return [None] * 7
        mel, level = log_mel(resample(raw))
        spans = sounding(level)
        digest = hashlib.sha256(np.round(mel * 16).astype("<i2").tobytes()).hexdigest()[:16]
        return [len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-UNIT:]), tensors(mel), len(mel),
                [{"start_s": a, "end_s": b} for a, b in spans], f"{len(mel)} frames, {len(spans)} spans, {digest}"]

    kinds = [pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.int64(),
             pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())])), pa.string()]

    def run(batches):
        for b in blocks(batches, clip):
            at = b.schema.get_field_index(clip)
            found = list(zip(*[of(x) for x in b.column(at).to_pylist()]))
            keep = [i for i in range(b.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in keep] + [pa.array(list(f), k) for f, k in zip(found, kinds)],
                                             names=[b.schema.names[i] for i in keep] + names)

    return clips.mapInArrow(run, ddl(rest) + ", ".join(f"`{n}` {t}" for n, t in zip(names, FEATURE_TYPES)))

