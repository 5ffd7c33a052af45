"""Rounds of questions between chunks of documents and ranges of 64-bit names.

Documents that follow each other in the scan are a chunk, a few MB of text kept compressed. A chunk asks about names (numbers
that stand for strings): its distinct names, sorted, are cut into ranges of the whole number space. The chunks of a load are
worked on one after the other and share one message a range. A range's task sees the messages of all loads, sorts their names
together and answers each message in its own order. So a question about a name crosses the network as a few bytes however
often the chunk holds the name, a name that very many documents share meets as one entry per chunk, and texts are dealt out once.

Chunks are kept with persist(DISK_ONLY): a lost executor's chunks are made again from the table, and they come out the same,
as everything in them is sorted.
"""

from __future__ import annotations

import io
import math

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .common import bounded_batches, free_name, give_back

CHUNK_BYTES = 2 << 20
ROW_BYTES = 8  # that a row counts for besides its text
MOST_TOGETHER = 16  # chunks of a load


def squeeze(arrays: dict) -> bytes:
    """Arrays as compressed bytes; the bytes of equal weight lie together, as sorted numbers share their upper ones."""
    import numpy as np
    import zstandard

    out = io.BytesIO()
    for name, a in arrays.items():
        a = np.ascontiguousarray(a)
        head = f"{name} {a.dtype.str} {','.join(map(str, a.shape))}\n".encode()
        out.write(head)
        out.write(np.ascontiguousarray(a.reshape(len(a), -1).view(np.uint8).T).tobytes() if a.size else b"")
    return zstandard.ZstdCompressor(level=1).compress(out.getvalue())


def expand(data: bytes) -> dict:
    import numpy as np
    import zstandard

    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, {}
    while at < len(raw):
        end = raw.index(b"\n", at)
        name, kind, shape = raw[at:end].decode().split(" ")
        shape = tuple(map(int, shape.split(",")))
        kind = np.dtype(kind)
        n = int(np.prod(shape)) * kind.itemsize
        planes = np.frombuffer(raw, np.uint8, n, end + 1)
        out[name] = np.ascontiguousarray(planes.reshape(-1, shape[0]).T).reshape(-1).view(kind).reshape(shape) if n else np.zeros(shape, kind)
        at = end + 1 + n
    return out


def chunks(docs: DataFrame, prepare=None, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, int]:
    """(load, seq, data, extra), persisted, and about the number of chunks. A row is a chunk: whole rows that follow each other in the scan.

    load     some chunks of one scan task that ask and hear together
    data     an Arrow stream, compressed, of all columns of ``docs``, the text as its bytes in UTF-8
    extra    what ``prepare`` makes of the texts (a list of bytes): arrays, compressed
    A chunk's seq is unique and follows from the scan alone.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    bounded_batches(docs.sparkSession)
    total = docs.select(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    n = max(1, math.ceil(total / CHUNK_BYTES))
    many = together(n)
    scan = free_name(docs, "_scan")
    names = docs.columns

    def packed(batches):
        table = pa.Table.from_batches(batches)
        texts = pc.fill_null(table.column(text).cast(pa.large_binary()), b"").combine_chunks()
        table = table.set_column(table.schema.get_field_index(text), text, texts)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_table(table)
        return sink.getvalue().to_pybytes(), squeeze(prepare(texts.to_pylist())) if prepare else b""

    def run(batches):
        give_back()
        held, size, seq, task = [], 0, 0, 0
        def out():
            data, extra = packed(held)
            return pa.RecordBatch.from_arrays([pa.array([(task << 32) + seq // many], pa.int64()), pa.array([(task << 32) + seq], pa.int64()), pa.array([data], pa.binary()),
                                               pa.array([extra], pa.binary())], names=["load", "seq", "data", "extra"])
        for b in batches:
            if not b.num_rows:
                continue
            task = b.column(b.schema.get_field_index(scan))[0].as_py()
            b = b.select(names)
            length = pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(length.astype(np.int64) + ROW_BYTES)
            start, done = 0, 0
            while start < b.num_rows:
                end = max(int(np.searchsorted(ends, done + CHUNK_BYTES - size, side="right")), start + (not held))  # a longer text is a chunk of its own
                if end > start:
                    held.append(b.slice(start, end - start))
                    size += int(ends[end - 1]) - done
                    start, done = end, int(ends[end - 1])
                if start < b.num_rows:
                    yield out()
                    held, size, seq = [], 0, seq + 1
        if held:
            yield out()

    made = docs.withColumn(scan, F.spark_partition_id()).mapInArrow(run, "load bigint, seq bigint, data binary, extra binary")
    return made.repartition(math.ceil(n / many), "load").persist(StorageLevel.DISK_ONLY), n


def together(n: int) -> int:
    """Chunks of a load. As there are more ranges the more chunks there are, messages would else grow with the square of the chunks."""
    return min(MOST_TOGETHER, max(1, math.isqrt(n) // 6))


class Chunk:
    """A chunk's rows in a fixed order, their texts as one run of bytes, and the prepared arrays of each pack."""

    def __init__(self, table, text: str = "text", key: str = "doc_id"):
        import numpy as np
        import pyarrow as pa

        packs = sorted(zip(table.column("seq").to_pylist(), table.column("data").to_pylist(), table.column("extra").to_pylist()))
        self.tables = [pa.ipc.open_stream(d).read_all() for _, d, _ in packs]
        self.extra = [expand(e) if e else {} for _, _, e in packs]
        self.rows = pa.concat_tables(self.tables).combine_chunks()
        column = self.rows.column(text)
        column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], pa.large_binary())
        self.starts = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
        data = column.buffers()[2]
        whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.bytes = whole[self.starts[0]:self.starts[-1]] if len(self.starts) else whole[:0]
        self.starts = self.starts - self.starts[0] if len(self.starts) else np.zeros(1, np.int64)
        self.keys = self.rows.column(key).to_pylist()
        self.first = np.cumsum([0, *(t.num_rows for t in self.tables)])  # row at which a pack starts

    def __len__(self):
        return self.rows.num_rows


def ranges(names, n: int):
    """Bounds of sorted names by range of the number space."""
    import numpy as np

    edges = np.array([(i << 64) // n for i in range(1, n)], np.uint64)
    return [0, *np.searchsorted(names, edges).tolist(), len(names)]


ASKED = "load bigint, range bigint, data binary"


def each(table):
    """The chunks of a load, one at a time."""
    import numpy as np

    for i in np.argsort(table.column("seq").to_numpy(), kind="stable"):
        yield table.slice(int(i), 1)


def ask(packs: DataFrame, n: int, number: int, question, answer, heard: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Round ``number``: ``heard`` and (load, round, range, data), the answers to what each chunk asks now.

    question(chunk, heard) -> dict of arrays with ``name`` (sorted uint64, unique unless the answer allows otherwise); ``heard``
             has the answers of earlier rounds by number, each in the order of what was asked
    answer(dict of arrays, chunk of each row) -> array with one entry per row
    """
    import numpy as np
    import pyarrow as pa

    width = max(1, n // 4)

    def message(load, at, data):
        return pa.table({"load": pa.array(load, pa.int64()), "range": pa.array(at, pa.int64()), "data": pa.array(data, pa.binary())})

    def put(table, replies):
        parts, heard = [[] for _ in range(width)], told(replies, table.num_rows)
        for k, pack in enumerate(each(table)):
            got = question(Chunk(pack, text, key), heard(k))
            bounds = ranges(got["name"], width)
            for r in range(width):
                if bounds[r] < bounds[r + 1]:
                    parts[r].append((k, {name: v[bounds[r]:bounds[r + 1]] for name, v in got.items()}))
        at, data = [r for r in range(width) if parts[r]], []
        for r in at:
            sizes = np.zeros(table.num_rows, np.uint32)
            sizes[[k for k, _ in parts[r]]] = [len(part["name"]) for _, part in parts[r]]
            data.append(squeeze({name: np.concatenate([part[name] for _, part in parts[r]]) for name in parts[r][0][1]} | {SIZES: sizes}))
            parts[r] = None
        give_back()
        return message([table.column("load")[0].as_py()] * len(at) if at else [], at, data)

    def reply(table):
        order = np.argsort(table.column("load").to_numpy(), kind="stable")
        parts = [expand(table.column("data")[int(i)].as_py()) for i in order]
        sizes = [p.pop(SIZES) for p in parts]
        whole = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
        del parts
        found = answer(whole, np.repeat(np.arange(sum(map(len, sizes))), np.concatenate(sizes)))
        cuts = np.cumsum([0, *(int(s.sum()) for s in sizes)])
        data = [squeeze({"answer": found[a:b], SIZES: s}) for a, b, s in zip(cuts, cuts[1:], sizes)]
        give_back()
        return message(table.column("load").to_numpy()[order], table.column("range").to_numpy()[order], data)

    mine = packs.groupBy("load")
    asked = mine.applyInArrow(lambda t: put(t, None), ASKED) if heard is None else mine.cogroup(heard.groupBy("load")).applyInArrow(put, ASKED)
    replies = asked.groupBy("range").applyInArrow(reply, ASKED)
    replies = cut_lineage(replies.select("load", F.lit(number).alias("round"), "range", "data"))
    return replies if heard is None else heard.unionByName(replies)


SIZES = "_sizes"  # of the chunks in a message


def answers(data: bytes) -> list:
    """The answers of a message, by chunk of the load."""
    import numpy as np

    got = expand(data)
    return np.split(got["answer"], np.cumsum(got[SIZES], dtype=np.int64)[:-1])


def told(table, many: int):
    """For each chunk of a load, the answers of each round as one array, in the order of the sorted names."""
    import numpy as np

    parts = [{} for _ in range(many)]
    if table is not None:
        rows = zip(table.column("round").to_pylist(), table.column("range").to_pylist(), range(table.num_rows))
        for number, _, i in sorted(rows):
            for k, found in enumerate(answers(table.column("data")[i].as_py())):
                parts[k].setdefault(number, []).append(found)
    return lambda k: _Answers({number: np.concatenate(found) for number, found in parts[k].items()})


class _Answers(dict):
    """Answers by round; a round in which a chunk asked nothing has an empty answer."""

    def __missing__(self, key):
        import numpy as np

        return np.zeros(0, np.int64)


def finish(packs: DataFrame, heard: DataFrame, schema: str, result, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``result(chunk, heard)``, a pyarrow table, of each chunk."""
    import pyarrow as pa

    def run(table, replies):
        heard = told(replies, table.num_rows)
        return pa.concat_tables([result(Chunk(pack, text, key), heard(k)) for k, pack in enumerate(each(table))])

    return packs.groupBy("load").cogroup(heard.groupBy("load")).applyInArrow(run, schema)
