"""Documents that hold passages of a benchmark.

Texts are lower-cased (A-Z) words of letters, digits and characters beyond ASCII. A window is ``WINDOW`` words in a row of
an item; an item of fewer words is one window. The windows are searched in whole documents as Wu and Manber's multi-pattern
search does, with words as symbols: a table over blocks of words says how far the scan may shift until such a block can
end a window, so most positions are never looked at; where the shift is zero, the bucket of the block's words at the
end of the windows names the candidates, and comparing their words decides. Windows of fewer words have tables of their own.

The documents stay where they are and the items come to them in blocks of at most ``BLOCK_BYTES`` of text, one pass over the
documents per block (a long item is cut into pieces that share ``WINDOW`` - 1 words), so neither table must fit anywhere.
Between passes the documents with what was found are written to the checkpoint folder.

A null text or one without words holds nothing, and an item without words has no window. A null item id is left out of
``items``, though its windows hit; an id that repeats is one item. Rows that repeat are answered each. Empty tables are
fine on both sides. Other columns are kept; the result columns get an underscore in front if the table has such a name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.ranks import ranked
from .common import blocks, bounded_batches, ddl, free_name, utf8
from ..session import cut_lineage

WINDOW = 10
BLOCK_BYTES = 2 << 20
PIECE_WORDS = 1 << 15
SYMBOLS = 3  # words of a block of the shift table
SLOTS = 1 << 20

#: Every byte outside words becomes a blank, A-Z become a-z; digits and bytes of longer characters stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text) -> list[bytes]:
    return utf8(text).translate(_FOLD).split()


class Patterns:
    """Windows of one length: shifts by block of words, buckets by the words at the end, and the items of each window."""

    def __init__(self, length: int, windows: dict):
        self.length = length
        self.block = min(SYMBOLS, length)
        self.windows = list(windows)
        self.items = [windows[w] for w in self.windows]
        self.shift = bytearray([length - self.block + 1]) * SLOTS
        self.bucket: dict = {}
        b, shift = self.block, self.shift
        for number, w in enumerate(self.windows):
            for end in range(b, length + 1):
                slot = hash(w[end - b:end]) % SLOTS
                if shift[slot] > length - end:
                    shift[slot] = length - end
            self.bucket.setdefault(w[-b:], []).append(number)

    def search(self, words: list[bytes]):
        """(start, number of the window) of every occurrence."""
        length, b, shift, n = self.length, self.block, self.shift, len(words)
        end = length
        while end <= n:
            block = tuple(words[end - b:end])
            skip = shift[hash(block) % SLOTS]
            if skip:
                end += skip
                continue
            for number in self.bucket.get(block, ()):
                window = self.windows[number]
                if window[0] == words[end - length] and window == tuple(words[end - length:end]):
                    yield end - length, number
            end += 1


def patterns(items, window: int = WINDOW) -> list[Patterns]:
    """The search tables of (item, words, whole) pieces; a piece of fewer words than a window counts only if it is the whole item."""
    same: dict = {}
    found: dict = {}
    for item, words, whole in items:
        words = [same.setdefault(w, w) for w in words]
        if len(words) >= window:
            for i in range(len(words) - window + 1):
                found.setdefault(window, {}).setdefault(tuple(words[i:i + window]), set()).add(item)
        elif words and whole:
            found.setdefault(len(words), {}).setdefault(tuple(words), set()).add(item)
    return [Patterns(n, w) for n, w in sorted(found.items())]


_READY: dict = {}


def _tables(shared, number: str, window: int) -> list[Patterns]:
    """A worker builds the tables of a block once."""
    if number not in _READY:
        _READY.clear()
        _READY[number] = patterns(((item, text.split(), whole) for item, text, whole in shared.value), window)
    return _READY[number]


def pieces(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item, text, whole): each item's words put together by blanks, long items in pieces that overlap by a window."""
    bounded_batches(benchmark.sparkSession)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for part in blocks([b], "text", 1 << 20):
                out: list = [[], [], []]
                for item, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    words = words_of(text)
                    starts = range(0, max(1, len(words) - window + 1), PIECE_WORDS)
                    for i in starts if words else ():
                        piece = b" ".join(words[i:i + PIECE_WORDS + window - 1])
                        for column, value in zip(out, (item, piece, len(starts) == 1)):
                            column.append(value)
                types = [pa.string(), pa.binary(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["item", "piece", "whole"])

    named = benchmark.select(F.col("item_id").cast("string").alias("item"), "text")
    return named.mapInArrow(run, "item string, piece binary, whole boolean")


def _scan(shared, number: str, window: int, names: list[str]):
    hits_name, items_name, count_name = names

    def run(batches):
        import numpy as np
        import pyarrow as pa

        tables = _tables(shared, number, window)
        for batch in blocks(batches, "text", 4 << 20):
            hits, items, counts = [], [], []
            old_hits, old_items = batch.column(hits_name), batch.column(items_name)
            for row, text in enumerate(batch.column("text")):
                words = words_of(text.as_py())
                spans, found = old_hits[row].as_py(), set(old_items[row].as_py())
                for t in tables:
                    seen = set()
                    for start, window_ in t.search(words):
                        spans.append((start, start + t.length))
                        seen.add(window_)
                    for w in seen:
                        found.update(t.items[w])
                hits.append(_joined(spans))
                items.append(sorted(x for x in found if x is not None))
                counts.append(len(words))
            del row
            span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            new = {hits_name: pa.array([[{"start": a, "stop": b} for a, b in s] for s in hits], span),
                   items_name: pa.array(items, pa.list_(pa.string())), count_name: pa.array(np.array(counts, np.int64))}
            columns = [new.get(n, batch.column(i)) for i, n in enumerate(batch.schema.names)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return run


def _joined(spans) -> list[tuple[int, int]]:
    """Spans of words (pairs, or structs of earlier passes) as disjoint ones in order."""
    out: list = []
    for a, b in sorted((s["start"], s["stop"]) if isinstance(s, dict) else s for s in spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
            out: tuple[str, str, str] = ("hits", "items", "n_words")) -> DataFrame:
    """Add ``hits`` (disjoint spans of word numbers inside windows), ``items`` (ids as text, sorted) and ``n_words``."""
    spark = docs.sparkSession
    bounded_batches(spark)
    names = []
    state = docs
    for name, empty in zip(out, ("cast(array() as array<struct<start:bigint,stop:bigint>>)", "cast(array() as array<string>)", "0L")):
        names.append(free_name(state, name))
        state = state.withColumn(names[-1], F.expr(empty))
    # A block is the pieces whose running sum of bytes starts in it: at most a piece more than its bound.
    sized = cut_lineage(pieces(benchmark, window).withColumn("size", F.octet_length("piece").cast("long") + 64))
    placed = ranked(sized, ["item", "piece"], "at", total={"upto": F.col("size")})
    placed = cut_lineage(placed.withColumn("block", F.floor((F.col("upto") - F.col("size")) / block_bytes)))
    wanted = [r[0] for r in placed.select("block").distinct().orderBy("block").collect()]
    for i, number in enumerate(wanted or [None]):
        rows = [tuple(r) for r in placed.filter(F.col("block") == number).select("item", "piece", "whole").collect()] if wanted else []
        shared = spark.sparkContext.broadcast([(item, bytes(piece), whole) for item, piece, whole in rows])
        if i:
            state = cut_lineage(state)
        schema = ddl(state).rstrip(", ")
        state = state.mapInArrow(_scan(shared, f"{spark.sparkContext.applicationId}-{shared._jbroadcast.id()}", window, names), schema)
    return state


#: Windows as texts of blank-joined words; a document's windows meet those of the same number of words.
SQL = r"""
WITH words AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w, row_number() OVER () AS place FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM
  (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
found AS (SELECT place, i, s.k, win FROM (SELECT place, k, i, array_to_string(w[i:i + k - 1], ' ') AS win FROM
    (SELECT place, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)) s
  SEMI JOIN windows USING (k, win)),
hit AS (SELECT place, count(DISTINCT p) AS n_hit FROM (SELECT place, unnest(range(i, i + k)) AS p FROM found) GROUP BY place),
held AS (SELECT place, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM
  (SELECT DISTINCT place, item_id::VARCHAR AS id FROM found JOIN windows USING (k, win) WHERE item_id IS NOT NULL) GROUP BY place)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM words LEFT JOIN hit USING (place) LEFT JOIN held USING (place)
"""
