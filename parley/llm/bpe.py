"""Byte-level BPE over ranks, encoded and decoded as a tree of halves.

Encodings are the elements of a monoid: ``join(encode(a), encode(b)) == encode(a + b)``. Long texts are halved until a leaf
is small, and neighbours are joined by encoding a window around their border anew, growing it until nothing outside can
change. Two facts make that provable:

* Pieces. A pattern match never runs over a place where a white-space character follows another character, so a text
  may be cut there. Where a half has no such place, the pieces around the border are matched anew in a growing window
  until it starts and ends at such a place.
* Tokens inside a piece. A token sequence is the encoding of its bytes exactly if each two neighbours are the encoding of
  their joined bytes. After a window is encoded anew, only its two outer neighbours have to be tested.

A null text counts as empty and has no tokens. Equal texts have equal tokens; nothing depends on other rows or columns.
"""

from __future__ import annotations

import base64
from functools import lru_cache

from .common import blocks, bounded_batches, ddl, free_name

LEAF_CHARS = 1 << 16
LEAF_BYTES = 32
KEPT = 1 << 18  # pieces whose tokens a worker remembers, in either of two generations
NEVER = 1 << 62


class Encoder:
    """Encodes texts by the ranks of a file of base64 token and rank per line."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.tokens = {b: a for a, b in self.ranks.items()}
        self.find = regex.compile(pattern).findall
        self.safe = regex.compile(r"(?<=\S)(?=\s)")
        self.seen: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def merged(self, data: bytes) -> list[int]:
        """The tokens of a short run of bytes: the neighbours of lowest rank are merged, leftmost first."""
        ranks = self.ranks
        parts = [data[i:i + 1] for i in range(len(data))]
        pairs = [ranks.get(data[i:i + 2], NEVER) for i in range(len(data) - 1)]
        while pairs:
            best = min(pairs)
            if best == NEVER:
                break
            i = pairs.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], NEVER)
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], NEVER)
        return [ranks[p] for p in parts]

    def piece(self, data: bytes) -> list[int]:
        """The tokens of one pattern match, as a tree of halves."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        if len(data) <= LEAF_BYTES:
            return self.merged(data)
        half = len(data) // 2
        return self.joined(self.piece(data[:half]), self.piece(data[half:]))

    def fit(self, a: int, b: int) -> bool:
        """Whether two tokens side by side are the encoding of their bytes."""
        return self.merged(self.tokens[a] + self.tokens[b]) == [a, b]

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        """The tokens of two neighbouring runs of bytes, from the tokens of each."""
        if not left or not right or self.fit(left[-1], right[0]):
            return left + right
        i, j = 1, 1  # tokens of the window on either side
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            window = b"".join(self.tokens[t] for t in left[len(left) - i:] + right[:j])
            new = self.piece(window) if i + j < len(left) + len(right) and len(window) > LEAF_BYTES else self.merged(window)
            before = i == len(left) or self.fit(left[-i - 1], new[0])
            after = j == len(right) or self.fit(new[-1], right[j])
            if before and after:
                return left[:len(left) - i] + new + right[j:]
            i, j = i if before else 2 * i, j if after else 2 * j

    def leaf(self, text: str) -> list[int]:
        """The tokens of a text that starts and ends where no match can run over."""
        seen, out = self.seen, []
        for p in self.find(text):
            t = seen.get(p)
            if t is None:
                t = self.older.get(p)
                if t is None:
                    t = tuple(self.piece(p.encode("utf-8", "surrogatepass")))
                if len(p) <= LEAF_BYTES:
                    if len(seen) >= KEPT:
                        self.older, self.seen = seen, {}
                        seen = self.seen
                    seen[p] = t
            out += t
        return out

    def cut(self, text: str, lo: int, hi: int) -> int | None:
        """A place near the middle of text[lo:hi] that no match runs over, searched in a window that grows to the whole."""
        middle, reach = (lo + hi) // 2, 64
        while True:
            start, end = max(lo + 1, middle - reach), min(hi - 1, middle + reach)
            found = self.safe.search(text, start, end) if start < end else None
            # the search window hides the characters beside it from the look-arounds only at its two ends
            if found and lo < found.start() < hi:
                return found.start()
            if start == lo + 1 and end == hi - 1:
                return None
            reach *= 4

    def encode(self, text: str | None, lo: int = 0, hi: int | None = None) -> list[int]:
        """The tokens of a text, as a tree of halves."""
        if not text:
            return []
        hi = len(text) if hi is None else hi
        if hi - lo > LEAF_CHARS and (at := self.cut(text, lo, hi)) is not None:
            return self.encode(text, lo, at) + self.encode(text, at, hi)
        return self.leaf(text[lo:hi])

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of tokens, concatenated up the tree."""
        if len(ids) > LEAF_CHARS:
            half = len(ids) // 2
            return self.decode(ids[:half]) + self.decode(ids[half:])
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def encode(docs, path: str, pattern: str, text: str = "text", ids: str = "ids"):
    """All columns and the tokens of ``text`` as an array of integers."""
    import pyarrow as pa

    name = free_name(docs, ids)
    bounded_batches(docs.sparkSession)

    def run(batches):
        coder = encoder(path, pattern)
        for b in blocks(batches, text):
            tokens = pa.array([coder.encode(t) for t in b.column(b.schema.get_field_index(text)).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns, tokens], names=[*b.schema.names, name])

    return docs.mapInArrow(run, f"{ddl(docs)}`{name}` array<int>")


def decode(docs, path: str, pattern: str, ids: str = "ids", out: str = "decoded"):
    """All columns and the bytes of the tokens in ``ids``; a null list and null tokens give no bytes."""
    import pyarrow as pa

    name = free_name(docs, out)
    bounded_batches(docs.sparkSession)

    def run(batches):
        coder = encoder(path, pattern)
        for b in batches:
            lists = b.column(b.schema.get_field_index(ids))
            # row by row, as the numbers of a whole batch would be many times its size
            data = pa.array([coder.decode(t.values.drop_null().to_numpy().tolist() if t.is_valid else []) for t in lists], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, data], names=[*b.schema.names, name])

    return docs.mapInArrow(run, f"{ddl(docs)}`{name}` binary")

