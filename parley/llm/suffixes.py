"""Repeated passages by prefix doubling over sampled positions.

A byte goes if a string of ``length`` bytes covers it that also starts in a document with a smaller id. The name of a
string stands for its rank: equal strings have equal names, and the name of a longer string is made from the pair of names
of a shorter length at a position and at a growing offset (8, 16, 32, ... and the last pair overlaps). Names are sorted and
compared over the whole corpus; positions whose name is unique drop out, the others go on to the longer one:

0  Seeds. In every run of windows the position of the least name of about half the length is a seed, so that each string of
   ``length`` bytes has a seed inside it, and equal strings have it at the same place. Seeds that no other document has drop out.
1  The strings of full length that start at the other seeds: those of a smaller document too are repeats. Of long passages
   this finds all but the ends. It is also asked which seeds occur in a smaller document at all.
2  Strings whose least seed does so and that are not covered yet are open; their seeds are asked for.
3  Everybody who has such a seed sends what is around it, and all strings of full length through it are compared.

Names have 64 bits and stand for strings without another comparison: two different strings share one with a chance of 2^-64.
The rounds travel as in ``rounds``: a chunk's equal names or surroundings are one entry, however many documents share them.

Ids are integers. A document with a null id comes after all others; documents with equal or null ids do not take from each
other. A null text counts as empty; texts shorter than ``length`` keep all. Matches never cross documents. Rows that repeat stay.
An empty table gives an empty one. All columns are kept; result columns get an underscore in front if a name is taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from .common import ddl, free_name
from .rounds import ask, chunks, finish

LENGTH = 50
SLICE = 1 << 18  # places whose names are held at a time
LAST = (1 << 63) - 1  # the place of a null id


def mixed(a, b):
    """A name for pairs of names."""
    import numpy as np

    x = a * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x += b
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def half(n: int) -> int:
    h = 8
    while 2 * h < n:
        h *= 2
    return h


def words(data):
    """The eight bytes from each position on as a number; the end is filled with zeros."""
    import numpy as np

    whole = np.concatenate([data, np.zeros(8, np.uint8)])
    out = np.empty(len(data), np.uint64)
    for o in range(min(8, len(data))):
        part = out[o::8]
        part[:] = np.frombuffer(whole, "<u8", len(part), o)
    return out


def names_everywhere(data, n: int):
    """The name of the n bytes from each position on; beyond the end, bytes are zeros."""
    import numpy as np

    if n == 8:
        return words(data)
    h = half(n)
    part = names_everywhere(np.concatenate([data, np.zeros(n - h, np.uint8)]), h)
    return mixed(part[:len(data)], part[n - h:n - h + len(data)])


def names_at(data, at, n: int):
    """The names of the n bytes from some positions on; ``data`` must go on for 8 bytes behind them."""
    import numpy as np

    if n == 8:
        return np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))[at]
    h = half(n)
    return mixed(names_at(data, at, h), names_at(data, at + (n - h), h))


def seed_length(length: int) -> int:
    return max(8, length // 16 * 8)


def sliding(x, width: int, best):
    """best (minimum or maximum) of each run of ``width`` entries."""
    span = 1
    while span < width:
        step = min(span, width - span)
        x = best(x[:-step], x[step:])
        span += step
    return x


def inner(starts, ends, lo: int, hi: int):
    """Which of the places [lo, hi) lie in one of the sorted ranges [starts, ends) that do not overlap."""
    import numpy as np

    use = ends > starts
    starts, ends = starts[use], ends[use]
    a, b = np.searchsorted(ends, lo, side="right"), np.searchsorted(starts, hi)
    turn = np.zeros(hi - lo + 1, np.int8)
    np.add.at(turn, np.clip(starts[a:b] - lo, 0, hi - lo), 1)
    np.add.at(turn, np.clip(ends[a:b] - lo, 0, hi - lo), -1)
    return np.cumsum(turn[:-1], dtype=np.int8) > 0


def seeds(texts: list[bytes], length: int):
    """Positions of the seeds in the joined texts: each least name of any window that lies in one text."""
    import numpy as np

    k = seed_length(length)
    width = length - k + 1
    data = np.frombuffer(b"".join(texts), np.uint8)
    bounds = np.cumsum([0, *map(len, texts)])
    n, out = len(data), []
    for s in range(0, n, SLICE):
        e = min(n, s + SLICE)
        lo = max(0, s - width + 1)  # windows that start here may hold a place of the slice
        hi = min(n, e + width - 1)
        name = names_everywhere(data[lo:min(n, hi + k)], k)[:hi - lo] | np.uint64(1)
        least = sliding(np.concatenate([name, np.full(e - lo + width - 1 - len(name), ~np.uint64(0))]), width, np.minimum)
        least[~inner(bounds[:-1], bounds[1:] - length + 1, lo, e)] = 0  # the window would leave its text
        most = sliding(np.concatenate([np.zeros(width - 1 - (s - lo), np.uint64), least]), width, np.maximum)
        out.append(np.flatnonzero(most == name[s - lo:e - lo]) + s)
    return np.concatenate(out).astype(np.uint32) if out else np.zeros(0, np.uint32)


def steps(positions):
    """Positions as steps from one to the next, which are small."""
    import numpy as np

    return np.diff(positions.astype(np.int64), prepend=0).astype(np.uint32)


class State:
    """What a chunk knows about its seeds after the rounds it has heard."""

    def __init__(self, chunk, length: int):
        import numpy as np

        self.length, self.k = length, seed_length(length)
        self.width = length - self.k + 1
        self.data = np.concatenate([chunk.bytes, np.zeros(length + 8, np.uint8)])
        self.size = np.diff(chunk.starts)
        self.starts = chunk.starts
        self.ids = np.array([LAST if i is None else i for i in chunk.keys], np.int64)
        at = [np.cumsum(e["steps"].astype(np.int64)) + chunk.starts[f] for e, f in zip(chunk.extra, chunk.first) if len(e["steps"])]
        self.at = np.concatenate(at) if at else np.zeros(0, np.int64)
        self.doc = np.searchsorted(chunk.starts, self.at, side="right") - 1
        self.id = self.ids[self.doc]
        self.name = names_at(self.data, self.at, self.k)

    def distinct(self, names, ids):
        """Sorted distinct names, the least id of each, and the place of each name among them."""
        import numpy as np

        found, place = np.unique(names, return_inverse=True)
        least = np.full(len(found), LAST, np.int64)
        np.minimum.at(least, place, ids)
        return found, least, place

    def ask_seeds(self):
        import numpy as np

        # names are cut to 48 bits in this round, which only sifts
        found, least, place = self.distinct(self.name & ~np.uint64(0xFFFF), self.id)
        many = np.zeros(len(found), np.uint8)
        many[place[self.id != least[place]]] = 1
        return {"name": found, "many": many}

    def hear_seeds(self, answer):
        import numpy as np

        _, place = np.unique(self.name & ~np.uint64(0xFFFF), return_inverse=True)
        self.shared = answer.astype(bool)[place] if len(place) else np.zeros(0, bool)

    def _full(self):
        """Shared seeds at which a string of full length starts."""
        import numpy as np

        return np.flatnonzero(self.shared & (self.at + self.length <= self.starts[self.doc + 1]))

    def ask_strings(self):
        import numpy as np

        full, some = self._full(), np.flatnonzero(self.shared)
        names = np.concatenate([names_at(self.data, self.at[full], self.length), self.name[some]])
        found, least, _ = self.distinct(names, np.concatenate([self.id[full], self.id[some]]))
        return {"name": found, "id": least}

    def hear_strings(self, answer):
        import numpy as np

        full, some = self._full(), np.flatnonzero(self.shared)
        ids = np.concatenate([self.id[full], self.id[some]])
        names = np.concatenate([names_at(self.data, self.at[full], self.length), self.name[some]])
        _, least, place = self.distinct(names, ids)
        before = (ids > least[place]) | answer.astype(bool)[place] if len(place) else np.zeros(0, bool)
        self.cover = np.zeros(len(self.data) - self.length - 8 + 1, np.int32)
        self.add(self.at[full[before[:len(full)]]])
        self.before = np.zeros(len(self.at), bool)  # the seed occurs in a smaller document
        self.before[some[before[len(full):]]] = True

    def add(self, starts):
        """Cover the strings of full length from these positions on."""
        import numpy as np

        np.add.at(self.cover, starts, 1)
        np.add.at(self.cover, starts + self.length, -1)

    def covered(self):
        import numpy as np

        return np.cumsum(self.cover[:-1], dtype=np.int32) > 0

    def ask_open(self):
        import numpy as np

        n = len(self.data) - self.length - 8
        some = np.flatnonzero(self.shared)
        found, _, place = self.distinct(self.name[some], self.id[some])
        wanted = np.zeros(len(found), np.uint8)
        if n and self.before.any():
            # window i has the seeds in [i, i + width): the least of them must occur before, and a byte must be uncovered
            mark = np.zeros(n + self.width, np.int8)
            mark[self.at[self.before]] = 1
            good = np.concatenate([[0], np.cumsum(mark, dtype=np.int32)])
            use = good[self.width:n + self.width] > good[:n]
            use &= inner(self.starts[:-1], self.starts[1:] - self.length + 1, 0, n)
            good = np.concatenate([[0], np.cumsum(self.covered(), dtype=np.int32)])
            use[:max(0, n - self.length + 1)] &= good[self.length:] - good[:max(0, n - self.length + 1)] < self.length
            w = np.flatnonzero(use)
            del use, good, mark
            if len(w):
                rank = np.empty(len(self.at), np.int64)
                order = np.lexsort((self.at, self.name))
                rank[order] = np.arange(len(order))
                lo, hi = np.searchsorted(self.at, w), np.searchsorted(self.at, w + self.width)
                pairs = np.stack([lo, hi], axis=1).ravel()
                least = np.minimum.reduceat(np.append(rank, len(rank)), pairs)[::2]
                index = np.full(len(self.at), -1)
                index[some] = place
                seed = order[np.unique(least)]
                wanted[index[seed[self.before[seed]]]] = 1
        return {"name": found, "wanted": wanted}

    def hear_open(self, answer):
        import numpy as np

        some = np.flatnonzero(self.shared)
        _, place = np.unique(self.name[some], return_inverse=True)
        self.open = some[answer.astype(bool)[place]] if len(some) else some

    def around(self):
        """The distinct surroundings of the open seeds: rows of bytes and room to either side, least ids, and each seed's row."""
        import numpy as np

        at, doc = self.at[self.open], self.doc[self.open]
        left = np.minimum(self.width - 1, at - self.starts[doc])
        right = np.minimum(self.length, self.starts[doc + 1] - at)
        span = np.arange(-(self.width - 1), self.length)
        rows = np.empty((len(at), len(span) + 16), np.uint8)
        inside = (span >= -left[:, None]) & (span < right[:, None])
        rows[:, 16:] = np.where(inside, self.data[np.clip(at[:, None] + span, 0, len(self.data) - 1)], 0)
        rows[:, :8] = self.name[self.open].astype(">u8").view(np.uint8).reshape(-1, 8)
        rows[:, 8:12] = left.astype(">u4").view(np.uint8).reshape(-1, 4)
        rows[:, 12:16] = right.astype(">u4").view(np.uint8).reshape(-1, 4)
        whole = np.ascontiguousarray(rows).view(f"V{rows.shape[1]}").ravel()
        _, first, place = np.unique(whole, return_index=True, return_inverse=True)
        least = np.full(len(first), LAST, np.int64)
        np.minimum.at(least, place, self.id[self.open])
        return rows[first], least, place, left, right

    def ask_around(self):
        import numpy as np

        rows, least, _, _, _ = self.around()
        name = rows[:, :8].copy().view(">u8").ravel().astype(np.uint64)
        return {"name": name, "rows": rows[:, 8:], "id": least}

    def hear_around(self, answer):
        import numpy as np

        rows, least, place, left, right = self.around()
        for o in range(self.width):
            fits = (left >= o) & (right >= self.length - o)
            before = self.id[self.open] > least[place]
            if len(answer):
                before |= answer[place, o // 8] >> np.uint8(o % 8) & 1 == 1
            self.add(self.at[self.open[fits & before]] - o)


def others_have(rows, message):
    """Whether a name occurs in more than one document."""
    import numpy as np

    _, place, n = np.unique(rows["name"], return_inverse=True, return_counts=True)
    many = np.zeros(len(n), bool)
    many[place[rows["many"] > 0]] = True
    return (many | (n > 1))[place].astype(np.uint8)


def smaller_has(rows, message):
    """Whether a name occurs in a document of a smaller id than the message's least."""
    import numpy as np

    found, place = np.unique(rows["name"], return_inverse=True)
    least = np.full(len(found), LAST, np.int64)
    np.minimum.at(least, place, rows["id"])
    return (least[place] < rows["id"]).astype(np.uint8)


def any_wants(rows, message):
    import numpy as np

    found, place = np.unique(rows["name"], return_inverse=True)
    wanted = np.zeros(len(found), np.uint8)
    wanted[place[rows["wanted"] > 0]] = 1
    return wanted[place]


def strings_around(length: int):
    """The answer of the last round: a bit for each string through the seed that a smaller document has, too."""
    import numpy as np

    width = length - seed_length(length) + 1

    def answer(rows, message):
        text, ids = rows["rows"][:, 8:], rows["id"]
        left = rows["rows"][:, :4].copy().view(">u4").ravel()
        right = rows["rows"][:, 4:8].copy().view(">u4").ravel()
        data = np.concatenate([np.ascontiguousarray(text).ravel(), np.zeros(8, np.uint8)])
        base = np.arange(len(ids)) * text.shape[1] + width - 1
        out = np.zeros((len(ids), -(-width // 8)), np.uint8)
        for o in range(width):
            use = np.flatnonzero((left >= o) & (right >= length - o))
            if not len(use):
                continue
            found, place = np.unique(names_at(data, base[use] - o, length), return_inverse=True)
            least = np.full(len(found), LAST, np.int64)
            np.minimum.at(least, place, ids[use])
            hit = use[least[place] < ids[use]]
            out[hit, o // 8] |= np.uint8(1 << (o % 8))
        return out

    return answer


def known(chunk, heard, length: int, rounds: int):
    state = State(chunk, length)
    for number, hear in enumerate((state.hear_seeds, state.hear_strings, state.hear_open, state.hear_around)[:rounds]):
        hear(heard[number])
    return state


RESULT = ("n_bytes", "bigint"), ("n_removed", "bigint"), ("n_spans", "bigint"), ("spans", "array<struct<start: bigint, end: bigint>>"), ("kept", "binary")


def without_repeats(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns but the text, and n_bytes, n_removed, n_spans, spans (byte places removed) and kept (the bytes left)."""
    import numpy as np
    import pyarrow as pa

    if length < 16:
        raise ValueError("repeats must have at least 16 bytes")
    rest = docs.drop(text)
    others = rest.columns
    names = [free_name(rest, name) for name, _ in RESULT]
    packs, n = chunks(docs, lambda texts: {"steps": steps(seeds(texts, length))}, key, text)
    rounds = [(State.ask_seeds, others_have), (State.ask_strings, smaller_has), (State.ask_open, any_wants), (State.ask_around, strings_around(length))]
    heard = None
    for number, (question, answer) in enumerate(rounds):
        asked = lambda chunk, told, number=number, question=question: question(known(chunk, told, length, number))
        heard = ask(packs, n, number, asked, answer, heard, key, text)

    def result(chunk, told):
        state = known(chunk, told, length, len(rounds))
        gone = state.covered()
        total = np.concatenate([[0], np.cumsum(gone, dtype=np.int32)])
        starts = chunk.starts
        removed = total[starts[1:]] - total[starts[:-1]]
        edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
        begins = np.zeros(len(gone), bool)
        begins[np.flatnonzero(edge == 1)] = True
        begins[starts[:-1][state.size > 0]] |= gone[starts[:-1][state.size > 0]]  # a run ends with its document
        begin = np.flatnonzero(begins)
        stops = np.zeros(len(gone) + 1, bool)
        stops[np.flatnonzero(edge == -1)] = True
        last = starts[1:][state.size > 0]
        stops[last] |= gone[last - 1]
        stop = np.flatnonzero(stops)
        of = np.searchsorted(starts, begin, side="right") - 1
        spans = np.bincount(of, minlength=len(chunk))
        pairs = pa.StructArray.from_arrays([pa.array(begin - starts[of]), pa.array(stop - starts[of])], names=["start", "end"])
        kept = chunk.bytes[~gone].tobytes()
        cuts = np.cumsum(np.concatenate([[0], state.size - removed])).tolist()
        columns = [chunk.rows.column(c) for c in others]
        columns += [pa.array(state.size, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(spans)]), pa.int32()), pairs),
                    pa.array([kept[a:b] for a, b in zip(cuts, cuts[1:])], pa.binary())]
        return pa.table(columns, names=[*others, *names])

    return finish(packs, heard, ddl(rest) + ", ".join(f"`{n}` {k}" for n, (_, k) in zip(names, RESULT)), result, key, text)
