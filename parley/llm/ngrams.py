"""Hashed character n-grams of whole texts, computed for a block of texts at once."""

from __future__ import annotations

from functools import lru_cache


@lru_cache(maxsize=1)
def letters():
    """Which code points are letters."""
    import numpy as np

    table = np.zeros(0x110000, bool)
    for c in range(0x110000):
        if chr(c).isalpha():
            table[c] = True
    return table


def symbols(texts):
    """The lower-case letters of the texts as code points with one 0 between words, the text of each, and if texts have letters.

    Every text starts and ends with a 0. Texts are read slice by slice by the caller; this holds the block in memory.
    """
    import numpy as np

    lowered = [(t or "").lower() for t in texts]
    joined = " ".join(["", *lowered, ""]).encode("utf-32-le", "replace")
    code = np.frombuffer(joined, np.uint32)
    sym = np.where(letters()[np.minimum(code, 0x10FFFF)], code, 0).astype(np.uint32)
    ends = np.cumsum([len(t) + 1 for t in lowered])  # the blank before each next text
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in lowered])
    owner = np.append(owner, len(texts) - 1 if texts else 0)[:len(sym)]
    keep = np.ones(len(sym), bool)
    keep[1:] = (sym[1:] != 0) | (sym[:-1] != 0)
    has = np.bincount(owner[sym != 0], minlength=len(texts)) > 0
    del ends
    return sym[keep], owner[keep], has


def hashed(sym, owner, order: int, bits: int):
    """Buckets of the n-grams of ``order`` that lie in one word (its borders included), and the text of each.

    A gram may start or end with the blank beside a word but has none inside; a gram of two keeps at least one letter.
    """
    import numpy as np

    n = len(sym) - order + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = sym[:n].astype(np.uint64)
    for j in range(1, order):
        code *= np.uint64(0x9E3779B97F4A7C15)
        code ^= code >> np.uint64(31)
        code += sym[j:j + n]
    code *= np.uint64(0xD6E8FEB86659FD93)
    code >>= np.uint64(64 - bits)
    if order == 2:
        good = (sym[:n] != 0) | (sym[1:n + 1] != 0)
    else:
        good = sym[1:n + 1] != 0
        for j in range(2, order - 1):
            good &= sym[j:j + n] != 0
    # the second symbol's text, as the first may be the blank that ends the text before; of pairs, the letter's
    whose = np.where(sym[:n] != 0, owner[:n], owner[1:n + 1]) if order == 2 else owner[1:n + 1]
    return code[good].astype(np.int64), whose[good]
