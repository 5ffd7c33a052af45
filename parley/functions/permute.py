"""Repeatable random orders without sorting: a keyed bijection of 0..n-1.

A row number is split into two digits, and a few rounds each add a keyed mix of one digit to the other (a Feistel network
over a rectangle just large enough for n, as Black and Rogaway describe). Every round can be undone, so two numbers never
meet; a result beyond n - 1 goes through the rounds again. Different seeds or tweaks give different orders.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, functions as F

PRIME = 2147483647
ROUNDS = 6  # even, so that the digits end where they began
WALKS = 64  # fewer than 1 / b of the numbers lie beyond n - 1, and there are fewer than b of them


def _constants(seed: int) -> list[tuple[int, int, int]]:
    r = random.Random(seed)
    return [(r.randrange(1, PRIME), r.randrange(PRIME), r.randrange(PRIME)) for _ in range(ROUNDS)]


def mixed(x: Column, constants: Column) -> Column:
    """A number below ``PRIME`` from one below it and three constants."""
    first = (x * constants["a"] + constants["b"]) % PRIME
    return (first * x + constants["c"]) % PRIME


def drawn(x: Column, n: int, seed: int) -> Column:
    """A repeatable number in 0..n-1 for each ``x``; unlike ``permuted`` it may give equal numbers."""
    a, b, c = (F.lit(v).cast("long") for v in _constants(seed)[0])
    return mixed(F.pmod(x.cast("long"), F.lit(PRIME)), {"a": a, "b": b, "c": c}) % n


def permuted(index: Column, n: Column, seed: int, tweak: Column | int = 0) -> Column:
    """The place of ``index`` (0..n-1) in a random order of n; for n below 2^61."""
    tweak = F.pmod((F.lit(tweak) if isinstance(tweak, int) else tweak).cast("long"), F.lit(PRIME))
    n = n.cast("long")
    div = lambda x, y: F.call_function("div", x, y)
    high = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    low = div(n + high - 1, high)
    rounds = F.array(*[F.struct(*[F.lit(v).cast("long").alias(c) for c, v in zip("abc", k)]) for k in _constants(seed)])

    def state(l, r, ml, mr):
        return F.struct(l.alias("l"), r.alias("r"), ml.alias("ml"), mr.alias("mr"))

    def one(x: Column) -> Column:
        r = x % low
        end = F.aggregate(rounds, state(div(x, low), r, high, low), lambda s, k: state(
            s["r"], (s["l"] + mixed((s["r"] + tweak) % PRIME, k)) % s["ml"], s["mr"], s["ml"]))
        return F.aggregate(F.array(end), F.lit(0).cast("long"), lambda _, s: s["l"] * low + s["r"])

    return F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), one(index.cast("long")), lambda x, _: F.when(x < n, x).otherwise(one(x)))


def permuted_sql(source: str, index: str, n: str, seed: int, tweak: str = "0") -> str:
    """The same as the table ``perm`` of a recursive WITH: the columns of ``source`` and ``place``."""
    step = "SELECT *, _x // _b AS _l, _x % _b AS _r, _a AS _ml, _b AS _mr FROM w WHERE NOT _done"
    for a, b, c in _constants(seed):
        step = (f"SELECT * REPLACE (_r AS _l, (_l + ((({a} * _u + {b}) % {PRIME}) * _u + {c}) % {PRIME}) % _ml AS _r, _mr AS _ml, _ml AS _mr) "
                f"FROM (SELECT * REPLACE ((_r + _t) % {PRIME} AS _u) FROM ({step}))")
    step = f"SELECT * EXCLUDE (_l, _r, _ml, _mr) REPLACE (_l * _b + _r AS _x, _l * _b + _r < _n AS _done) FROM ({step})"
    return f"""w AS (SELECT *, (_n + _a - 1) // _a AS _b FROM (SELECT *, {index}::BIGINT AS _x, false AS _done, {n}::BIGINT AS _n, 0::BIGINT AS _u,
    ({tweak})::BIGINT % {PRIME} AS _t, ceil(sqrt({n}))::BIGINT AS _a FROM {source})
  UNION ALL {step}),
perm AS (SELECT * EXCLUDE (_x, _done, _n, _u, _t, _a, _b), _x AS place FROM w WHERE _done)"""


def drawn_sql(x: str, n: int, seed: int) -> str:
    a, b, c = _constants(seed)[0]
    u = f"(({x})::BIGINT % {PRIME})"
    return f"((((({a} * {u} + {b}) % {PRIME}) * {u} + {c}) % {PRIME}) % {n})"
