"""Joins that survive one key holding a large part of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# A lookup table up to this many rows and bytes may be broadcast; beyond it the salted join is used.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
SALTS = 16


def salted_join(facts: DataFrame, dim: DataFrame, on: list[str], how: str = "inner", salts: int = SALTS,
                by: list[str] | None = None) -> DataFrame:
    """Equi-join where ``facts`` may be skewed on ``on`` and ``dim`` has few rows per key.

    Every fact row gets one of ``salts`` salts from its own content and every ``dim`` row is repeated once per salt,
    so a key holding a third of all facts is spread over ``salts`` tasks. ``how`` may be inner, left, left_semi or
    left_anti: each keeps or drops fact rows, so repeating ``dim`` never repeats a result row. ``by`` names the columns
    the salt is made from, where a few of them tell the rows of a key apart; without it all columns are hashed.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"salted_join cannot repeat the right side of a {how} join")
    spread = by or [f.name for f in facts.schema.fields if not isinstance(f.dataType, T.MapType)]
    salted = facts.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)))
    repeated = dim.withColumn("_salt", F.explode(F.array(*[F.lit(s).cast("long") for s in range(salts)])))
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")


def lookup_join(facts: DataFrame, dim: DataFrame, on: list[str], how: str = "inner",
                limit: int = BROADCAST_ROWS, small: bool | None = None, by: list[str] | None = None) -> DataFrame:
    """Join to a lookup table: broadcast when a bounded count proves it small, salted otherwise.

    ``small`` hands in the answer where the caller has counted already.
    """
    if fits(dim, limit) if small is None else small:
        return facts.join(F.broadcast(dim), on, how)
    return salted_join(facts, dim, on, how, by=by)


def fits(df: DataFrame, limit: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> bool:
    """True when ``df`` has at most ``limit`` rows and about ``most`` bytes; stops after ``limit + 1`` rows."""
    size = sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(0).cast("long"))
    rows, total = df.limit(limit + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return rows <= limit and total <= most


def _bytes(value: Column, kind: T.DataType) -> Column:
    """About how many bytes a value takes."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)).cast("long") + 16
    if isinstance(kind, T.ArrayType):
        each = F.aggregate(value, F.lit(0).cast("long"), lambda s, x: s + _bytes(x, kind.elementType)) if isinstance(
            kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType)) else F.size(value).cast("long") * 8
        return F.coalesce(each, F.lit(0).cast("long")) + 16
    if isinstance(kind, T.StructType):
        return sum((_bytes(value[f.name], f.dataType) for f in kind.fields), F.lit(8).cast("long"))
    if isinstance(kind, T.MapType):
        return _bytes(F.map_values(value), T.ArrayType(kind.valueType)) + _bytes(F.map_keys(value), T.ArrayType(kind.keyType))
    return F.lit(8).cast("long")
