"""Vectors as array columns: products, centring, sign codes, Hamming distance, positional means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = 64


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision; null if either side is null."""
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; null where a side has no length."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def literal(values) -> Column:
    """A query vector as one constant column."""
    return F.lit([float(x) for x in values])


def centre(v: Column, mean: Column) -> Column:
    """Unit vector of ``v`` less the corpus mean (D4); null where nothing is left."""
    moved = F.zip_with(as_double(v), as_double(mean), lambda x, m: x - m)
    length = norm(moved)
    return F.when(length > 0, F.transform(moved, lambda x: x / length))


def mean_vector(rows: DataFrame, vector: str, *keys: str) -> DataFrame:
    """Positional mean per key as ``mean`` (D5): one aggregation over (key, position), map-side combined."""
    flat = rows.select(*keys, F.posexplode(as_double(F.col(vector))).alias("_pos", "_x")).groupBy(*keys, "_pos").agg(F.avg("_x").alias("_m"))
    lists = flat.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_pos", "_m"))).alias("_l"))
    return lists.select(*keys, F.transform("_l", lambda e: e["_m"]).alias("mean"))


def sign_bits(v: Column, dim: int) -> Column:
    """Sign code (D6): bit i of word i//64 is set where component i is not negative."""
    words = []
    for w in range(0, dim, WORD):
        part = F.slice(as_double(v), w + 1, min(WORD, dim - w))
        bits = F.transform(part, lambda x, i: F.when(x >= 0, F.expr("1L")).otherwise(F.expr("0L")) * F.lit(1).cast("long"))
        words.append(F.aggregate(F.transform(bits, lambda b, i: F.call_function("shiftleft", b, i)), F.lit(0).cast("long"), lambda s, b: s.bitwiseOR(b)))
    return F.array(*words)


def hamming(a: Column, b: Column) -> Column:
    """Bits that differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def xor(a: Column, b: Column) -> Column:
    """Binding of two hypervectors."""
    return F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))
