"""Hyperdimensional codes of text and episodes (D15-D25), as numpy kernels over Arrow batches.

A word's 8192-bit vector follows from its bytes alone, so no vocabulary is kept;
texts are majority bundles. Bundles of groups are sums of bit counts, which are
pre-aggregated per batch, so a group of any size is one partial sum a task.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.functions import vector as V

WORDS = 128
BITS = 64 * WORDS
_MASK = (1 << 64) - 1


@lru_cache(maxsize=100_000)
def word(text: str) -> bytes:
    """FNV hash of the bytes seeds a xorshift generator that yields the 128 words."""
    s = 0xCBF29CE484222325
    for b in text.encode():
        s = (s * 0x100000001B3 & _MASK) ^ b
    s = (s + 1) & _MASK
    out = np.empty(WORDS, dtype=np.uint64)
    for i in range(WORDS):
        s ^= s << 13 & _MASK
        s ^= s >> 7
        s ^= s << 17 & _MASK
        out[i] = s
    return out.tobytes()


def bits(vector: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(vector, dtype=np.uint8), bitorder="little")


def bind(a: bytes, b: bytes) -> bytes:
    """Exclusive or."""
    return (np.frombuffer(a, dtype=np.uint64) ^ np.frombuffer(b, dtype=np.uint64)).tobytes()


def majority(counts: np.ndarray, n: int) -> bytes:
    """Bits set in more than half of n vectors; ties and no vectors give 0."""
    return np.packbits(counts >= n // 2 + 1, bitorder="little").tobytes() if n else bytes(BITS // 8)


def bundle(vectors: list[bytes]) -> bytes:
    return majority(np.sum([bits(v) for v in vectors], axis=0, dtype=np.int64) if vectors else np.zeros(BITS), len(vectors))


def encode(text: str | None) -> bytes:
    """Bundle of the vectors of all words of two bytes or more."""
    return bundle([word(t) for t in re.split(r"[\W_]+", (text or "").lower()) if len(t.encode()) >= 2])


def encoded(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, code as 128 words)."""

    def run(batches):
        for batch in batches:
            found = [np.frombuffer(encode(t), dtype=np.int64) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(found, type=pa.list_(pa.int64()))], names=["key", "code"])

    return rows.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(run, "key long, code array<long>").withColumnRenamed("key", key)


def as_column(vector: bytes):
    return F.lit([int(x) for x in np.frombuffer(vector, dtype=np.int64)])


def nearest(codes: DataFrame, query: bytes, k: int, key: str = "memory_id") -> DataFrame:
    """K nearest by Hamming distance, ties to the smaller id, with similarity."""
    near = codes.withColumn("distance", V.hamming(F.col("code"), as_column(query))).orderBy("distance", key).limit(k)
    return near.withColumn("similarity", 1.0 - F.col("distance") / F.lit(float(BITS)))


def query_and(terms: list[str]) -> bytes:
    """Conjunction of words by binding."""
    out = word(terms[0].lower())
    for t in terms[1:]:
        out = bind(out, word(t.lower()))
    return out


def group_bundles(codes: DataFrame, group: str) -> dict:
    """Bundle per group; each batch yields one count vector per group. Groups are few (realms)."""

    def run(batches):
        for batch in batches:
            names = batch.column("group").to_pylist()
            if not names:
                continue
            b = np.unpackbits(np.array(batch.column("code").to_pylist(), dtype=np.int64).view(np.uint8), axis=1, bitorder="little")
            for g in sorted(set(names)):
                on = np.array([n == g for n in names])
                yield pa.RecordBatch.from_arrays([pa.array([g]), pa.array([int(on.sum())]), pa.array([b[on].sum(axis=0, dtype=np.int64).tolist()], type=pa.list_(pa.int64()))], names=["group", "n", "counts"])

    parts = codes.where(F.col(group).isNotNull()).select(F.col(group).alias("group"), "code").mapInArrow(run, "group string, n long, counts array<long>")
    flat = parts.select("group", F.posexplode("counts").alias("at", "c")).groupBy("group", "at").agg(F.sum("c").alias("c"))
    total = {r["group"]: r["n"] for r in parts.groupBy("group").agg(F.sum("n").alias("n")).collect()}
    counts = {g: np.zeros(BITS, dtype=np.int64) for g in total}
    for r in flat.collect():  # groups x 8192 numbers
        counts[r["group"]][r["at"]] = r["c"]
    return {g: majority(counts[g], total[g]) for g in total}


OUTCOME = {0: "success", 1: "fail", 2: "error"}


def episode(tool: str, entity: str, outcome: int) -> bytes:
    """Tool, entity and outcome bound to their roles, superposed."""
    out = bind(word("ROLE:TOOL"), word(tool))
    out = bind(out, bind(word("ROLE:ENTITY"), encode(entity)))
    return bind(out, bind(word("ROLE:OUTCOME"), word(OUTCOME.get(outcome, "partial"))))


def unbind(tape: DataFrame, tool: str, query_role: str, k: int) -> DataFrame:
    """(value, similarity): given a tool, the likeliest values of another role: bundle, unbind, clean up by codebook.

    Equal episodes are counted first, so the bundle is a weighted sum over the
    distinct (entity, outcome) pairs of the tool, added up in the map tasks; only
    one number per bit reaches the driver. The codebook is compared in the map.
    """
    seen = tape.where(F.col("tool") == tool).groupBy("entity", "outcome").agg(F.count(F.lit(1)).alias("n"))

    def add(batches):
        for batch in batches:
            total, n = np.zeros(BITS, dtype=np.int64), 0
            for entity, outcome, times in zip(*(batch.column(c).to_pylist() for c in ("entity", "outcome", "n")), strict=True):
                total += np.int64(times) * bits(episode(tool, entity, outcome))  # the bits are bytes: a plain int above 255 doesn't fit
                n += times
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tolist()], type=pa.list_(pa.int64()))], names=["n", "counts"])

    parts = seen.mapInArrow(add, "n long, counts array<long>")
    flat = parts.select("n", F.posexplode("counts").alias("at", "c")).groupBy("at").agg(F.sum("c").alias("c"), F.sum("n").alias("n")).collect()  # one row a bit
    counts, n = np.zeros(BITS, dtype=np.int64), 0
    for r in flat:
        counts[r["at"]], n = r["c"], r["n"]
    probe = bind(majority(counts, n), bind(word("ROLE:TOOL"), word(tool)))
    probe = bind(probe, word({"entity": "ROLE:ENTITY", "outcome": "ROLE:OUTCOME"}[query_role]))
    code = (lambda v: encode(v)) if query_role == "entity" else (lambda v: word(OUTCOME.get(v, "partial")))

    def rate(batches):
        for batch in batches:
            names = batch.column("value").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([str(v) for v in names], type=pa.string()), pa.array([1.0 - int(bits(bind(probe, code(v))).sum()) / BITS for v in names], type=pa.float64())], names=["value", "similarity"])

    values = tape.select(F.col(query_role).alias("value")).where(F.col("value").isNotNull()).distinct()
    return values.mapInArrow(rate, "value string, similarity double").orderBy(F.col("similarity").desc(), "value").limit(k)
