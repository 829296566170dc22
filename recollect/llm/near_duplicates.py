"""Near-duplicate records, by MinHash candidates with Bayesian pruning (problem 6).

Records of one group (realm) with equal term sets form a class, represented by
its least id. Representatives get MinHash values: ``BANDS`` bands of ``ROWS``
values propose candidate pairs, a sketch of ``SKETCH`` further one-byte values
judges them. The sketch is compared step by step; a pair is dropped as soon as
the posterior probability of reaching the threshold falls below ``TOLERANCE``.
Survivors are verified exactly on their terms.

A pair at the threshold of 0.6 meets in some band with probability 0.996, one
at 0.65 with 0.9993; the tolerance loses about one pair in ten thousand.

Defined results: null ids, null groups and contents without terms say nothing;
repeated rows of a record count once (greatest content and group); an empty
table gives no rows; extra columns are dropped; very long texts are whole.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.functions.text import terms
from recollect.storage import materialize

BANDS, ROWS, SKETCH, STEP = 40, 4, 32, 8
TOLERANCE = 1e-4
#: Rows of one band value met in one run; larger ones are cut into blocks that meet pairwise.
RUN = 2_000


def records(rows: DataFrame) -> DataFrame:
    """(memory_id, realm, terms, c1, c2) of each record that has a realm and terms; terms distinct and sorted, c1 and c2 96 bits that name the class."""
    once = rows.where(F.col("memory_id").isNotNull()).groupBy("memory_id").agg(F.max("content").alias("content"), F.max("realm").alias("realm"))
    found = once.select("memory_id", "realm", F.array_sort(F.array_distinct(terms(F.col("content")))).alias("terms")).where(F.col("realm").isNotNull() & (F.size("terms") > 0))
    return found.select("*", F.xxhash64("realm", "terms").alias("c1"), F.hash("terms", "realm").alias("c2"))


def least_matches(threshold: float, tolerance: float = TOLERANCE) -> list[int]:
    """Matches needed after each step of the sketch.

    Under a uniform prior P(similarity >= t | m of n match) is the chance that a
    binomial of n + 1 trials at t has at most m successes; one-byte values agree
    by accident once in 256.
    """
    t, need = threshold + (1 - threshold) / 256, []
    for n in range(STEP, SKETCH + 1, STEP):
        tail, m = 0.0, -1
        while m < n:
            tail += comb(n + 1, m + 1) * t ** (m + 1) * (1 - t) ** (n - m)
            if tail >= tolerance:
                break
            m += 1
        need.append(m + 1)
    return need


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240601)
    n = BANDS * ROWS + SKETCH
    return rng.integers(1, 2**63, n, dtype=np.uint64) | np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def _signatures(batches):
    """Arrow batches (rep, group, size, hashes) -> (rep, size, keys, sketch)."""
    mul, add = _coefficients()
    powers = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)
    for batch in batches:
        if not batch.num_rows:
            continue
        lists = batch.column("hashes")
        offsets = lists.offsets.to_numpy()
        flat = lists.values.to_numpy()[offsets[0] : offsets[-1]].view(np.uint64)
        starts, n = (offsets[:-1] - offsets[0]).astype(np.int64), batch.num_rows
        values = np.empty((len(mul), n), dtype=np.uint32)
        for i in range(len(mul)):
            x = flat * mul[i]
            x += add[i]
            values[i] = np.minimum.reduceat((x >> np.uint64(32)).astype(np.uint32), starts)
        group = batch.column("group").to_numpy().view(np.uint64)
        bands = values[: BANDS * ROWS].reshape(BANDS, ROWS, n).astype(np.uint64)
        keys = np.zeros((BANDS, n), dtype=np.uint64)
        for r in range(ROWS):
            keys = (keys ^ bands[:, r]) * powers[r]
            keys ^= keys >> np.uint64(29)
        keys = (keys + group + np.arange(1, BANDS + 1, dtype=np.uint64)[:, None] * powers[0]) * powers[1]
        keys ^= keys >> np.uint64(32)
        mixed = values[BANDS * ROWS :]
        mixed = mixed ^ (mixed >> 16)
        sketch = np.ascontiguousarray(((mixed ^ (mixed >> 8)) & 0xFF).astype(np.uint8).T)
        keyed = np.ascontiguousarray(keys.T).view(np.int64).ravel()
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("rep"),
                batch.column("size"),
                pa.ListArray.from_arrays(pa.array(np.arange(0, n * BANDS + 1, BANDS, dtype=np.int32)), pa.array(keyed)),
                pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * SKETCH, SKETCH, dtype=np.int32)), pa.py_buffer(sketch)]),
            ],
            names=["rep", "size", "keys", "sketch"],
        )


def signatures(classes: DataFrame) -> DataFrame:
    """(rep, size, keys, sketch) of every class representative."""
    rows = classes.select("rep", F.xxhash64("realm").alias("group"), F.size("terms").alias("size"), F.transform("terms", lambda t: F.xxhash64(t)).alias("hashes"))
    return rows.mapInArrow(_signatures, "rep long, size int, keys array<long>, sketch binary")


def _pairs_of_runs(key, blk, cross, rep, size, sketch, threshold, need):
    """Candidate pairs in runs of equal key, pruned step by step; all rows of one offset at once."""
    found = []
    for d in range(1, len(key)):
        i = np.nonzero(key[d:] == key[:-d])[0]
        if not len(i):
            break
        j = i + d
        ok = (rep[i] != rep[j]) & (~cross[i] | (blk[i] != blk[j])) & (np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j]) - 1e-9)
        i, j = i[ok], j[ok]
        matches = np.zeros(len(i), dtype=np.int32)
        for s, least in enumerate(need):
            part = slice(s * STEP, (s + 1) * STEP)
            matches += (sketch[i, part] == sketch[j, part]).sum(axis=1, dtype=np.int32)
            keep = matches >= least
            i, j, matches = i[keep], j[keep], matches[keep]
        if len(i):
            found.append((np.minimum(rep[i], rep[j]), np.maximum(rep[i], rep[j])))
    if not found:
        return None
    a, b = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    both = np.unique(np.stack([a, b]), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])


def _prune(threshold: float, flush: int = 60_000):
    need = least_matches(threshold)

    def run(batches):
        held: list[pa.RecordBatch] = []

        def meet(part: pa.Table):
            col = {n: part.column(n).combine_chunks() for n in part.column_names}
            sketch = np.frombuffer(b"".join(col["sketch"].to_pylist()), dtype=np.uint8).reshape(-1, SKETCH)
            return _pairs_of_runs(*(col[n].to_numpy(zero_copy_only=False) for n in ("key", "blk", "cross", "rep", "size")), sketch, threshold, need)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) < flush:
                continue
            part = pa.Table.from_batches(held)
            key = part.column("key").combine_chunks().to_numpy()
            cut = int(np.searchsorted(key, key[-1], side="left"))
            if cut:
                out = meet(part.slice(0, cut))
                if out is not None:
                    yield out
                held = part.slice(cut).to_batches()
        if held:
            out = meet(pa.Table.from_batches(held))
            if out is not None:
                yield out

    return run


def _hot(bands: DataFrame, run: int) -> DataFrame:
    """(key, n) of the band values met by more than ``run`` rows: at most rows / run of them."""
    return materialize(bands.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > run), "hot-bands")


def candidates(signed: DataFrame, threshold: float, run: int = RUN) -> DataFrame:
    """Distinct (a, b) representatives that survive the pruning.

    No bucket, however hot, is one task's work and none is capped. A band value
    met by more than ``run`` rows is cut into blocks by id hash, and every two
    blocks meet in a run of their own: ``n / run`` copies of a row. Where that
    would be more copies than the sketch has bytes, the value is first refined:
    its rows meet where two neighbouring bytes of the sketch agree as well, and
    only refined values that are still hot are cut into blocks. Two records that
    reach the threshold agree on 19 of 32 bytes on average and are certain to
    meet from 17; at 0.6 about one pair in 10^5 agrees on few enough to miss.
    """
    spark = signed.sparkSession
    bands = signed.select(F.explode("keys").alias("key"), "rep", "size", "sketch")
    hot = _hot(bands, run)
    none = F.lit(0).cast("int")
    if not hot.where(F.col("n") > run * SKETCH).isEmpty():
        boiled = F.broadcast(hot.where(F.col("n") > run * SKETCH).select("key", F.lit(True).alias("_refine")))
        marked = bands.join(boiled, "key", "left")
        at = F.explode(F.sequence(F.lit(1), F.lit(SKETCH))).alias("_at")
        byte = lambda i: F.substring("sketch", i, F.lit(1))
        finer = marked.where("_refine").select("*", at).select(F.xxhash64("key", "_at", byte(F.col("_at")), byte(F.col("_at") % SKETCH + 1)).alias("key"), "rep", "size", "sketch")
        bands = materialize(marked.where("_refine IS NULL").drop("_refine").unionByName(finer), "bands")
        hot = _hot(bands, run)
    if hot.isEmpty():
        keyed = bands.select("key", none.alias("blk"), F.lit(False).alias("cross"), "rep", "size", "sketch")
    else:
        blocks = hot.select("key", F.ceil(F.col("n") / run).cast("int").alias("blocks"))
        marked = bands.join(F.broadcast(blocks), "key", "left").withColumn("blk", F.when(F.col("blocks").isNull(), none).otherwise(F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")))
        other = F.explode(F.sequence(none, F.coalesce("blocks", F.lit(1)) - 1)).alias("other")
        keyed = marked.select("*", other).select(
            F.when(F.col("blocks").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least("blk", "other"), F.greatest("blk", "other"))).alias("key"),
            "blk",
            (F.col("blocks").isNotNull() & (F.col("blk") != F.col("other"))).alias("cross"),
            "rep",
            "size",
            "sketch",
        )
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    sorted_ = keyed.repartition(width, "key").sortWithinPartitions("key")
    return sorted_.mapInArrow(_prune(threshold), "a long, b long").distinct()


class NearDuplicates:
    """Classes of equal term sets, their members, and verified links between classes."""

    def __init__(self, rows: DataFrame, threshold: float = 0.6, run: int = RUN):
        docs = materialize(records(rows), "dup-records")
        self.docs, self.run = docs, run
        self.classes = materialize(docs.groupBy("c1", "c2").agg(F.min_by(F.struct("realm", "terms"), "memory_id").alias("_t"), F.min("memory_id").alias("rep"), F.count(F.lit(1)).alias("n")).select("c1", "c2", "_t.realm", "_t.terms", "rep", "n"), "dup-classes")
        found = materialize(candidates(materialize(signatures(self.classes), "dup-signatures"), threshold, run), "dup-candidates")
        side = lambda c: self.classes.select(F.col("rep").alias(c), F.col("terms").alias(f"t{c}"), F.col("n").alias(f"n{c}"))
        shared = F.size(F.array_intersect("ta", "tb"))
        rated = found.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", shared.alias("i"), (F.size("ta") + F.size("tb") - shared).alias("u"))
        links = rated.select("a", "b", "na", "nb", (F.col("i") / F.col("u")).alias("similarity")).where(F.col("similarity") >= threshold - 1e-12)
        self.links = materialize(links, "dup-links")

    def members(self) -> DataFrame:
        """(memory_id, rep) of every record in a class of several."""
        several = self.classes.where(F.col("n") > 1).select("c1", "c2", "rep")
        return self.docs.select("memory_id", "c1", "c2").join(several, ["c1", "c2"]).select("memory_id", "rep")

    def pairs(self, expand: int | None = None) -> DataFrame:
        """(memory_a, memory_b): links between classes, and members of one class, member by member.

        Classes above ``run`` members are cut into blocks by id hash that meet
        pairwise. Only if ``expand`` is given, a class of more members is given
        by its representative, and each member linked to that.
        """
        whole = self.classes.where(F.col("n") > 1) if expand is None else self.classes.where(F.col("n").between(2, expand))
        blocks = whole.select("rep", F.ceil(F.col("n") / self.run).cast("int").alias("blocks"))
        who = self.members().join(blocks, "rep").withColumn("blk", F.pmod(F.xxhash64("memory_id"), F.col("blocks")).cast("int"))
        who = materialize(who, "dup-members")
        every = lambda c: F.explode(F.sequence(F.lit(0), F.coalesce(c, F.lit(1)) - 1))
        inner = self.links.select(F.col("a").alias("memory_a"), F.col("b").alias("memory_b"))
        full = self.links.where((F.col("na") > 1) | (F.col("nb") > 1))
        for c in ("a", "b"):
            full = full.join(blocks.toDF(c, "blocks"), c, "left").withColumn(f"blk{c}", every(F.col("blocks"))).drop("blocks")
            full = full.join(who.select(F.col("rep").alias(c), F.col("blk").alias(f"blk{c}"), F.col("memory_id").alias(f"m{c}")), [c, f"blk{c}"], "left")
        full = full.select(F.coalesce("ma", "a").alias("memory_a"), F.coalesce("mb", "b").alias("memory_b"))
        x = who.select("rep", F.col("blk").alias("p"), every(F.col("blocks")).alias("q"), F.col("memory_id").alias("memory_a"))
        y = who.select("rep", every(F.col("blocks")).alias("p"), F.col("blk").alias("q"), F.col("memory_id").alias("memory_b"))
        copies = x.join(y, ["rep", "p", "q"]).where("memory_a < memory_b").select("memory_a", "memory_b")
        both = inner.unionByName(full).unionByName(copies)
        if expand is not None:
            large = self.members().join(self.classes.where(F.col("n") > expand).select("rep"), "rep").where(F.col("rep") != F.col("memory_id"))
            both = both.unionByName(large.select(F.col("rep").alias("memory_a"), F.col("memory_id").alias("memory_b")))
        return both.select(F.least("memory_a", "memory_b").alias("memory_a"), F.greatest("memory_a", "memory_b").alias("memory_b")).distinct()
