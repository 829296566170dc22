"""Vector retrieval over array columns (D1-D14, D36-D40): exact scans, sign codes, hashing, quantisation.

A single query is a constant of the scan: one pass, a bounded top-k, no shuffle.
Query sets go through :func:`block_search`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions import vector as V
from recollect.operators.hnsw import Hnsw

QUERY_BLOCK = 4096
#: Vectors of one graph, and the part of the base from which a delta is merged into it.
GRAPH, MERGE_AT = 4096, 0.1


def search(rows: DataFrame, query, k: int, realm: str | None = None, allowed: DataFrame | None = None, min_similarity: float | None = None) -> DataFrame:
    """Exact cosine top-k, ties to the smaller id; ``allowed`` limits it to given ids."""
    if realm is not None:
        rows = rows.where(F.col("realm") == realm)
    if allowed is not None:
        rows = rows.join(allowed.select("memory_id").distinct(), "memory_id", "left_semi")
    out = rows.withColumn("similarity", V.cosine(F.col("embedding"), V.literal(query))).where(F.col("similarity").isNotNull())
    if min_similarity is not None:
        out = out.where(F.col("similarity") >= min_similarity)
    return out.orderBy(F.col("similarity").desc(), "memory_id").limit(k)


def graph_search(rows: DataFrame, query, k: int, ef: int = 64, shard: int = GRAPH) -> DataFrame:
    """(memory_id, similarity) of the k nearest by a small-world graph per shard, the shards' results merged.

    Vectors go to shards by id hash, so every shard is searched; approximate. Rows
    without a usable vector are left out; ties go to the smaller id.
    """
    shards = max(1, -(-rows.count() // shard))
    q = np.asarray(query, dtype=np.float32)
    q = (q / np.linalg.norm(q))[None]

    def one(table: pa.Table) -> pa.Table:
        lists = table.column("embedding").combine_chunks()
        ids, x = table.column("memory_id").to_numpy(), lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1).astype(np.float32)
        length = np.linalg.norm(x, axis=1)
        ok = np.isfinite(length) & (length > 0)
        order = np.argsort(ids[ok], kind="stable")
        ids, x = ids[ok][order], (x[ok] / length[ok][:, None])[order]
        found, sim = Hnsw(x).search(q, k, ef)
        hit = found[0] >= 0
        return pa.table({"memory_id": ids[found[0][hit]], "similarity": sim[0][hit].astype(np.float64)})

    usable = rows.where(F.size("embedding") == q.shape[1]).select("memory_id", F.col("embedding").cast("array<float>").alias("embedding"), F.pmod(F.xxhash64("memory_id"), F.lit(shards)).alias("shard"))
    found = usable.groupBy("shard").applyInArrow(one, "memory_id long, similarity double")
    return found.orderBy(F.col("similarity").desc(), "memory_id").limit(k)


def two_tier_search(base: DataFrame, delta: DataFrame, deleted: DataFrame, query, k: int, ef: int = 64, shard: int = GRAPH) -> DataFrame:
    """Search over a base and what was added since; a delta of a tenth of the base or more is merged into it first.

    Deleted memories are in neither tier; of a memory in both the delta counts.
    """
    gone = deleted.select("memory_id").distinct()
    fresh = delta.join(gone, "memory_id", "left_anti").select("memory_id", "embedding")
    old = base.join(gone, "memory_id", "left_anti").join(delta.select("memory_id"), "memory_id", "left_anti").select("memory_id", "embedding")
    if fresh.count() >= MERGE_AT * old.count():
        return graph_search(old.unionByName(fresh), query, k, ef, shard)
    both = graph_search(old, query, k, ef, shard).unionByName(graph_search(fresh, query, k, ef, shard))
    return both.orderBy(F.col("similarity").desc(), "memory_id").limit(k)


def boosted(rows: DataFrame, query, context, k: int, beta: float) -> DataFrame:
    """D3: cosine plus ``beta`` times the positive part of the product of context and signature."""
    extra = F.greatest(F.coalesce(V.dot(F.col("signature"), V.literal(context)), F.lit(0.0)), F.lit(0.0))
    return rows.withColumn("similarity", V.cosine(F.col("embedding"), V.literal(query)) + beta * extra).orderBy(F.col("similarity").desc(), "memory_id").limit(k)


def centroid(rows: DataFrame, *keys: str) -> DataFrame:
    """Mean of unit vectors, per key if given."""
    unit = rows.withColumn("_u", F.transform(V.as_double(F.col("embedding")), lambda x: x / V.norm(F.col("embedding"))))
    return V.mean_vector(unit, "_u", *keys)


def centred_search(rows: DataFrame, query, k: int) -> DataFrame:
    """Cosine after the corpus mean is taken off both sides."""
    mean = centroid(rows).first()["mean"]  # one vector
    q = np.asarray(query, dtype=np.float64)
    q = q / np.linalg.norm(q) - np.asarray(mean)
    out = rows.withColumn("_c", V.centre(F.transform(V.as_double(F.col("embedding")), lambda x: x / V.norm(F.col("embedding"))), V.literal(mean)))
    return out.withColumn("similarity", V.dot(F.col("_c"), V.literal(q / np.linalg.norm(q)))).where(F.col("similarity").isNotNull()).orderBy(F.col("similarity").desc(), "memory_id").limit(k)


def codes(rows: DataFrame, dim: int) -> DataFrame:
    """Sign code of every vector."""
    return rows.withColumn("code", V.sign_bits(F.col("embedding"), dim))


def hamming_search(rows: DataFrame, query, dim: int, k: int, width: int = 400) -> DataFrame:
    """The ``width`` nearest by sign code, rescored exactly."""
    q = np.asarray(query)
    words = [int(np.array([sum(1 << i for i, x in enumerate(q[w : w + 64]) if x >= 0)], dtype=np.uint64).view(np.int64)[0]) for w in range(0, dim, 64)]
    near = codes(rows, dim).withColumn("distance", V.hamming(F.col("code"), F.lit(words))).orderBy("distance", "memory_id").limit(width)
    return near.withColumn("similarity", V.cosine(F.col("embedding"), V.literal(query))).orderBy(F.col("similarity").desc(), "memory_id").limit(k)


def planes(dim: int, bits: int = 12, tables: int = 4, seed: int = 5) -> np.ndarray:
    """(tables, bits, dim) random hyperplanes of a fixed seed, to three decimals."""
    return np.round(np.random.default_rng(seed).standard_normal((tables, bits, dim)), 3)


def signatures(rows: DataFrame, dim: int, bits: int = 12, tables: int = 4) -> DataFrame:
    """(memory_id, table, signature): which side of each plane a vector lies."""
    p = planes(dim, bits, tables)
    one = lambda t: sum((F.when(V.dot(F.col("embedding"), V.literal(p[t, b])) >= 0, F.lit(1 << b)).otherwise(F.lit(0)) for b in range(bits)), F.lit(0))
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("table"), one(t).alias("signature")) for t in range(tables)])).alias("s")
    return rows.select("memory_id", each).select("memory_id", "s.table", "s.signature")


def bucket_candidates(signed: DataFrame, query_id: int) -> DataFrame:
    """Vectors that share a bucket with the query in some table."""
    own = signed.where(F.col("memory_id") == query_id).select("table", "signature")
    return signed.join(F.broadcast(own), ["table", "signature"], "left_semi").where(F.col("memory_id") != query_id).select("memory_id").distinct()  # own: one row a table


def probes(rows: DataFrame, centres: DataFrame, n: int) -> DataFrame:
    """The n nearest centres of every vector; the centres are a bounded set bound as constants."""
    known = centres.orderBy("centre").collect()
    scored = F.array(*[F.struct(V.cosine(F.col("embedding"), V.literal(c["mean"])).alias("similarity"), F.lit(-int(c["centre"])).alias("minus")) for c in known])
    best = F.slice(F.reverse(F.array_sort(scored)), 1, n)
    return rows.select("memory_id", F.posexplode(best).alias("rank", "b")).select("memory_id", (F.col("rank") + 1).alias("rank"), (-F.col("b.minus")).alias("centre"), F.col("b.similarity").alias("similarity"))


def _block(queries: np.ndarray, ids: np.ndarray, realms: list, k: int, low: float, high: float):
    groups = {r: i for i, r in enumerate(sorted({x for x in realms if x is not None}))}
    own = np.array([groups.get(r, -1) for r in realms])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array(batch.column("embedding").to_pylist(), dtype=np.float64)
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
            theirs = np.array([groups.get(r, -2) for r in batch.column("realm").to_pylist()])
            rid = batch.column("memory_id").to_numpy()
            s = queries @ x.T
            s[(own[:, None] != theirs[None]) | (ids[:, None] == rid[None]) | (s < low) | (s >= high)] = -np.inf
            top = min(k, s.shape[1])
            part = np.argpartition(-s, top - 1, axis=1)[:, :top]
            value = np.take_along_axis(s, part, 1)
            q, c = np.nonzero(np.isfinite(value))
            yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(rid[part[q, c]]), pa.array(value[q, c])], names=["src", "dst", "similarity"])

    return run


def block_search(rows: DataFrame, queries: DataFrame, k: int, low: float = -2.0, high: float = 2.0) -> DataFrame:
    """Exact top-k within the realm for a stated query set, (src, dst, similarity, rank).

    Queries go out in blocks of ``QUERY_BLOCK``; each batch of rows meets a block
    in one product and passes on its own top-k only.
    """
    parts, last = [], -(2**63)
    while True:
        block = queries.where(F.col("memory_id") > last).orderBy("memory_id").limit(QUERY_BLOCK).select("memory_id", "realm", "embedding").collect()  # bounded
        if not block:
            break
        q = np.array([r["embedding"] for r in block], dtype=np.float64)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        kernel = _block(q, np.array([r["memory_id"] for r in block], dtype=np.int64), [r["realm"] for r in block], k, low, high)
        parts.append(rows.select("memory_id", "realm", "embedding").mapInArrow(kernel, "src long, dst long, similarity double"))
        last = block[-1]["memory_id"]
        if len(block) < QUERY_BLOCK:
            break
    if not parts:
        return rows.sparkSession.createDataFrame([], "src long, dst long, similarity double, rank int")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.col("similarity").desc(), "dst"))
    return every.withColumn("rank", rank).where(F.col("rank") <= k)


def pq_train(sample: np.ndarray, subs: int, centres: int, rounds: int = 10) -> np.ndarray:
    """(subs, centres, width) centroids of each part of the vectors, on a bounded sample."""
    rng, width = np.random.default_rng(3), sample.shape[1] // subs
    out = np.zeros((subs, centres, width))
    for s in range(subs):
        x = sample[:, s * width : (s + 1) * width]
        c = x[rng.choice(len(x), centres, replace=len(x) < centres)].copy()
        for _ in range(rounds):
            near = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
            for j in range(centres):
                if (near == j).any():
                    c[j] = x[near == j].mean(axis=0)
        out[s] = c
    return out


def pq_encode(rows: DataFrame, book: np.ndarray) -> DataFrame:
    """(memory_id, code, error): nearest centroid of every part and the squared error of rebuilding."""
    subs, _, width = book.shape

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array(batch.column("embedding").to_pylist(), dtype=np.float64)
            code = np.stack([((x[:, None, s * width : (s + 1) * width] - book[s][None]) ** 2).sum(axis=2).argmin(axis=1) for s in range(subs)], axis=1)
            rebuilt = np.concatenate([book[s][code[:, s]] for s in range(subs)], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("memory_id"), pa.array(code.tolist(), type=pa.list_(pa.int32())), pa.array(((x - rebuilt) ** 2).sum(axis=1))], names=["memory_id", "code", "error"])

    return rows.select("memory_id", "embedding").mapInArrow(run, "memory_id long, code array<int>, error double")

