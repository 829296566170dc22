"""Recall: lanes, fusion, caps, windows, sessions, relaxation and neighbours."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions.scoring import Context, decompose, effective_strength
from recollect.functions.vector import cosine, literal
from recollect.operators.graph import ppr_lane
from recollect.operators.lexical import bm25
from recollect.operators.memory import in_range, live
from recollect.operators.sparse_codes import posting_search
from recollect.operators.vectors import block_search, search
from recollect.storage import materialize

RRF_K = 60.0
FETCH = 4
LURE_RISK, LURE_MOST = 0.7, 2
#: Hits that seed the graph lane, and how many it gives.
PPR_SEEDS, PPR_GIVES = 5, 15
#: Vectors of one side of a product of the duplicate band.
BAND_BLOCK = 2048


def visible(memory: DataFrame, realm: str | None = None) -> DataFrame:
    """Live memories; realms that begin with ``soul:`` only when asked for."""
    out = live(memory)
    if realm is None or not realm.startswith("soul:"):
        out = out.where(~F.coalesce(F.startswith("realm", F.lit("soul:")), F.lit(False)))
    return out if realm is None else out.where(F.col("realm") == realm)


def suppress_lures(hits: DataFrame, k: int, order: list[Column]) -> DataFrame:
    """Drop the last two of the hits with a high lure risk, never the first; the hits are a bounded list."""
    w = Window.orderBy(*order)
    ranked = hits.withColumn("_rank", F.row_number().over(w))
    risky = F.when((F.col("lure_risk") >= LURE_RISK) & (F.col("_rank") > 1), F.lit(1))
    tail = F.count(risky).over(Window.orderBy(F.col("_rank").desc()))
    return ranked.withColumn("_tail", tail).where(risky.isNull() | (F.col("_tail") > LURE_MOST)).orderBy("_rank").limit(k).drop("_rank", "_tail")


def semantic(vectors: DataFrame, memory: DataFrame, query, k: int, ctx: Context, realm: str | None = None) -> DataFrame:
    """Three times k nearest, scored by all factors, lures suppressed, best k.

    The search itself is limited to what may be seen (live, of the realm if one is
    given), so deleted memories and other realms take no places; only the nearest
    then meet the wide state table. A column ``contexts`` gives the cross-context
    boost.
    """
    seen = visible(memory, realm)
    near = search(vectors, query, 3 * k, allowed=seen).select("memory_id", F.col("similarity").alias("relevance_score"))
    hits = decompose(seen.join(F.broadcast(near), "memory_id"), ctx)  # near: 3k rows
    if "contexts" in memory.columns:
        hits = hits.withColumn("score", F.col("score") * (1.0 + 0.05 * F.least(F.greatest(F.coalesce("contexts", F.lit(0)) - 1.0, F.lit(0.0)), F.lit(3.0))))
    return suppress_lures(hits, k, [F.col("score").desc(), F.col("memory_id")])


def keyword(memory: DataFrame, text: str, k: int, ctx: Context, realm: str | None = None) -> DataFrame:
    """BM25 over-fetch (three times, twelve with a realm), scored by all factors, best k."""
    found = bm25(memory, text, k * (12 if realm else 3)).withColumnRenamed("bm25", "relevance_score")
    lexical = Context(**{**ctx.__dict__, "mode": "keyword"})
    return decompose(visible(memory, realm).join(F.broadcast(found), "memory_id"), lexical).orderBy(F.col("score").desc(), "memory_id").limit(k)


def rrf(lanes: list[DataFrame], k: int, rrf_k: float = RRF_K, weights: list[float] | None = None) -> DataFrame:
    """(memory_id, score) fused by reciprocal rank; each lane is a bounded list of (memory_id, score)."""
    w = Window.orderBy(F.col("score").desc(), "memory_id")
    parts = []
    for i, lane in enumerate(lanes):
        weight = 1.0 if weights is None else weights[i]
        parts.append(lane.select("memory_id", "score").withColumn("_r", F.row_number().over(w)).select("memory_id", (F.lit(weight) / (rrf_k + F.col("_r"))).alias("part")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("memory_id").agg(F.sum("part").alias("score")).orderBy(F.col("score").desc(), "memory_id").limit(k)


def stratify(hits: DataFrame, k: int, reliability: DataFrame | None = None) -> DataFrame:
    """At most round((reliability - 0.5) / 0.5 * k), and one at least, of each realm, then the best k."""
    if reliability is None:
        hits = hits.withColumn("_rel", F.lit(0.925))
    else:
        hits = hits.join(F.broadcast(reliability.select("realm", F.col("reliability").alias("_rel"))), "realm", "left")
    cap = F.greatest(F.round((F.coalesce("_rel", F.lit(0.925)) - 0.5) / 0.5 * k), F.lit(1.0))
    place = F.row_number().over(Window.partitionBy("realm").orderBy(F.col("score").desc(), "memory_id"))
    return hits.withColumn("_place", place).where(F.col("_place") <= cap).drop("_place", "_rel").orderBy(F.col("score").desc(), "memory_id").limit(k)


def hybrid(vectors: DataFrame, memory: DataFrame, query, text: str, k: int, ctx: Context, realm: str | None = None, window: tuple[int, int] | None = None, reliability: DataFrame | None = None, edges: DataFrame | None = None, sparse: tuple[DataFrame, list[tuple[int, float]]] | None = None) -> DataFrame:
    """Both lanes fused, capped per realm when unscoped, gated by a time window and backfilled from it.

    ``edges`` fuses in the graph lane (E15); ``sparse``, codes and the query's code, re-ranks the fused list.
    """
    fetch = k * FETCH * (2 if window else 1)
    lanes = [semantic(vectors, memory, query, fetch, ctx), keyword(memory, text, fetch, ctx, realm)]
    info = memory.select("memory_id", "realm", "created_ms")
    if realm is not None:
        lanes[0] = lanes[0].where(F.col("realm") == realm)
    if window is not None:
        allowed = info.where(F.col("created_ms").between(*window)).select("memory_id")
        lanes = [lane.join(allowed, "memory_id", "left_semi") for lane in lanes]
    merged = rrf(lanes, fetch)
    if edges is not None:
        merged = with_graph_lane(merged, edges, visible(memory, realm), fetch)
    if sparse is not None:
        again = posting_search(sparse[0].join(F.broadcast(merged.select("memory_id")), "memory_id", "left_semi"), sparse[1], fetch, memory)  # merged: fetch rows
        merged = rrf([merged, again.select("memory_id", "score")], fetch)
    merged = merged.join(info, "memory_id")
    out = stratify(merged, k, reliability) if realm is None else merged.orderBy(F.col("score").desc(), "memory_id").limit(k)
    if window is None:
        return out.select("memory_id", "realm", "score")
    return backfill(out.select("memory_id", "realm", "score"), vectors, visible(memory, realm), query, k, window)


def with_graph_lane(merged: DataFrame, edges: DataFrame, allowed: DataFrame, k: int) -> DataFrame:
    """The graph's ranking from the first hits as seeds, fused with the hits; it may bring in memories no lane found.

    ``merged`` is a bounded list; fewer than two hits, or a lane of none, leave it as it is.
    """
    merged = materialize(merged, "fused")
    seeds = merged.orderBy(F.col("score").desc(), "memory_id").limit(PPR_SEEDS).collect()
    if len(seeds) < 2:
        return merged
    lane = ppr_lane(edges, [r["memory_id"] for r in seeds], [max(r["score"], 1e-6) for r in seeds])
    lane = lane.join(allowed.select("memory_id"), "memory_id", "left_semi").orderBy(F.col("score").desc(), "memory_id").limit(PPR_GIVES)
    return rrf([merged, lane], k + PPR_GIVES)


def backfill(hits: DataFrame, vectors: DataFrame, memory: DataFrame, query, k: int, window: tuple[int, int]) -> DataFrame:
    """E5: fill up to k with window members by cosine, after the hits there are."""
    pool = in_range(memory, *window, limit=max(4 * k, 64)).join(hits.select("memory_id"), "memory_id", "left_anti")
    near = pool.join(vectors.select("memory_id", "embedding"), "memory_id", "left").select("memory_id", "realm", F.coalesce(cosine(F.col("embedding"), literal(query)), F.lit(0.0)).alias("score"))
    both = hits.withColumn("_lane", F.lit(0)).unionByName(near.withColumn("_lane", F.lit(1)))
    return both.orderBy("_lane", F.col("score").desc(), "memory_id").limit(k).drop("_lane")


def sessions(hits: DataFrame, k: int) -> DataFrame:
    """Per session the best hit, plus 0.15 of the noisy-or of the next four in what is left to 1.

    ``hits``: (memory_id, score, source_session), a bounded candidate list.
    """
    s = F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0))
    rank = F.row_number().over(Window.partitionBy("source_session").orderBy(F.col("score").desc(), "memory_id"))
    ranked = hits.where(F.col("source_session").isNotNull()).withColumn("_s", s).withColumn("_rank", rank)
    per = ranked.groupBy("source_session").agg(
        F.max("_s").alias("best"), F.count(F.lit(1)).alias("chunks"), F.product(F.when(F.col("_rank").between(2, 5), 1.0 - F.col("_s")).otherwise(1.0)).alias("_miss"), F.max("score").alias("max_score")
    )
    score = F.col("best") + 0.15 * (1.0 - F.col("_miss")) * (1.0 - F.col("best"))
    return per.select("source_session", score.alias("score"), "chunks", "max_score").orderBy(F.col("score").desc(), "source_session").limit(k)


def hopfield(candidates: DataFrame, query, k: int, beta: float = 6.0, steps: int = 2) -> list[tuple[int, float]]:
    """Relax the query over a bounded candidate list (k times the fetch factor) and rank by the result."""
    rows = candidates.select("memory_id", "embedding").orderBy("memory_id").collect()  # k * FETCH rows at most
    if not rows:
        return []
    ids = [r["memory_id"] for r in rows]
    x = np.array([r["embedding"] for r in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = np.asarray(query, dtype=np.float64) / np.linalg.norm(query)
    for _ in range(steps):
        e = beta * (x @ s)
        w = np.exp(e - e.max())
        new = (w / w.sum()) @ x
        length = np.linalg.norm(new)
        if length < 1e-12:
            break
        moved, s = np.linalg.norm(new / length - s), new / length
        if moved < 1e-6:
            break
    score = x @ s
    return [(ids[i], float(score[i])) for i in np.lexsort((ids, -score))[:k]]


def bridge(refs: DataFrame, anchor: int, n_total: int, k: int, tau: int = 32, saturating: bool = False) -> DataFrame:
    """Memories that share rare atoms with the anchor, by the summed rarity of what they share."""
    own = refs.where(F.col("memory_id") == anchor).select("text").distinct()
    df = refs.join(own, "text", "left_semi").groupBy("text").agg(F.count_distinct("memory_id").alias("df"))
    weight = F.log((F.lit(float(n_total)) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0) if saturating else F.log(F.lit(float(n_total)) / F.col("df"))
    rare = df if saturating else df.where(F.col("df") <= tau)
    shared = refs.where(F.col("memory_id") != anchor).join(rare.select("text", weight.alias("w")), "text").dropDuplicates(["memory_id", "text"])
    return shared.groupBy("memory_id").agg(F.sum("w").alias("score")).orderBy(F.col("score").desc(), "memory_id").limit(k)


def artifact(refs: DataFrame, memory: DataFrame, path: str, now_ms: int, k: int) -> DataFrame:
    """Memories that name a path, by effective strength."""
    hit = refs.where(F.col("text") == path).select("memory_id").distinct()
    return memory.join(hit, "memory_id", "left_semi").withColumn("score", effective_strength(now_ms) * F.col("confidence")).orderBy(F.col("score").desc(), "memory_id").limit(k)


def utility_multiplier(weight: float, mean: Column | None = None) -> Column:
    """1 when off; else a blend with the posterior mean (the mean stands for the draw)."""
    return F.lit(1.0) if weight <= 0 or mean is None else (1.0 - weight) + weight * mean


def harness_conflicts(vectors: DataFrame, memory: DataFrame, queries: DataFrame, limit: int, least: float = 0.0) -> DataFrame:
    """Pairs of neighbours that stem from different harnesses, by 1 - cosine; every pair once."""
    near = block_search(vectors, queries, 20)
    who = memory.select("memory_id", "harness")
    pairs = near.join(who.toDF("src", "h1"), "src").join(who.toDF("dst", "h2"), "dst").where("h1 <> h2")
    pairs = pairs.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), (1.0 - F.col("similarity")).alias("score")).where(F.col("score") >= least)
    return pairs.groupBy("a", "b").agg(F.min("score").alias("score")).orderBy("score", "a", "b").limit(limit)


def near_duplicate_losers(vectors: DataFrame, low: float = 0.88, high: float = 0.9999) -> DataFrame:
    """Of two vectors of a realm in the duplicate band the later is superseded by the earliest; one row per loser.

    Every vector of a realm meets every other: realms are cut into blocks by id
    hash, every two blocks meet in one product, and only the fold per loser leaves it.
    """
    rows = vectors.where(F.col("realm").isNotNull() & F.col("embedding").isNotNull()).select("memory_id", "realm", "embedding")
    blocks = rows.groupBy("realm").agg(F.ceil(F.count(F.lit(1)) / BAND_BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("memory_id"), F.col("blocks")).cast("int")
    cut = rows.join(blocks, "realm").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cut = cut.select("memory_id", "realm", "embedding", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))

    def meet(table: pa.Table) -> pa.Table:
        ids, mine = table.column("memory_id").to_numpy(), table.column("own").to_numpy()
        x = np.array(table.column("embedding").to_pylist(), dtype=np.float64)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        left, right = np.nonzero(mine == lo)[0], np.nonzero(mine == hi)[0]
        s = x[left] @ x[right].T
        i, j = np.nonzero((s >= low) & (s < high) & (ids[left][:, None] != ids[right][None]))
        a, b, s = ids[left[i]], ids[right[j]], s[i, j]
        loser, at = np.unique(np.maximum(a, b), return_inverse=True)
        keep, best = np.full(len(loser), np.iinfo(np.int64).max), np.full(len(loser), -np.inf)
        np.minimum.at(keep, at, np.minimum(a, b))
        np.maximum.at(best, at, s)
        return pa.table({"loser": loser, "keep": keep, "similarity": best})

    found = cut.groupBy("realm", "lo", "hi").applyInArrow(meet, "loser long, keep long, similarity double")
    return found.groupBy("loser").agg(F.min("keep").alias("keep"), F.max("similarity").alias("similarity"))


def crowding(vectors: DataFrame, memory: DataFrame, queries: DataFrame, high: float = 0.9999) -> DataFrame:
    """Mean cosine to the eight nearest below the duplicate bound, and the lure risk: that times the share of the same kind."""
    near = block_search(vectors, queries, 8, high=high)
    kind = memory.select("memory_id", "kind")
    with_kind = near.join(kind.toDF("src", "k1"), "src", "left").join(kind.toDF("dst", "k2"), "dst", "left")
    same = F.avg(F.when(F.col("k1") == F.col("k2"), 1.0).otherwise(0.0))
    return with_kind.groupBy("src").agg(F.avg("similarity").alias("competitive_weight"), (F.avg("similarity") * same).alias("lure_risk"))
