"""Queries of vector retrieval, recall and scoring, with SQL twins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions import scoring as S
from recollect.functions.vector import hamming
from recollect.operators import hypervectors as H
from recollect.operators import lexical as L
from recollect.operators import memory as M
from recollect.operators import recall as R
from recollect.operators import sparse_codes as P
from recollect.operators import vectors as V
from recollect.plans.memory_queries import QUERY, _TERMS
from recollect.sources.logical import DAY, NOW, T0, duck, view
from recollect.storage import materialize

DIM = 64
CTX = S.Context(NOW, valence=-0.6, arousal=0.7)
R6 = lambda c: F.round(c, 6).alias(c)


def _mem(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "memory")


def _vec(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "vectors")


def _query(s: SparkSession, d: str):
    return [float(x) for x in _vec(s, d).where("memory_id = 0").first()["embedding"]]


def d_search(s, d):
    return V.search(_vec(s, d), _query(s, d), 20).select("memory_id", R6("similarity"))


def d_search_realm(s, d):
    return V.search(_vec(s, d), _query(s, d), 20, realm="r3").select("memory_id", R6("similarity"))


def d_candidates(s, d):
    return V.search(_vec(s, d), _query(s, d), 10, allowed=_mem(s, d).where("kind = 'wisdom'")).select("memory_id", R6("similarity"))


def d_graph_search(s, d):
    return V.graph_search(_vec(s, d), _query(s, d), 10, ef=512).select("memory_id", F.round("similarity", 4).alias("similarity"))


def d_two_tier(s, d):
    """A base, a delta of a twentieth, and deleted memories in both."""
    v = _vec(s, d)
    return V.two_tier_search(v.where("memory_id % 20 <> 3"), v.where("memory_id % 20 = 3"), v.where("memory_id % 7 = 1"), _query(s, d), 10, ef=512).select("memory_id", F.round("similarity", 4).alias("similarity"))


def d_boosted(s, d):
    rows = _vec(s, d).withColumn("signature", F.slice("embedding", 1, 32))
    return V.boosted(rows, _query(s, d), _query(s, d)[32:], 20, 0.2).select("memory_id", R6("similarity"))


def d_centred(s, d):
    return V.centred_search(_vec(s, d), _query(s, d), 20).select("memory_id", R6("similarity"))


def d_centroid(s, d):
    return V.centroid(_vec(s, d), "realm").select("realm", F.posexplode("mean").alias("pos", "x")).select("realm", F.col("pos").cast("long").alias("pos"), R6("x"))


def d_codes(s, d):
    return V.codes(_vec(s, d), DIM).select("memory_id", F.get("code", F.lit(0)).alias("code"))


def d_hamming(s, d):
    c = V.codes(_vec(s, d), DIM)
    q = F.broadcast(c.where("memory_id = 0").select(F.col("code").alias("q")))
    return c.join(q, F.size("code") == F.size("q")).select("memory_id", hamming(F.col("code"), F.col("q")).cast("long").alias("distance"))


def d_hamming_prefilter(s, d):
    return V.hamming_search(_vec(s, d), _query(s, d), DIM, 20, 100).select("memory_id", R6("similarity"))


def d_lsh_signatures(s, d):
    return V.signatures(_vec(s, d), DIM, bits=8, tables=2).select("memory_id", F.col("table").cast("long").alias("table"), F.col("signature").cast("long").alias("signature"))


def d_lsh_candidates(s, d):
    return V.bucket_candidates(V.signatures(_vec(s, d), DIM, bits=8, tables=2), 0)


def d_probes(s, d):
    centres = V.centroid(_vec(s, d).withColumn("centre", F.substring("realm", 2, 9).cast("int")), "centre")
    return V.probes(_vec(s, d), centres, 3).select("memory_id", F.col("rank").cast("long").alias("rank"), F.col("centre").cast("long").alias("centre"), R6("similarity"))


def d_hv_recall(s, d):
    codes = H.encoded(view(s, d, "note"), "memory_id", "content")
    return H.nearest(codes, H.encode("the jury and the verdict"), 20).select("memory_id", "distance", R6("similarity"))


def d_hv_and(s, d):
    codes = H.encoded(view(s, d, "note"), "memory_id", "content")
    return H.nearest(codes, H.query_and(["jury", "verdict"]), 20).select("memory_id", "distance")


def d_hv_realm_similarity(s, d):
    note = view(s, d, "note")
    codes = H.encoded(note, "memory_id", "content").join(note.select("memory_id", "realm"), "memory_id")
    b = H.group_bundles(codes, "realm")
    names = sorted(b)
    rows = [(x, y, round(1.0 - int(H.bits(H.bind(b[x], b[y])).sum()) / H.BITS, 6)) for i, x in enumerate(names) for y in names[i + 1 :]]
    return s.createDataFrame(rows, "a string, b string, similarity double")


def d_hv_realm_theme(s, d):
    note = view(s, d, "note").where("realm = 'shared'")
    codes = H.encoded(note, "memory_id", "content").withColumn("realm", F.lit("shared"))
    b = H.group_bundles(codes, "realm")
    return H.nearest(codes, b.get("shared", bytes(H.BITS // 8)), 10).select("memory_id", "distance")


def d_hv_unbind(s, d):
    return H.unbind(view(s, d, "tape"), "error", "entity", 5)


def d_sparse_codes(s, d):
    return P.encoded(_vec(s, d), DIM).select("memory_id", F.size("features").alias("n"), R6("error"))


def _sparse_query(s, d):
    r = P.encoded(_vec(s, d).where("memory_id = 0"), DIM).first()
    return r["features"], r["activations"]


def d_sparse_search(s, d):
    f, a = _sparse_query(s, d)
    return P.posting_search(P.encoded(_vec(s, d), DIM), list(zip(f, a, strict=True)), 20, _mem(s, d)).select("memory_id", R6("score"))


def _prototypes(s, d):
    return materialize(P.resonance(P.encoded(_vec(s, d), DIM), vigilance=0.008), "prototypes")


def d_attractor_search(s, d):
    p = P.restored(_prototypes(s, d), vigilance=0.008)
    f, a = _sparse_query(s, d)
    code = np.zeros(P.ATOMS * P.ATOMS)
    code[f] = a
    done = p.settle(code, 3)
    best = np.argsort(-done, kind="stable")[: P.ACTIVE]
    return P.posting_search(P.encoded(_vec(s, d), DIM), [(int(i), float(done[i])) for i in best if done[i] > 0], 20, _mem(s, d)).select("memory_id", R6("score"))


def d_prototypes(s, d):
    return _prototypes(s, d).where("memory_id IS NOT NULL").select("memory_id", "prototype")


def d_prototype_transitions(s, d):
    return P.ranked_transitions(d_prototypes(s, d), 3)


def d_trained_dictionary(s, d):
    x = np.array([r["embedding"] for r in _vec(s, d).orderBy(F.xxhash64("memory_id"), "memory_id").limit(200).collect()], dtype=np.float64)
    left, right = P.dictionary(DIM)
    before = P.rebuilding_error(_vec(s, d), left, right).select(F.col("error").alias("before"))
    return before.crossJoin(P.rebuilding_error(_vec(s, d), *P.train(x, left, right)).select(F.col("error").alias("after")))  # one row each


def d_quantised(s, d):
    sample = np.array([r["embedding"] for r in _vec(s, d).orderBy(F.xxhash64("memory_id"), "memory_id").limit(400).collect()], dtype=np.float64)
    return V.pq_encode(_vec(s, d), V.pq_train(sample, 8, 16)).select("memory_id", F.array_join(F.transform("code", lambda c: c.cast("string")), ",").alias("code"), R6("error"))


def f_factors(s, d):
    rows = _mem(s, d).withColumn("relevance_score", F.col("confidence"))
    out = S.decompose(rows, CTX)
    names = ["f_actr", "f_strength", "f_surprise", "f_arousal", "f_mood", "f_frustration", "f_status", "f_epistemic", "f_kind", "f_interference", "f_spacing", "f_realm_reliability", "f_staged", "relevance", "secondary", "score"]
    return out.select("memory_id", *[R6(n) for n in names])


def f_optional_factors(s, d):
    rows = _mem(s, d).withColumns(
        {
            "relevance_score": F.col("confidence"),
            "prediction_prob": F.col("surprise"),
            "surprise_role": F.when(F.col("memory_id") % 3 == 0, "actual").when(F.col("memory_id") % 3 == 1, "expected"),
            "surprise_magnitude": F.col("arousal"),
            "has_open_debt": F.col("memory_id") % 2 == 0,
            "ack": F.col("memory_id") % 9 - 4,
            "source_weight": F.col("competitive_weight") * 2,
        }
    )
    out = S.decompose(rows, S.Context(NOW, max_query_idf=4.0, replication_max=1.15))
    return out.select("memory_id", *[R6(f"f_{n}") for n in ("prediction", "surprise_domain", "epistemic_debt", "ack", "integration", "rare_entity", "replication")])


def _accesses(s, d):
    return view(s, d, "tape").groupBy(F.col("session_id").alias("memory_id")).agg(F.slice(F.reverse(F.array_sort(F.collect_list("ts_ms"))), 1, 16).alias("t"), F.count(F.lit(1)).alias("access_count"), F.min("ts_ms").alias("created_ms")).withColumn("access_ts", F.reverse("t"))


def f_activation(s, d):
    return _accesses(s, d).select("memory_id", F.round(S.activation(NOW), 6).alias("activation"), F.round(S.spacing_quality(), 6).alias("spacing"))


def f_learned_weight(s, d):
    return _mem(s, d).select("memory_id", F.round(S.learned_weight(F.col("strength"), F.col("valence"), 0.1, 0.9), 6).alias("weight"))


def f_state_fold(s, d):
    from recollect.operators.fold import fold_deltas

    return fold_deltas(view(s, d, "delta")).select("memory_id", R6("strength"), "applied")


def f_outcome_posterior(s, d):
    t = view(s, d, "tape")
    w = S.capped_weight(F.col("value") / 20.0)
    p = t.groupBy("session_id").agg(F.sum(F.when(F.col("outcome") == 0, w).otherwise(0.0)).alias("a"), F.sum(F.when(F.col("outcome") == 1, w).otherwise(0.0)).alias("b"))
    return p.select("session_id", F.round(S.utility(F.col("a"), F.col("b")), 6).alias("utility"))


def e_semantic(s, d):
    return R.semantic(_vec(s, d), _mem(s, d), _query(s, d), 15, CTX).select("memory_id", R6("score"))


def e_semantic_realm(s, d):
    """All memories of a realm compete, however far from the query."""
    return R.semantic(_vec(s, d), _mem(s, d), _query(s, d), 40, CTX, realm="project:ember").select("memory_id", R6("score"))


def e_semantic_deleted(s, d):
    """Nine of ten memories deleted (blank): the rest is found all the same."""
    m = _mem(s, d).withColumn("content", F.when(F.col("memory_id") % 10 == 0, F.col("content")).otherwise(F.lit("")))
    return R.semantic(_vec(s, d), m, _query(s, d), 15, CTX).select("memory_id", R6("score"))


def e_keyword(s, d):
    return R.keyword(_mem(s, d), QUERY, 15, CTX).select("memory_id", R6("score"))


def e_rrf(s, d):
    a = V.search(_vec(s, d), _query(s, d), 30).select("memory_id", F.col("similarity").alias("score"))
    b = L.bm25(_mem(s, d), QUERY, 30).select("memory_id", F.col("bm25").alias("score"))
    return R.rrf([a, b], 20).select("memory_id", F.round("score", 8).alias("score"))


def e_hybrid(s, d):
    return R.hybrid(_vec(s, d), _mem(s, d), _query(s, d), QUERY, 10, S.Context(NOW)).select("memory_id", "realm", F.round("score", 8).alias("score"))


def e_hybrid_ppr(s, d):
    """With the association graph's ranking fused in, and the candidates re-ranked by sparse codes."""
    f, a = _sparse_query(s, d)
    sparse = P.encoded(_vec(s, d), DIM), list(zip(f, a, strict=True))
    return R.hybrid(_vec(s, d), _mem(s, d), _query(s, d), QUERY, 10, S.Context(NOW), edges=view(s, d, "edge"), sparse=sparse).select("memory_id", "realm", F.round("score", 8).alias("score"))


def e_hybrid_window(s, d):
    return R.hybrid(_vec(s, d), _mem(s, d), _query(s, d), QUERY, 10, S.Context(NOW), window=(T0, T0 + 60 * DAY)).select("memory_id", "realm", F.round("score", 6).alias("score"))


def e_stratified(s, d):
    rel = view(s, d, "memory").where("realm is not null").groupBy("realm").agg((0.5 + 0.5 * F.avg("confidence")).alias("reliability"))
    hits = _mem(s, d).where("realm is not null").select("memory_id", "realm", F.col("strength").alias("score"))
    return R.stratify(hits, 20, rel).select("memory_id", "realm", "score")


def e_sessions(s, d):
    hits = _mem(s, d).select("memory_id", F.col("strength").alias("score"), F.concat(F.lit("s"), (F.col("memory_id") % 50).cast("string")).alias("source_session"))
    return R.sessions(hits, 20).select("source_session", R6("score"), "chunks")


def e_hopfield(s, d):
    near = V.search(_vec(s, d), _query(s, d), 40)
    return s.createDataFrame(R.hopfield(near, _query(s, d), 10), "memory_id long, score double").select("memory_id", R6("score"))


def _anchor(refs):
    return refs.groupBy("memory_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "memory_id").first()[0]


def e_bridge(s, d):
    refs = L.span_refs(view(s, d, "note"))
    return R.bridge(refs, _anchor(refs), 1000, 10).select("memory_id", R6("score"))


def e_bridge_saturating(s, d):
    refs = L.span_refs(view(s, d, "note"))
    return R.bridge(refs, _anchor(refs), 1000, 10, saturating=True).select("memory_id", R6("score"))


def e_artifact(s, d):
    refs = L.span_refs(view(s, d, "note"))
    path = refs.groupBy("text").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "text").first()[0]
    note = view(s, d, "note").select("memory_id").withColumns({"strength": (F.col("memory_id") * 37 % 101) / 100.0, "confidence": F.lit(1.0), "decay_rate": F.lit(0.0), "last_strengthened_ms": F.lit(T0)})
    return R.artifact(refs, note, path, NOW, 10).select("memory_id", R6("score"))


def e_lures(s, d):
    hits = _mem(s, d).select("memory_id", F.col("strength").alias("score"), "lure_risk").orderBy(F.col("score").desc(), "memory_id").limit(30)
    return R.suppress_lures(hits, 30, [F.col("score").desc(), F.col("memory_id")]).select("memory_id", "score")


def _stated(s, d):
    return _vec(s, d).where("memory_id % 100 = 0")


def e_knn_edges(s, d):
    return V.block_search(_vec(s, d), _stated(s, d), 5, low=0.0).select("src", "dst", R6("similarity"), F.col("rank").cast("long").alias("rank"))


def e_harness_conflicts(s, d):
    return R.harness_conflicts(_vec(s, d), _mem(s, d), _vec(s, d), 50).select("a", "b", R6("score"))


def e_near_duplicates(s, d):
    return R.near_duplicate_losers(_vec(s, d), 0.05, 0.9999).select("loser", "keep", R6("similarity"))


def e_crowding(s, d):
    return R.crowding(_vec(s, d), _mem(s, d), _stated(s, d)).select("src", R6("competitive_weight"), R6("lure_risk"))


def e_utility_multiplier(s, d):
    return _mem(s, d).select("memory_id", F.round(R.utility_multiplier(0.3, F.col("confidence")), 6).alias("multiplier"))


QUERIES = {n: f for n, f in list(globals().items()) if n[:2] in ("d_", "e_", "f_") and callable(f)}

_V = duck("vectors")
_COS = "list_dot_product(v.embedding::DOUBLE[], q.e) / (sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])) * sqrt(list_dot_product(q.e, q.e)))"
_Q = ", q AS (SELECT embedding::DOUBLE[] AS e FROM vectors WHERE memory_id = 0)\n"
_SIM = _Q + f", sim AS (SELECT v.memory_id, v.realm, v.embedding, {_COS} AS similarity FROM vectors v, q)\n"
_TOP = "SELECT memory_id, round(similarity, 6) AS similarity FROM {t} ORDER BY {t}.similarity DESC, memory_id LIMIT {k}"
_UNIT = ", u AS (SELECT memory_id, realm, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS u FROM vectors), flat AS (SELECT memory_id, realm, unnest(u) AS x, generate_subscripts(u, 1) - 1 AS pos FROM u)\n"
_EFF = "least(greatest(strength * exp(-decay_rate * greatest(1735689600000 - last_strengthened_ms, 0) / 86400000e0), 0e0), 1e0)"
_LIFE = "pow(greatest(1735689600000 - created_ms, 60000) / 86400000e0, -0.5)"


def _factors(q_valence: float | None, q_arousal: float | None, relevance: str) -> str:
    """All default factors as SQL columns over ``memory``."""
    mood = "1.0" if q_valence is None else f"1.0 + 0.2 * greatest(1.0 - abs({q_valence} - valence), 0e0) * greatest({q_arousal}, arousal)"
    frust = "1.0" if q_valence is None else f"CASE kind WHEN 'correction' THEN 1.0 + 1.5 * {(min(-q_valence - 0.3, 0.7)) * min(q_arousal - 0.4, 0.6)!r} WHEN 'preference' THEN 1.0 + {(min(-q_valence - 0.3, 0.7)) * min(q_arousal - 0.4, 0.6)!r} ELSE 1.0 END"
    cols = {
        "f_actr": f"0.3 + 0.7 / (1.0 + exp(-(ln(CASE WHEN access_count > 0 THEN access_count * {_LIFE} / 0.5 ELSE {_LIFE} END) + 1.0) / 1.5))",
        "f_strength": f"0.5 + 0.5 * {_EFF}",
        "f_surprise": "1.0 + 0.25 * surprise",
        "f_arousal": "1.0 + 0.15 * arousal",
        "f_mood": mood,
        "f_frustration": frust,
        "f_status": "CASE status WHEN 'Verified' THEN 1.15 WHEN 'Active' THEN 1.0 WHEN 'Observed' THEN 0.85 WHEN 'Proposed' THEN 0.65 END",
        "f_epistemic": "CASE epistemic WHEN 0 THEN 1.0 WHEN 1 THEN 0.95 WHEN 2 THEN 0.85 WHEN 3 THEN 0.75 END",
        "f_kind": "CASE kind WHEN 'correction' THEN 1.3 WHEN 'wisdom' THEN 1.1 WHEN 'insight' THEN 1.05 WHEN 'episode' THEN 0.7 WHEN 'operational' THEN 0.8 ELSE 1.0 END",
        "f_interference": "pow(1.0 - competitive_weight, 0.3)",
        "f_spacing": "CASE WHEN access_count < 2 THEN 1.0 ELSE 0.85 + 0.15 * spacing_quality END",
        "f_realm_reliability": "0.925e0",
        "f_staged": "CASE WHEN staged THEN 0.8 ELSE 1.0 END",
    }
    inner = ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in cols.items())
    product = " * ".join(cols) + " * confidence"
    return f"(SELECT *, {product} AS secondary, relevance * (0.7 + 0.3 * {product}) AS score FROM (SELECT *, {inner}, {relevance} AS relevance FROM {{src}}) WHERE f_status IS NOT NULL)"


_SIGMOID = "1.0 / (1.0 + exp(-(3.27 * relevance_score - 0.85)))"
_SEM = lambda k, ctx, cond="true": (
    _SIM
    + f", seen AS (SELECT * FROM memory WHERE length(trim(content)) > 0 AND NOT coalesce(starts_with(realm, 'soul:'), false) AND {cond}), near AS (SELECT memory_id, similarity AS relevance_score FROM sim WHERE memory_id IN (SELECT memory_id FROM seen) ORDER BY similarity DESC, memory_id LIMIT {3 * k}), src AS (SELECT m.*, relevance_score FROM seen m JOIN near USING (memory_id)), scored AS "
    + _factors(*ctx, _SIGMOID).format(src="src")
    + ", ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, memory_id) AS rk FROM scored), tail AS (SELECT *, count(CASE WHEN lure_risk >= 0.7 AND rk > 1 THEN 1 END) OVER (ORDER BY rk DESC) AS tl FROM ranked)"
    + f", sem AS (SELECT * FROM tail WHERE NOT (lure_risk >= 0.7 AND rk > 1) OR tl > 2 ORDER BY rk LIMIT {k})\n"
)
_BM = ", bm AS (SELECT memory_id, sum(idf * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * p.n / avg_length))) AS bm25 FROM posts p JOIN sel USING (term), nn GROUP BY 1)\n"
_KW = lambda k, ctx: (
    _BM
    + f", bk AS (SELECT memory_id, bm25 AS relevance_score FROM bm ORDER BY bm25 DESC, memory_id LIMIT {3 * k}), ksrc AS (SELECT m.*, relevance_score FROM memory m JOIN bk USING (memory_id) WHERE length(trim(content)) > 0 AND NOT coalesce(starts_with(realm, 'soul:'), false)), kscored AS "
    + _factors(*ctx, "relevance_score").format(src="ksrc")
    + f", kw AS (SELECT * FROM kscored ORDER BY score DESC, memory_id LIMIT {k})\n"
)
_VIEWV = ", " + duck("vectors")[5:]
_HYB = lambda fetch, gate="": (
    _TERMS
    + _VIEWV
    + _SEM(fetch, (None, None))
    + _KW(fetch, (None, None))
    + f", l1 AS (SELECT memory_id, row_number() OVER (ORDER BY score DESC, memory_id) AS r FROM sem {gate}), l2 AS (SELECT memory_id, row_number() OVER (ORDER BY score DESC, memory_id) AS r FROM kw {gate}), fused AS (SELECT memory_id, sum(1.0::DOUBLE / (60.0 + r)) AS score FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2) GROUP BY 1 ORDER BY score DESC, memory_id LIMIT {fetch}), hit AS (SELECT f.memory_id, m.realm, f.score FROM fused f JOIN memory m USING (memory_id) QUALIFY row_number() OVER (PARTITION BY m.realm ORDER BY f.score DESC, f.memory_id) <= 9 ORDER BY f.score DESC, f.memory_id LIMIT 10)\n"
)
_PL = V.planes(DIM, 8, 2)
_sig = lambda t: " + ".join(f"CASE WHEN list_dot_product(embedding::DOUBLE[], {_PL[t, b].tolist()}::DOUBLE[]) >= 0 THEN {1 << b} ELSE 0 END" for b in range(8))
_SIGS = _V + f", sg AS (SELECT memory_id, 0 AS \"table\", {_sig(0)} AS signature FROM vectors UNION ALL SELECT memory_id, 1, {_sig(1)} FROM vectors)\n"
_ST = _V + f", pr AS (SELECT a.memory_id AS src, b.memory_id AS dst, {_COS.replace('v.embedding', 'b.embedding').replace('q.e', 'a.embedding::DOUBLE[]')} AS similarity FROM vectors a JOIN vectors b ON a.realm = b.realm AND a.memory_id <> b.memory_id WHERE a.memory_id % 100 = 0)\n"
_KNN = lambda k, cond="true": f", knn AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY similarity DESC, dst) AS rank FROM pr WHERE {cond} QUALIFY row_number() OVER (PARTITION BY src ORDER BY similarity DESC, dst) <= {k})\n"
_MEMC = ", " + duck("memory")[5:]
_CODE = "list_reduce(list_transform(range(1, 65), lambda i: CASE WHEN embedding[i] >= 0 THEN CAST(1 AS UBIGINT) << (i - 1)::UBIGINT ELSE CAST(0 AS UBIGINT) END), lambda a, b: a | b)"
_REFS = duck("note") + ", refs AS (SELECT memory_id, unnest(list_distinct(regexp_extract_all(content, '" + L.PATHS.replace("'", "''") + "', 1))) AS text FROM note), anc AS (SELECT memory_id AS anchor FROM refs GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), own AS (SELECT DISTINCT text FROM refs, anc WHERE memory_id = anchor), df AS (SELECT text, count(DISTINCT memory_id) AS df FROM refs WHERE text IN (SELECT text FROM own) GROUP BY 1)\n"
_MEMSQL = duck("memory")
SQL = {
    "d_search": _V + _SIM + _TOP.format(t="sim", k=20),
    "d_search_realm": _V + _SIM + ", x AS (SELECT * FROM sim WHERE realm = 'r3') " + _TOP.format(t="x", k=20),
    "d_candidates": duck("vectors", "memory") + _SIM + ", x AS (SELECT * FROM sim WHERE memory_id IN (SELECT memory_id FROM memory WHERE kind = 'wisdom')) " + _TOP.format(t="x", k=10),
    "d_graph_search": _V + _SIM + "SELECT memory_id, round(similarity, 4) AS similarity FROM sim ORDER BY sim.similarity DESC, memory_id LIMIT 10",
    "d_two_tier": _V + _SIM + "SELECT memory_id, round(similarity, 4) AS similarity FROM sim WHERE memory_id % 7 <> 1 ORDER BY sim.similarity DESC, memory_id LIMIT 10",
    "d_boosted": _V + _SIM + ", x AS (SELECT sim.memory_id, similarity + 0.2 * greatest(list_dot_product(list_slice(embedding::DOUBLE[], 1, 32), list_slice(q.e, 33, 64)), 0e0) AS similarity FROM sim, q) " + _TOP.format(t="x", k=20),
    "d_centroid": _V + _UNIT + "SELECT realm, pos, round(avg(x), 6) AS x FROM flat GROUP BY 1, 2",
    "d_centred": _V
    + _UNIT
    + ", mu AS (SELECT list(m ORDER BY pos) AS mu FROM (SELECT pos, avg(x) AS m FROM flat GROUP BY 1)), c AS (SELECT memory_id, list_transform(range(1, 65), lambda i: u[i] - mu[i]) AS c FROM u, mu), cq AS (SELECT c AS e FROM c WHERE memory_id = 0), x AS (SELECT memory_id, list_dot_product(c, e) / (sqrt(list_dot_product(c, c)) * sqrt(list_dot_product(e, e))) AS similarity FROM c, cq) "
    + _TOP.format(t="x", k=20),
    "d_codes": _V + f", c AS (SELECT memory_id, CAST({_CODE} AS HUGEINT) AS code FROM vectors) SELECT memory_id, CAST(CASE WHEN code >= 9223372036854775808 THEN code - 18446744073709551616 ELSE code END AS BIGINT) AS code FROM c",
    "d_hamming": _V + f", c AS (SELECT memory_id, {_CODE} AS code FROM vectors) SELECT a.memory_id, CAST(bit_count(xor(a.code, b.code)) AS BIGINT) AS distance FROM c a, c b WHERE b.memory_id = 0",
    "d_hamming_prefilter": _V
    + _SIM
    + f", c AS (SELECT memory_id, {_CODE} AS code FROM vectors), x AS (SELECT s.* FROM sim s JOIN (SELECT a.memory_id FROM c a, c b WHERE b.memory_id = 0 ORDER BY bit_count(xor(a.code, b.code)), a.memory_id LIMIT 100) USING (memory_id)) "
    + _TOP.format(t="x", k=20),
    "d_lsh_signatures": _SIGS + "SELECT memory_id, CAST(\"table\" AS BIGINT) AS \"table\", CAST(signature AS BIGINT) AS signature FROM sg",
    "d_lsh_candidates": _SIGS + "SELECT DISTINCT a.memory_id FROM sg a JOIN sg b ON a.\"table\" = b.\"table\" AND a.signature = b.signature AND b.memory_id = 0 WHERE a.memory_id <> 0",
    "d_probes": _V
    + _UNIT
    + ", ct AS (SELECT CAST(substr(realm, 2) AS BIGINT) AS centre, list(m ORDER BY pos) AS mu FROM (SELECT realm, pos, avg(x) AS m FROM flat GROUP BY 1, 2) GROUP BY 1), x AS (SELECT memory_id, centre, list_dot_product(u, mu) / sqrt(list_dot_product(mu, mu)) AS similarity FROM u, ct) SELECT memory_id, row_number() OVER w AS rank, centre, round(similarity, 6) AS similarity FROM x WINDOW w AS (PARTITION BY memory_id ORDER BY similarity DESC, centre) QUALIFY row_number() OVER w <= 3",
    "f_factors": _MEMSQL + ", src AS (SELECT *, confidence AS relevance_score FROM memory), scored AS " + _factors(-0.6, 0.7, _SIGMOID).format(src="src") + "SELECT memory_id, " + ", ".join(f"round({n}, 6) AS {n}" for n in ["f_actr", "f_strength", "f_surprise", "f_arousal", "f_mood", "f_frustration", "f_status", "f_epistemic", "f_kind", "f_interference", "f_spacing", "f_realm_reliability", "f_staged", "relevance", "secondary", "score"]) + " FROM scored",
    "f_optional_factors": _MEMSQL
    + "SELECT memory_id, round(CASE WHEN surprise > 0 THEN 1.0 + 0.3 * surprise ELSE 1.0 END, 6) AS f_prediction, round(CASE memory_id % 3 WHEN 0 THEN 1.0 + 0.15 * arousal WHEN 1 THEN greatest(1.0 - 0.1 * arousal, 0.1) ELSE 1.0 END, 6) AS f_surprise_domain, CAST(CASE WHEN memory_id % 2 = 0 THEN 1.1 ELSE 1.0 END AS DOUBLE) AS f_epistemic_debt, CAST(CASE WHEN memory_id % 9 - 4 >= 3 THEN 1.2 WHEN memory_id % 9 - 4 >= 1 THEN 1.1 WHEN memory_id % 9 - 4 <= -3 THEN 0.8 WHEN memory_id % 9 - 4 <= -1 THEN 0.9 ELSE 1.0 END AS DOUBLE) AS f_ack, round(competitive_weight * 2, 6) AS f_integration, 1.06e0 AS f_rare_entity, round(1.0::DOUBLE + (1.15e0 - 1.0) * (least(greatest(replication_count, 1), 3) - 1) * (5 - (least(greatest(replication_count, 1), 3) - 1)) / 6.0, 6) AS f_replication FROM memory WHERE status <> 'Archived'",
    "f_activation": duck("tape")
    + ", g AS (SELECT session_id AS memory_id, list_reverse(list_slice(list_reverse_sort(list(ts_ms)), 1, 16)) AS t, count(*) AS n, min(ts_ms) AS c FROM tape GROUP BY 1), s AS (SELECT *, list_sum(list_transform(t, lambda x: pow(greatest(1735689600000 - x, 60000) / 86400000e0, -0.5))) + greatest(n - len(t), 0) * pow(greatest(1735689600000 - c, 60000) / 86400000e0, -0.5) / 0.5 AS total, list_transform(range(2, len(t) + 1), lambda i: greatest(t[i] - t[i - 1], 1)::DOUBLE) AS gaps FROM g) SELECT memory_id, round(1.0 / (1.0 + exp(-(ln(total) + 1.0) / 1.5)), 6) AS activation, round(CASE WHEN len(t) >= 3 THEN 1.0 / (1.0 + list_stddev_pop(gaps) / list_avg(gaps)) ELSE 0e0 END, 6) AS spacing FROM s",
    "f_learned_weight": _MEMSQL + "SELECT memory_id, round(least(greatest(strength + valence, 0.1), 0.9), 6) AS weight FROM memory",
    "f_state_fold": duck("delta")
    + ", e AS (SELECT *, coalesce(last_value(op_ts_ms IGNORE NULLS) OVER (PARTITION BY instance_id ORDER BY seqno ROWS UNBOUNDED PRECEDING), 0) AS t FROM delta), l AS (SELECT memory_id, list({'s': 0e0, 'l': 0::BIGINT, 'n': 0::BIGINT, 'd': strength_delta, 't': t::BIGINT} ORDER BY t, instance_id, seqno) AS ops FROM e GROUP BY 1), r AS (SELECT memory_id, list_reduce(ops, lambda a, e: CASE WHEN e.t > 0 AND e.t <= a.l THEN a ELSE {'s': least(greatest(a.s + e.d, 0e0), 1e0), 'l': greatest(a.l, e.t), 'n': a.n + 1, 'd': 0e0, 't': 0::BIGINT} END, {'s': 0.5e0, 'l': (-1)::BIGINT, 'n': 0::BIGINT, 'd': 0e0, 't': 0::BIGINT}) AS r FROM l) SELECT memory_id, round(r.s, 6) AS strength, r.n AS applied FROM r",
    "f_outcome_posterior": duck("tape") + "SELECT session_id, round((1 + sum(CASE WHEN outcome = 0 AND value > 0 THEN least(value / 20e0, 5) ELSE 0 END)) / (2 + sum(CASE WHEN value > 0 THEN least(value / 20e0, 5) ELSE 0 END)), 6) AS utility FROM tape GROUP BY 1",
    "e_semantic": duck("memory", "vectors") + _SEM(15, (-0.6, 0.7)) + "SELECT memory_id, round(score, 6) AS score FROM sem",
    "e_semantic_realm": duck("memory", "vectors") + _SEM(40, (-0.6, 0.7), "realm = 'project:ember'") + "SELECT memory_id, round(score, 6) AS score FROM sem",
    "e_semantic_deleted": duck("memory", "vectors") + _SEM(15, (-0.6, 0.7), "memory_id % 10 = 0") + "SELECT memory_id, round(score, 6) AS score FROM sem",
    "e_keyword": _TERMS + _KW(15, (-0.6, 0.7)) + "SELECT memory_id, round(score, 6) AS score FROM kw",
    "e_rrf": _TERMS
    + _VIEWV
    + _SIM
    + _BM
    + ", a AS (SELECT memory_id, row_number() OVER (ORDER BY similarity DESC, memory_id) AS r FROM sim ORDER BY similarity DESC, memory_id LIMIT 30), b AS (SELECT memory_id, row_number() OVER (ORDER BY bm25 DESC, memory_id) AS r FROM bm ORDER BY bm25 DESC, memory_id LIMIT 30) SELECT memory_id, round(sum(1.0::DOUBLE / (60.0 + r)), 8) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1 ORDER BY sum(1.0::DOUBLE / (60.0 + r)) DESC, 1 LIMIT 20",
    "e_hybrid": _HYB(40) + "SELECT memory_id, realm, round(score, 8) AS score FROM hit",
    "e_hybrid_window": _HYB(80, f"WHERE created_ms BETWEEN {T0} AND {T0 + 60 * DAY}")
    + f", pool AS (SELECT memory_id, realm FROM memory WHERE length(trim(content)) > 0 AND NOT coalesce(starts_with(realm, 'soul:'), false) AND created_ms BETWEEN {T0} AND {T0 + 60 * DAY} ORDER BY created_ms DESC, memory_id DESC LIMIT 64), fill AS (SELECT p.memory_id, p.realm, coalesce(s.similarity, 0e0) AS score FROM pool p LEFT JOIN sim s USING (memory_id) WHERE p.memory_id NOT IN (SELECT memory_id FROM hit)) SELECT memory_id, realm, round(score, 6) AS score FROM (SELECT *, 0 AS lane FROM hit UNION ALL SELECT *, 1 FROM fill) ORDER BY lane, score DESC, memory_id LIMIT 10",
    "e_stratified": _MEMSQL
    + ", rel AS (SELECT realm, 0.5 + 0.5 * avg(confidence) AS rel FROM memory WHERE realm IS NOT NULL GROUP BY 1), r AS (SELECT memory_id, m.realm, strength AS score, row_number() OVER (PARTITION BY m.realm ORDER BY strength DESC, memory_id) AS p, greatest(round((rel - 0.5) / 0.5 * 20), 1) AS cap FROM memory m JOIN rel USING (realm)) SELECT memory_id, realm, score FROM r WHERE p <= cap ORDER BY score DESC, memory_id LIMIT 20",
    "e_sessions": _MEMSQL
    + ", h AS (SELECT 's' || (memory_id % 50) AS source_session, strength AS score, row_number() OVER (PARTITION BY memory_id % 50 ORDER BY strength DESC, memory_id) AS r FROM memory) SELECT source_session, round(max(score) + 0.15 * (1.0 - product(CASE WHEN r BETWEEN 2 AND 5 THEN 1.0 - score ELSE 1.0 END)) * (1.0 - max(score)), 6) AS score, count(*) AS chunks FROM h GROUP BY 1 ORDER BY max(score) + 0.15 * (1.0 - product(CASE WHEN r BETWEEN 2 AND 5 THEN 1.0 - score ELSE 1.0 END)) * (1.0 - max(score)) DESC, 1 LIMIT 20",
    "e_bridge": _REFS + "SELECT memory_id, round(sum(ln(1000 / df)), 6) AS score FROM refs JOIN df USING (text), anc WHERE memory_id <> anchor AND df <= 32 GROUP BY 1 ORDER BY sum(ln(1000 / df)) DESC, 1 LIMIT 10",
    "e_bridge_saturating": _REFS + "SELECT memory_id, round(sum(ln((1000 - df + 0.5) / (df + 0.5) + 1.0)), 6) AS score FROM refs JOIN df USING (text), anc WHERE memory_id <> anchor GROUP BY 1 ORDER BY sum(ln((1000 - df + 0.5) / (df + 0.5) + 1.0)) DESC, 1 LIMIT 10",
    "e_artifact": _REFS + "SELECT DISTINCT memory_id, round(((memory_id * 37) % 101) / 100e0, 6) AS score FROM refs WHERE text = (SELECT text FROM refs GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) ORDER BY score DESC, memory_id LIMIT 10",
    "e_lures": _MEMSQL
    + ", h AS (SELECT memory_id, strength AS score, lure_risk, row_number() OVER (ORDER BY strength DESC, memory_id) AS rk FROM memory ORDER BY strength DESC, memory_id LIMIT 30), t AS (SELECT *, count(CASE WHEN lure_risk >= 0.7 AND rk > 1 THEN 1 END) OVER (ORDER BY rk DESC) AS tl FROM h) SELECT memory_id, score FROM t WHERE NOT (lure_risk >= 0.7 AND rk > 1) OR tl > 2",
    "e_knn_edges": _ST + _KNN(5, "similarity >= 0") + "SELECT src, dst, round(similarity, 6) AS similarity, rank FROM knn",
    "e_harness_conflicts": _ST.replace(" WHERE a.memory_id % 100 = 0", "") + _MEMC + _KNN(20) + "SELECT least(src, dst) AS a, greatest(src, dst) AS b, round(min(1.0 - similarity), 6) AS score FROM knn JOIN memory x ON x.memory_id = src JOIN memory y ON y.memory_id = dst WHERE x.harness <> y.harness AND 1.0 - similarity >= 0 GROUP BY 1, 2 ORDER BY min(1.0 - similarity), 1, 2 LIMIT 50",
    "e_near_duplicates": _ST.replace(" WHERE a.memory_id % 100 = 0", "") + "SELECT greatest(src, dst) AS loser, min(least(src, dst)) AS keep, round(max(similarity), 6) AS similarity FROM pr WHERE similarity >= 0.05 AND similarity < 0.9999 GROUP BY 1",
    "e_crowding": _ST + _MEMC + _KNN(8, "similarity < 0.9999") + "SELECT src, round(avg(similarity), 6) AS competitive_weight, round(avg(similarity) * avg(CASE WHEN x.kind = y.kind THEN 1.0 ELSE 0.0 END), 6) AS lure_risk FROM knn LEFT JOIN memory x ON x.memory_id = src LEFT JOIN memory y ON y.memory_id = dst GROUP BY 1",
    "e_utility_multiplier": _MEMSQL + "SELECT memory_id, round(0.7 + 0.3 * confidence, 6) AS multiplier FROM memory",
}
