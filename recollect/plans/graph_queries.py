"""Queries of the triplet and association graphs and the event tape, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollect.operators import claims as C
from recollect.operators import graph as G
from recollect.operators import tape as T
from recollect.sources.logical import DAY, NOW, T0, duck, view

W0 = 883612800000  # 1998-01-01, inside the orders' period
SEEDS = ["c1", "c2", "o5"]
R6 = lambda c: F.round(c, 6).alias(c)
TRI = ["id", "subject", "predicate", "object"]


def _t(s, d):
    return view(s, d, "triplet")


def _sup(s, d):
    return view(s, d, "supersession")


def _edge(s, d):
    return view(s, d, "edge")


def _tape(s, d):
    return view(s, d, "tape")


def g_subject(s, d):
    return G.lookup(_t(s, d), NOW, subject="c7").unionByName(G.lookup(_t(s, d), NOW, subject="o7")).select(*TRI)


def g_object(s, d):
    return G.lookup(_t(s, d), NOW, object="c7").select(*TRI)


def g_predicate(s, d):
    return G.lookup(_t(s, d), W0, predicate="placed_by").select(*TRI)


def g_entity(s, d):
    return G.entity(_t(s, d), "c7", W0, 20).select(*TRI)


def g_as_of(s, d):
    return G.as_of(_t(s, d), _sup(s, d), W0).select(*TRI)


def g_believed_at(s, d):
    return G.believed_at(_t(s, d), _sup(s, d), W0).select(*TRI)


def g_deduplicated(s, d):
    t = _t(s, d)
    twice = t.unionByName(t.where("id % 3 = 0").withColumns({"id": F.col("id") + 5_000_000_000, "weight": F.col("weight") * 2}))
    return G.deduplicated(twice).select(*TRI, F.round("weight", 9).alias("weight"))


def g_invalidated(s, d):
    closures = s.createDataFrame([("1-URGENT", NOW)], "source_file string, now_ms long")
    return G.purged(G.invalidated(_t(s, d), closures)).select("id")


def g_invalidated_ids(s, d):
    closures = _t(s, d).where("id % 5 = 0").select("id", F.lit(NOW).alias("now_ms"))
    return G.invalidated(_t(s, d), closures).select("id", "valid_to_ms")


def g_spreading(s, d):
    return G.spreading(_t(s, d), SEEDS, 2, 0.6, W0).select("memory_id", R6("activation"))


def g_traverse(s, d):
    return G.traverse(_t(s, d), _sup(s, d), "r1", 3, W0, "in").select("node", F.col("hops").cast("long").alias("hops"), R6("weight"))


def g_pagerank(s, d):
    return G.pagerank(G.directed(_t(s, d), W0, "both"), ["n1", "n2"], 0.85, 3).select("node", R6("score"))


def g_transfer(s, d):
    return G.transfer(_t(s, d), "c1", _t(s, d).where("subject = 'c1'").first()["object"], "c2", NOW).select("object", "support", R6("weight"))


def g_conflicts(s, d):
    return G.both_ways(_t(s, d), "part_of", NOW)


def g_chain(s, d):
    return G.chain(_sup(s, d), _sup(s, d).agg(F.min("old_id")).first()[0]).select(F.col("step").cast("long").alias("step"), "id")


def g_merged_edges(s, d):
    return G.merged_edges(_edge(s, d).unionByName(_edge(s, d).withColumn("weight", F.col("weight") / 2)))


def g_kind_class(s, d):
    return view(s, d, "memory").select("memory_id", G.kind_class(F.col("kind"), F.col("content")).alias("class"))


def g_census(s, d):
    return G.census(_edge(s, d))


def g_decayed(s, d):
    return G.decayed(_edge(s, d), "CoRetrieved", 0.9, 0.1).select("src", "dst", "type", R6("weight"))


def g_without_type(s, d):
    return G.without_type(_edge(s, d), "SemanticNeighbor")


def g_densified(s, d):
    m = view(s, d, "memory").withColumn("source_session", F.concat(F.lit("s"), (F.col("memory_id") % 50).cast("string")))
    return G.densified(m).select("src", "dst", "type", R6("weight"))


def _sets(s, d):
    return view(s, d, "tape").select(F.floor(F.col("turn") / 6).alias("set_id"), F.col("session_id").alias("member"), F.col("tool").alias("context"), F.col("turn").alias("pos"))


def g_coactivation(s, d):
    return G.coactivation(_sets(s, d)).select("a", "b", "n", "contexts", "multiplier")


def g_strongest_pairs(s, d):
    return G.strongest_pairs(G.coactivation(_sets(s, d)), 3)


def g_couplings(s, d):
    return G.couplings(_sets(s, d)).select("src", "dst", R6("weight"))


def g_settle(s, d):
    seeds = s.createDataFrame([(3, 1.0), (6, 1.0)], "node long, level double")
    return G.settle(G.couplings(_sets(s, d)), seeds, 3).select("node", R6("level"))


def g_illegal_edges(s, d):
    return G.illegal_edges(_edge(s, d), view(s, d, "memory"))


def g_prefix_conflicts(s, d):
    return C.prefix_conflicts(view(s, d, "memory"), words=2)


def _atoms(s, d):
    return C.atoms(view(s, d, "claim"))


def g_claim_members(s, d):
    return C.members(_atoms(s, d))


def g_contradictions(s, d):
    return C.contradictions(C.classes(_atoms(s, d))).select("realm", "key", "claim_a", "claim_b", R6("score"))


def g_transitive(s, d):
    k = C.classes(_atoms(s, d))
    return C.transitive(C.contradictions(k), k).select("realm", "via", "claim_b", "claim_c", R6("score"))


def g_resolutions(s, d):
    a = _atoms(s, d)
    return C.resolutions(C.contradictions(C.classes(a)), C.members(a), view(s, d, "memory"))


def g_replication(s, d):
    confirms = view(s, d, "memory").select(F.col("memory_id"), (F.col("memory_id") + 3).alias("by"))
    m = view(s, d, "memory").withColumn("source_session", F.concat(F.lit("s"), (F.col("memory_id") % 7).cast("string")))
    return G.replication_sessions(m, confirms)


def g_forgotten(s, d):
    t, e = G.forgotten(_t(s, d), _edge(s, d), view(s, d, "memory").where("memory_id % 5 = 0"))
    return t.agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit("facts")).unionByName(e.agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit("edges")))


def e_expanded(s, d):
    usable = view(s, d, "memory").where("status <> 'Archived'")
    return G.expanded(_edge(s, d), [1, 5, 30], 2, usable).select("memory_id", R6("activation"))


def e_ppr(s, d):
    return G.ppr_lane(_edge(s, d), [1, 5, 30], [0.5, 0.3, 0.2]).select("memory_id", R6("score"))


def h_packed(s, d):
    return T.packed(_tape(s, d))


def h_occurrences(s, d):
    return T.occurrences(_tape(s, d), ["view|0|k1", "click|0|k2"])


def h_last_occurrence(s, d):
    return T.last_occurrence(_tape(s, d), ["view|0|k1"])


def h_antecedents(s, d):
    return T.antecedents(_tape(s, d), "error|1|k3", 10).select("sym", "n", R6("pmi"))


def h_failure_patterns(s, d):
    return T.failure_patterns(_tape(s, d), 3, 10).select("sym", "fails", R6("ratio"))


def h_continuations(s, d):
    return T.continuations(_tape(s, d)).select("a", "b", R6("p"), R6("weighted"))


def h_surprisal(s, d):
    return T.surprisal(_tape(s, d)).select("turn", R6("surprisal"))


def h_td_credit(s, d):
    return T.td_credit(_tape(s, d), 0.8, 4).select("sym", R6("credit"))


def h_counterfactuals(s, d):
    return T.counterfactuals(_tape(s, d), "view|0|k1", "click|0|k2", 2, 10).select("sym", "support", R6("fail_ratio"), R6("delta"), R6("wilson_lower"))


def h_q_values(s, d):
    return T.q_values(_tape(s, d)).select("sym", R6("q"), "visits")


def h_causal(s, d):
    return T.causal(_tape(s, d), "view", "k1", 20).select("turn", "ts_ms")


def h_rejected(s, d):
    return T.rejected(T.decisions(_tape(s, d)), "error|1|k3", 20).select("turn", "chosen")


def h_active_entities(s, d):
    return T.active_entities(_tape(s, d), T0, T0 + 2 * DAY)


def h_rules(s, d):
    return T.rules(_tape(s, d), 5)


def h_verbalised(s, d):
    return T.verbalised(T.rules(_tape(s, d), 8))


def h_refutations(s, d):
    return T.refutations(_tape(s, d), 5).select("a", "b", "support", "contradict", R6("ratio"), "status")


def h_market(s, d):
    return T.market(T.refutations(_tape(s, d), 5)).select("a", "b", *[R6(c) for c in ("p_hat", "wilson_lower", "wilson_upper", "info_gain", "probe_value")])


def h_experiments(s, d):
    return T.experiments(T.market(T.refutations(_tape(s, d), 5)), 10).select("a", "b", R6("probe_value"))


def h_compressed(s, d):
    return T.compressed(_tape(s, d), 0.01).select("turn")


def h_tape_stats(s, d):
    return T.tape_stats(_tape(s, d))


def h_free_energy(s, d):
    return T.free_energy(_tape(s, d)).select("turn", R6("nll"), R6("kl"), R6("free_energy"), "emission_shock")


def h_consolidation(s, d):
    return T.consolidation(_tape(s, d), 5, 0.01).select("rules", "refuted", "hypotheses", "kept", "states", R6("mean_probe"))


def h_health(s, d):
    per = view(s, d, "tape").groupBy(F.floor(F.col("turn") / 100).alias("sample")).agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("outcome") > 0).alias("refuted"), F.count_distinct("session_id").alias("states"), F.avg(F.col("value") / 100).alias("mean_probe"))
    per = per.withColumns({"rules": F.lit(60), "q_variance": F.lit(0.1), "hypotheses": F.lit(6), "drift": F.col("sample") % 7 / 10.0, "shock": F.col("sample") % 5 / 10.0})
    return T.health(per).select("sample", "diagnosis")


def h_policies(s, d):
    per = _tape(s, d).groupBy(F.col("session_id").alias("policy")).agg(F.count(F.lit(1)).alias("shadow"), F.avg((F.col("outcome") > 0).cast("double")).alias("bad_ratio"), (F.avg("value") / 100 - 0.1).alias("lift"))
    return T.promotable_policies(per).select("policy", "decision")


def h_transitions(s, d):
    return T.transitions(_tape(s, d).select("turn", (F.col("session_id") % 20).alias("memory_id"))).select("src", "dst", R6("p"))


def h_costed(s, d):
    return T.costed(_tape(s, d), F.col("value"), F.col("value") * 10, F.col("turn") % 3).select("turn", R6("utility"))


QUERIES = {n: f for n, f in list(globals().items()) if n[:2] in ("e_", "g_", "h_") and callable(f)}

_T = duck("triplet")
_TS = duck("triplet", "supersession")
_S4 = "id, subject, predicate, object"
_VAL = lambda at: f"(valid_to_ms = 0 OR {at} < valid_to_ms)"
_BI = lambda at: f", ed AS (SELECT subject AS src, object AS dst, weight, id, source_memory_id FROM triplet WHERE {_VAL(at)} UNION ALL SELECT object, subject, 0.3 * weight, id, source_memory_id FROM triplet WHERE {_VAL(at)})"
_SYM = "tool || '|' || outcome || '|' || entity"
_H = duck("tape") + f", sy AS (SELECT *, {_SYM} AS sym FROM tape), bi AS (SELECT * FROM (SELECT turn, ts_ms, outcome, lag(sym) OVER (ORDER BY turn) AS a, sym AS b FROM sy) WHERE a IS NOT NULL)\n"
_CONT = ", c AS (SELECT a, b, count(*) AS n FROM bi GROUP BY 1, 2), cont AS (SELECT a, b, 1.0 / count(*) OVER (PARTITION BY a) AS p, n / sum(n) OVER (PARTITION BY a) AS weighted FROM c)\n"
_RULES = ", rule AS (SELECT a, b, count(*) AS support, CAST(max(least(outcome, 1)) AS DOUBLE) AS avg_outcome, min(turn) - 1 AS first, max(turn) - 1 AS last FROM bi GROUP BY 1, 2)\n"
_REF = _RULES + ", tot AS (SELECT a, count(*) AS n FROM bi GROUP BY 1), ref AS (SELECT a, b, support, n - support AS contradict, (n - support) / n AS ratio, n FROM rule JOIN tot USING (a) WHERE support >= 5)\n"
_MKT = _REF + ", pm AS (SELECT *, support / n AS p FROM ref WHERE n >= 3), mkt AS (SELECT a, b, ratio, p AS p_hat, greatest((p + 3.8416 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 0) AS wilson_lower, least((p + 3.8416 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 1) AS wilson_upper, CASE WHEN p > 0 AND p < 1 THEN -(p * log2(p) + (1 - p) * log2(1 - p)) ELSE 0e0 END AS g FROM pm), market AS (SELECT *, g AS info_gain, g * (1 - abs(p_hat - 0.5) * 2) AS probe_value FROM mkt)\n"
_SETS = duck("tape") + ", st AS (SELECT CAST(floor(turn / 6) AS BIGINT) AS set_id, session_id AS member, tool AS context, turn AS pos FROM tape)\n"
_CO = _SETS + ", co AS (SELECT x.member AS a, y.member AS b, count(*) AS n, count(DISTINCT x.context) AS contexts FROM st x JOIN st y ON x.set_id = y.set_id AND x.member < y.member GROUP BY 1, 2)\n"
_CP = _SETS + ", pr AS (SELECT x.member AS p, y.member AS q FROM st x JOIN st y ON x.set_id = y.set_id AND x.pos < y.pos), cp AS (SELECT src, dst, least(sum(w), 1.0) AS weight FROM (SELECT p AS src, q AS dst, 0.02::DOUBLE AS w FROM pr UNION ALL SELECT q, p, 0.006::DOUBLE FROM pr) GROUP BY 1, 2)\n"
_CLS = "CASE WHEN kind IN ('wisdom', 'insight', 'preference') THEN 'Thought' WHEN kind = 'correction' OR coalesce(contains(lower(substr(content, 1, 64)), 'decid'), false) THEN 'Decision' WHEN kind = 'operational' AND coalesce(contains(lower(substr(content, 1, 64)), 'src/'), false) THEN 'Artifact' ELSE 'Observation' END"
_ROOT = lambda c: f"CASE WHEN contains({c}, '-not-') THEN split_part({c}, '-not-', 1) ELSE split_part({c}, '-only', 1) END"
_MASK = lambda c, side: "(" + " + ".join(f"CASE WHEN list_contains(string_split_regex({c}, '[^a-z0-9]+'), '{p[side]}') THEN {1 << i} ELSE 0 END" for i, p in enumerate(C.ANTONYMS)) + ")"
_HAS = lambda text, signs: "(" + " OR ".join(f"contains({text}, '{x}')" for x in signs) + ")"
_CLAIM = (
    duck("memory", "claim")
    + f""", ato AS (SELECT DISTINCT memory_id, realm, domain, type = 'CORRECTION' AS correction, subject, predicate, object,
      realm || ':' || domain || ':' || replace({_ROOT('subject')}, '-', ' ') || ':' || trim(replace({_ROOT('predicate')}, '-', ' ')) AS key,
      CASE WHEN type = 'CORRECTION' THEN 'correction ' ELSE '' END || subject || '>' || predicate || '>' || object AS claim FROM claim WHERE realm IS NOT NULL),
    k AS (SELECT realm, key, claim, domain, correction, subject, predicate, object, count(*) AS n, {_HAS("concat_ws(' ', subject, predicate, object)", C.NEGATIVE)} AS neg,
      CASE {' '.join(f"WHEN {_HAS("concat_ws(' ', subject, predicate)", signs)} THEN '{m}'" for m, signs in C.MODALITY)} ELSE 'fact' END AS modality,
      {_ROOT('predicate')} AS root, contains(predicate, 'not-') AS denies, {_MASK('predicate', 0)} AS p0, {_MASK('predicate', 1)} AS p1, {_MASK('object', 0)} AS o0, {_MASK('object', 1)} AS o1 FROM ato GROUP BY ALL)
"""
)
_MEET = lambda p, q: f"(x.{p}0 & y.{q}1 <> 0 OR x.{p}1 & y.{q}0 <> 0)"
_CSCORE = f"""(CASE WHEN x.key = y.key THEN 1e0 WHEN x.subject = y.subject AND (x.predicate = y.predicate OR x.root = y.root OR {_MEET('p', 'p')}) THEN 0.8e0 WHEN x.subject = y.subject THEN 0.6e0 ELSE 0e0 END * greatest(
  CASE WHEN x.key = y.key AND x.neg <> y.neg THEN 1e0 ELSE 0e0 END, CASE WHEN x.correction AND contains(y.subject, x.subject) OR y.correction AND contains(x.subject, y.subject) THEN 0.9e0 ELSE 0e0 END,
  CASE WHEN {_MEET('p', 'p')} OR {_MEET('o', 'o')} OR {_MEET('p', 'o')} OR {_MEET('o', 'p')} THEN 0.85e0 ELSE 0e0 END,
  CASE WHEN x.predicate = y.predicate AND x.modality <> y.modality AND x.modality IN ('must', 'cannot') AND y.modality IN ('must', 'cannot') THEN 0.8e0 ELSE 0e0 END,
  CASE WHEN x.root = y.root AND x.denies <> y.denies THEN 0.7e0 ELSE 0e0 END))"""
_CON = _CLAIM + f", con AS (SELECT x.realm, x.key, x.claim AS claim_a, y.claim AS claim_b, {_CSCORE} AS score FROM k x JOIN k y ON x.realm = y.realm AND x.key = y.key AND (x.claim < y.claim OR x.claim = y.claim AND x.n > 1) WHERE {_CSCORE} >= 0.65)\n"
_PRIOR = "CASE type " + " ".join(f"WHEN '{k}' THEN {v}e0" for k, v in G.PRIOR.items()) + " END"


def _layers(depth: int) -> str:
    """Spreading activation unrolled level by level."""
    out = _T + _BI(W0) + f", l0 AS (SELECT unnest({SEEDS}) AS node, 1e0 AS act), v0 AS (SELECT node FROM l0)"
    for i in range(depth):
        out += f", l{i + 1} AS (SELECT dst AS node, max(act * greatest(weight, 0e0) * 0.6e0) AS act FROM ed JOIN l{i} ON src = node WHERE act * greatest(weight, 0e0) * 0.6e0 >= 0.01 AND dst NOT IN (SELECT node FROM v{i}) GROUP BY 1), v{i + 1} AS (SELECT node FROM v{i} UNION SELECT node FROM l{i + 1})"
    every = " UNION ALL ".join(f"SELECT source_memory_id AS memory_id, act FROM ed JOIN l{i} ON src = node" for i in range(depth + 1))
    return out + f" SELECT memory_id, round(max(act), 6) AS activation FROM ({every}) WHERE memory_id IS NOT NULL GROUP BY 1"


def _bfs(hops: int) -> str:
    out = _TS + f", ed AS (SELECT object AS src, subject AS dst, 0.3 * weight AS weight FROM triplet WHERE {_VAL(W0)} AND id NOT IN (SELECT old_id FROM supersession)), l0 AS (SELECT 'r1' AS node, 1e0 AS w), v0 AS (SELECT node FROM l0)"
    for i in range(hops):
        out += f", l{i + 1} AS (SELECT dst AS node, max(w * weight) AS w FROM ed JOIN l{i} ON src = node WHERE dst NOT IN (SELECT node FROM v{i}) GROUP BY 1), v{i + 1} AS (SELECT node FROM v{i} UNION SELECT node FROM l{i + 1})"
    return out + " " + " UNION ALL ".join(f"SELECT node, CAST({i} AS BIGINT) AS hops, round(w, 6) AS weight FROM l{i}" for i in range(1, hops + 1))


def _rank(rounds: int) -> str:
    out = _T + _BI(W0) + ", sh AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS s FROM ed), re AS (SELECT unnest(['n1', 'n2']) AS node, (1.0 - 0.85e0) / 2 AS score), s0 AS (SELECT * FROM re)"
    for i in range(rounds):
        out += f", n{i} AS (SELECT node, sum(score) AS score FROM (SELECT dst AS node, 0.85e0 * score * s AS score FROM sh JOIN s{i} ON src = node UNION ALL SELECT * FROM re) GROUP BY 1), s{i + 1} AS (SELECT node, score / (SELECT sum(score) FROM n{i}) AS score FROM n{i})"
    return out + f" SELECT node, round(score, 6) AS score FROM s{rounds}"


def _ppr(rounds: int) -> str:
    """Rounds unrolled; the first whose change is below the tolerance is the result."""
    out = duck("edge") + ", fl AS (SELECT src, dst, max(weight) AS weight FROM edge GROUP BY 1, 2), cap AS (SELECT src, dst, weight FROM fl QUALIFY row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) <= 64), m0 AS MATERIALIZED (SELECT unnest([1, 5, 30])::BIGINT AS src)"
    for i in range(4):
        out += f", m{i + 1} AS MATERIALIZED (SELECT src FROM m{i} UNION ALL (SELECT dst FROM cap WHERE src IN (SELECT src FROM m{i}) AND dst NOT IN (SELECT src FROM m{i}) GROUP BY 1 ORDER BY max(weight) DESC, dst LIMIT (SELECT 4000 - count(*) FROM m{i})))"
    out += ", lo AS (SELECT * FROM cap WHERE src IN (SELECT src FROM m4) AND dst IN (SELECT src FROM m4)), sh AS MATERIALIZED (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS s FROM lo QUALIFY sum(weight) OVER (PARTITION BY src) > 0), re AS (SELECT * FROM (VALUES (1, 0.5e0), (5, 0.3e0), (30, 0.2e0)) t(node, p)), s0 AS MATERIALIZED (SELECT node, p AS score FROM re)"
    for i in range(rounds):
        out += f", s{i + 1} AS MATERIALIZED (SELECT node, sum(score) AS score FROM (SELECT dst AS node, 0.85e0 * score * s AS score FROM sh JOIN s{i} ON src = node UNION ALL SELECT node, 0.15e0 * p FROM re) GROUP BY 1)"
    moved = " UNION ALL ".join(f"SELECT {i + 1} AS i, sum(abs(coalesce(x.score, 0) - coalesce(y.score, 0))) AS moved FROM s{i} x FULL JOIN s{i + 1} y USING (node)" for i in range(rounds))
    every = " UNION ALL ".join(f"SELECT {i} AS i, node, score FROM s{i}" for i in range(1, rounds + 1))
    return out + f", mv AS ({moved}), stop AS (SELECT coalesce((SELECT min(i) FROM mv WHERE moved < 1e-4), {rounds}) AS i) SELECT node AS memory_id, round(score, 6) AS score FROM ({every}) JOIN stop USING (i) WHERE node NOT IN (1, 5, 30)"


def _td(back: int) -> str:
    lags = " UNION ALL ".join(f"SELECT lag(sym, {i}) OVER (ORDER BY turn) AS sym, CASE WHEN outcome > 0 THEN -1 ELSE 1 END * pow(0.8, {i}) AS c FROM sy" for i in range(1, back + 1))
    return _H + f"SELECT sym, round(sum(c), 6) AS credit FROM ({lags}) WHERE sym IS NOT NULL GROUP BY 1"


SQL = {
    "g_subject": _T + f"SELECT {_S4} FROM triplet WHERE {_VAL(NOW)} AND subject IN ('c7', 'o7')",
    "g_object": _T + f"SELECT {_S4} FROM triplet WHERE {_VAL(NOW)} AND object = 'c7'",
    "g_predicate": _T + f"SELECT {_S4} FROM triplet WHERE {_VAL(W0)} AND predicate = 'placed_by'",
    "g_entity": _T + f"SELECT {_S4} FROM triplet WHERE {_VAL(W0)} AND (subject = 'c7' OR object = 'c7') ORDER BY id LIMIT 20",
    "g_as_of": _TS + f"SELECT {_S4} FROM triplet WHERE (valid_from_ms = 0 OR valid_from_ms <= {W0}) AND {_VAL(W0)} AND id NOT IN (SELECT old_id FROM supersession WHERE at_ms <= {W0})",
    "g_believed_at": _TS + f"SELECT {_S4} FROM triplet WHERE coalesce(ingested_ms, valid_from_ms) <= {W0} AND id NOT IN (SELECT old_id FROM supersession WHERE at_ms <= {W0})",
    "g_deduplicated": _T
    + f", tw AS (SELECT {_S4}, weight, valid_to_ms FROM triplet UNION ALL SELECT id + 5000000000, subject, predicate, object, weight * 2, valid_to_ms FROM triplet WHERE id % 3 = 0) SELECT {_S4}, round(weight, 9) AS weight FROM tw WHERE valid_to_ms = 0 QUALIFY row_number() OVER (PARTITION BY subject, predicate, object ORDER BY weight DESC, id) = 1 UNION ALL SELECT {_S4}, round(weight, 9) FROM tw WHERE valid_to_ms <> 0",
    "g_invalidated": _T + "SELECT id FROM triplet WHERE valid_to_ms = 0 AND source_file <> '1-URGENT'",
    "g_invalidated_ids": _T + f"SELECT id, CASE WHEN valid_to_ms = 0 AND id % 5 = 0 THEN {NOW} ELSE valid_to_ms END AS valid_to_ms FROM triplet",
    "g_spreading": _layers(2),
    "g_traverse": _bfs(3),
    "g_pagerank": _rank(3),
    "g_transfer": _T + f", f AS (SELECT * FROM triplet WHERE valid_from_ms <= {NOW} AND {_VAL(NOW)}), how AS (SELECT DISTINCT predicate FROM f WHERE subject = 'c1') SELECT object, count(*) AS support, round(max(weight), 6) AS weight FROM f WHERE subject = 'c2' AND predicate IN (SELECT predicate FROM how) GROUP BY 1",
    "g_conflicts": _T + f"SELECT subject AS name, object AS other FROM triplet WHERE {_VAL(NOW)} AND predicate = 'part_of' UNION SELECT object, subject FROM triplet WHERE {_VAL(NOW)} AND predicate = 'part_of'",
    "g_chain": duck("supersession", recursive=True) + ", ch AS (SELECT CAST(1 AS BIGINT) AS step, new_id AS id FROM supersession WHERE old_id = (SELECT min(old_id) FROM supersession) UNION ALL SELECT step + 1, new_id FROM ch JOIN supersession ON old_id = id WHERE step < 20) SELECT * FROM ch",
    "g_merged_edges": duck("edge") + "SELECT src, dst, type, max(weight) AS weight FROM edge WHERE src <> dst GROUP BY 1, 2, 3",
    "g_kind_class": duck("memory") + f"SELECT memory_id, {_CLS} AS class FROM memory",
    "g_census": duck("edge") + "SELECT type, count(*) AS n, " + ", ".join(f"count(*) FILTER (least(floor(weight * 5), 4) = {i}) AS b{i}" for i in range(5)) + " FROM edge GROUP BY 1",
    "g_decayed": duck("edge") + "SELECT src, dst, type, round(w, 6) AS weight FROM (SELECT *, CASE WHEN type = 'CoRetrieved' THEN weight * 0.9 ELSE weight END AS w FROM edge) WHERE type <> 'CoRetrieved' OR w >= 0.1",
    "g_without_type": duck("edge") + "SELECT * FROM edge WHERE type <> 'SemanticNeighbor'",
    "g_densified": duck("memory")
    + "SELECT src, dst, 'SameSession' AS type, round(weight, 6) AS weight FROM ("
    + " UNION ALL ".join(f"SELECT memory_id AS src, lag(memory_id, {i}) OVER (PARTITION BY memory_id % 50, realm ORDER BY created_ms, memory_id) AS dst, {0.6 * 0.7 ** (i - 1)!r}::DOUBLE AS weight FROM memory" for i in (1, 2, 3))
    + ") WHERE dst IS NOT NULL",
    "g_coactivation": _CO + "SELECT a, b, n, contexts, CAST(least(n * contexts, 16) AS DOUBLE) AS multiplier FROM co",
    "g_strongest_pairs": _CO + "SELECT DISTINCT a, b, n FROM (SELECT *, row_number() OVER (PARTITION BY m ORDER BY n DESC, a, b) AS r FROM (SELECT a AS m, a, b, n FROM co UNION ALL SELECT b, a, b, n FROM co)) WHERE r <= 3",
    "g_couplings": _CP + "SELECT src, dst, round(weight, 6) AS weight FROM cp",
    "g_settle": _CP
    + ", y0 AS (SELECT unnest([3, 6])::BIGINT AS node, 1e0 AS level)"
    + "".join(f", i{k} AS (SELECT dst AS node, sum(weight * level) AS i FROM cp JOIN y{k} ON src = node GROUP BY 1), y{k + 1} AS (SELECT coalesce(a.node, b.node) AS node, 1.0 / (1.0 + exp(-(coalesce(i, 0e0) + coalesce(level, 0e0) - 0.5) * 4.0)) AS level FROM i{k} a FULL JOIN y{k} b ON a.node = b.node)" for k in range(3))
    + " SELECT node, round(level, 6) AS level FROM y3",
    "g_illegal_edges": duck("edge", "memory") + f", c AS (SELECT memory_id, {_CLS} AS class FROM memory) SELECT src, dst, type, a.class AS c1, b.class AS c2 FROM edge JOIN c a ON src = a.memory_id JOIN c b ON dst = b.memory_id WHERE a.class IN ('Observation', 'Decision') AND b.class = 'Thought'",
    "g_prefix_conflicts": duck("memory")
    + f", p AS (SELECT min(memory_id) AS id, realm, array_to_string(list_slice(string_split_regex(lower(trim(substr(content, 1, 80))), '\\s+'), 1, 2), ' ') AS b, {_CLS.replace('content', "''")} AS c, content FROM memory WHERE realm IS NOT NULL AND length(content) >= 80 GROUP BY ALL) SELECT x.id AS a, y.id AS b, CASE WHEN x.c <> y.c THEN 0.6e0 ELSE 0.4e0 END AS score FROM p x JOIN p y ON x.realm = y.realm AND x.b = y.b AND x.id < y.id AND (x.c <> y.c OR x.content <> y.content) WHERE length(x.b) >= 10 ORDER BY 1, 2 LIMIT 50",
    "g_claim_members": _CLAIM + "SELECT realm, key, claim, memory_id FROM ato",
    "g_contradictions": _CON + "SELECT realm, key, claim_a, claim_b, round(score, 6) AS score FROM con",
    "g_transitive": _CON
    + f", t AS (SELECT x.realm, con.claim_a AS via, x.claim AS claim_b, y.claim AS claim_c, max({_CSCORE}) AS s FROM con JOIN k a ON a.realm = con.realm AND a.key = con.key AND a.claim = con.claim_a JOIN k x ON x.realm = con.realm AND x.key = con.key AND x.claim = con.claim_b JOIN k y ON y.realm = x.realm AND y.domain = x.domain AND {_ROOT('y.subject')} = {_ROOT('a.subject')} AND y.claim <> con.claim_a AND (y.claim <> x.claim OR y.key <> x.key) WHERE {_CSCORE} >= 0.65 GROUP BY 1, 2, 3, 4) SELECT realm, via, claim_b, claim_c, round(0.85 * s, 6) AS score FROM t",
    "g_resolutions": _CON
    + ", h AS (SELECT realm, key, claim, max(confidence) AS c FROM ato JOIN memory USING (memory_id, realm) GROUP BY 1, 2, 3), lost AS (SELECT con.realm, con.key, CASE WHEN x.c >= y.c THEN claim_b ELSE claim_a END AS claim, score FROM con JOIN h x ON x.realm = con.realm AND x.key = con.key AND x.claim = claim_a JOIN h y ON y.realm = con.realm AND y.key = con.key AND y.claim = claim_b WHERE claim_a < claim_b) SELECT memory_id AS loser, CASE WHEN max(score) < 0.75 THEN 0.3e0 ELSE 0.05e0 END AS loser_confidence FROM ato JOIN lost USING (realm, key, claim) GROUP BY 1",
    "g_replication": duck("memory") + "SELECT memory_id, count(DISTINCT s) AS sessions FROM (SELECT memory_id, memory_id % 7 AS s FROM memory UNION ALL SELECT m.memory_id, b.memory_id % 7 FROM memory m JOIN memory b ON b.memory_id = m.memory_id + 3) GROUP BY 1",
    "g_forgotten": duck("triplet", "edge", "memory") + ", del AS (SELECT memory_id FROM memory WHERE memory_id % 5 = 0) SELECT count(*) AS n, 'facts' AS what FROM triplet WHERE source_memory_id NOT IN (SELECT * FROM del) UNION ALL SELECT count(*), 'edges' FROM edge WHERE src NOT IN (SELECT * FROM del) AND dst NOT IN (SELECT * FROM del)",
    "e_expanded": duck("edge", "memory")
    + f", st AS (SELECT src, dst, 0.55e0 * {_PRIOR} * weight AS w FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst, type) AS r FROM edge) WHERE r <= 16 AND dst IN (SELECT memory_id FROM memory WHERE status <> 'Archived')), l1 AS (SELECT dst, max(w) AS act FROM st WHERE src IN (1, 5, 30) GROUP BY 1), l2 AS (SELECT st.dst, max(act * w) AS act FROM st JOIN l1 ON st.src = l1.dst GROUP BY 1) SELECT dst AS memory_id, round(max(act), 6) AS activation FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2) WHERE dst NOT IN (1, 5, 30) GROUP BY 1",
    "e_ppr": _ppr(25),
    "h_packed": duck("tape") + ", t AS (SELECT tool, row_number() OVER (ORDER BY min(turn), tool) - 1 AS tid FROM tape GROUP BY 1), e AS (SELECT entity, row_number() OVER (ORDER BY min(turn), entity) - 1 AS eid FROM tape GROUP BY 1) SELECT turn, tid * 1099511627776 + outcome * 4294967296 + eid AS packed FROM tape JOIN t USING (tool) JOIN e USING (entity)",
    "h_occurrences": _H + "SELECT turn FROM bi WHERE a = 'view|0|k1' AND b = 'click|0|k2'",
    "h_last_occurrence": _H + "SELECT max(turn) AS turn FROM sy WHERE sym = 'view|0|k1'",
    "h_antecedents": _H + ", x AS (SELECT a AS sym, count(*) AS n FROM bi WHERE b = 'error|1|k3' GROUP BY 1), y AS (SELECT sym, count(*) AS nx FROM sy GROUP BY 1) SELECT sym, n, round(ln(n * (SELECT count(*) FROM sy) / (nx * (SELECT count(*) FROM sy WHERE sym = 'error|1|k3'))), 6) AS pmi FROM x JOIN y USING (sym) ORDER BY ln(n * (SELECT count(*) FROM sy) / (nx * (SELECT count(*) FROM sy WHERE sym = 'error|1|k3'))) DESC, sym LIMIT 10",
    "h_failure_patterns": _H + ", g AS (SELECT a AS sym, count(*) FILTER (outcome > 0) AS fails, count(*) AS n FROM bi GROUP BY 1) SELECT sym, fails, round(fails / n, 6) AS ratio FROM g WHERE fails >= 3 ORDER BY fails / n * fails DESC, sym LIMIT 10",
    "h_continuations": _H + _CONT + "SELECT a, b, round(p, 6) AS p, round(weighted, 6) AS weighted FROM cont",
    "h_surprisal": _H + _CONT + "SELECT turn, round(-ln(p), 6) AS surprisal FROM bi JOIN cont USING (a, b)",
    "h_td_credit": _td(4),
    "h_counterfactuals": _H
    + ", x AS (SELECT turn, lag(sym, 1) OVER (ORDER BY turn) AS s1, lag(sym, 2) OVER (ORDER BY turn) AS s2, outcome FROM sy), g AS (SELECT s1 AS sym, count(*) AS support, avg(CASE WHEN outcome > 0 THEN 1e0 ELSE 0e0 END) AS fail_ratio FROM x WHERE s2 = 'view|0|k1' GROUP BY 1), b AS (SELECT coalesce((SELECT fail_ratio FROM g WHERE sym = 'click|0|k2'), 0.5e0) AS base), w AS (SELECT sym, support, fail_ratio, base - fail_ratio AS delta, (fail_ratio + 2.706025 / (2 * support) - 1.645 * sqrt(fail_ratio * (1 - fail_ratio) / support + 2.706025 / (4 * support * support))) / (1 + 2.706025 / support) AS wl FROM g, b WHERE sym <> 'click|0|k2' AND support >= 2) SELECT sym, support, round(fail_ratio, 6) AS fail_ratio, round(delta, 6) AS delta, round(wl, 6) AS wilson_lower FROM w ORDER BY w.delta DESC, wl, sym LIMIT 10",
    "h_causal": _H + "SELECT turn, ts_ms FROM sy WHERE sym = 'view|0|k1' ORDER BY turn DESC LIMIT 20",
    "h_rejected": _H + ", x AS (SELECT turn, sym AS chosen, lag(sym, 1) OVER (ORDER BY turn) AS s1, lag(sym, 2) OVER (ORDER BY turn) AS s2 FROM sy) SELECT turn, chosen FROM x WHERE s1 = 'error|1|k3' OR s2 = 'error|1|k3' ORDER BY turn DESC LIMIT 20",
    "h_active_entities": _H + f"SELECT entity, count(*) AS n FROM sy WHERE ts_ms BETWEEN {T0} AND {T0 + 2 * DAY} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 32",
    "h_rules": _H + _RULES + "SELECT * FROM rule WHERE support >= 5",
    "h_verbalised": _H + _RULES + "SELECT a, b, 'after ' || a || ' comes ' || b || ' (' || support || ' times, turns ' || first || ' to ' || last || ')' AS text FROM rule WHERE support >= 8",
    "h_refutations": _H + _REF + "SELECT a, b, support, contradict, round(ratio, 6) AS ratio, CASE WHEN ratio > 0.4 THEN 'refuted' ELSE 'live' END AS status FROM ref",
    "h_market": _H + _MKT + "SELECT a, b, round(p_hat, 6) AS p_hat, round(wilson_lower, 6) AS wilson_lower, round(wilson_upper, 6) AS wilson_upper, round(info_gain, 6) AS info_gain, round(probe_value, 6) AS probe_value FROM market",
    "h_experiments": _H + _MKT + "SELECT a, b, round(probe_value, 6) AS probe_value FROM market WHERE probe_value > 0.4 AND ratio < 0.3 ORDER BY market.probe_value DESC, a, b LIMIT 10",
    "h_compressed": _H + _CONT + ", x AS (SELECT turn, outcome, session_id, sym, lag(sym) OVER (ORDER BY turn) AS a, lag(session_id) OVER (ORDER BY turn) AS pv, lead(session_id) OVER (ORDER BY turn) AS nx FROM sy) SELECT turn FROM x LEFT JOIN cont ON cont.a = x.a AND cont.b = x.sym WHERE NOT (outcome = 0 AND pv IS NOT NULL AND pv = session_id AND nx IS NOT NULL AND nx = session_id AND coalesce(pow(2, ln(cont.p)) > 0.01, false))",
    "h_tape_stats": duck("tape") + "SELECT count(*) AS events, count(*) FILTER (outcome > 0) AS failures, count(DISTINCT session_id) AS sessions FROM tape",
    "h_health": duck("tape")
    + ", s AS (SELECT CAST(floor(turn / 100) AS BIGINT) AS sample, count(*) AS events, count(*) FILTER (outcome > 0) AS refuted, count(DISTINCT session_id) AS states, avg(value / 100) AS probe FROM tape GROUP BY 1), d AS (SELECT *, coalesce(states - lag(states) OVER (ORDER BY sample), 0) AS ds, coalesce(events - lag(events) OVER (ORDER BY sample), 0) AS de FROM s) SELECT sample, CASE WHEN refuted > 0 AND refuted * 2 >= 60 THEN 'refutation_flood' WHEN ds = 0 AND de > 20 THEN 'stale' WHEN probe > 0.65 THEN 'high_uncertainty' WHEN sample % 7 / 10.0 > 0.5 THEN 'fep_context_drift' WHEN sample % 5 / 10.0 > 0.3 THEN 'fep_emission_shock' ELSE 'healthy' END AS diagnosis FROM d",
    "h_policies": duck("tape") + ", p AS (SELECT session_id AS policy, count(*) AS shadow, avg(outcome) AS bad, avg(value) / 100 - 0.1 AS lift FROM tape GROUP BY 1) SELECT policy, CASE WHEN bad > 0.3 THEN 'demote' WHEN shadow >= 20 AND lift > 0.15 THEN 'promote' ELSE 'keep' END AS decision FROM p",
    "h_transitions": duck("tape") + ", x AS (SELECT lag(session_id % 20) OVER (ORDER BY turn) AS src, session_id % 20 AS dst FROM tape), c AS (SELECT src, dst, count(*) AS n FROM x WHERE src IS NOT NULL AND src <> dst GROUP BY 1, 2), p AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS p FROM c) SELECT src, dst, round(p, 6) AS p FROM p WHERE p >= 0.01 QUALIFY row_number() OVER (PARTITION BY src ORDER BY p DESC, dst) <= 32",
    "h_costed": duck("tape") + "SELECT turn, round(CASE WHEN outcome = 0 THEN 1.0 ELSE -1.0 END - value / 10000.0 - value * 10 / 60000.0 - 0.1 * (turn % 3), 6) AS utility FROM tape",
}
