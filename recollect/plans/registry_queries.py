"""Queries of registries, statistics, learners and stateful operators, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollect.operators import registries as J
from recollect.operators.vectors import centroid
from recollect.sources.logical import DAY, NOW, T0, duck, view
from recollect.sources.tables import table

W0 = 883612800000
R6 = lambda c: F.round(c, 6).alias(c)


def j_geometry(s, d):
    return J.geometry(view(s, d, "vectors"), "realm").select("realm", "n", F.round("effective_dim", 4).alias("effective_dim"), R6("isotropy"), R6("mean_cosine"), "issue")


def j_drift(s, d):
    now = J.geometry(view(s, d, "vectors"), "realm")
    before = J.geometry(view(s, d, "vectors").where("memory_id % 2 = 0"), "realm")
    return J.drift(now, before, "realm", "isotropy").select("realm", R6("delta"))


def j_themes(s, d):
    return J.themes(view(s, d, "vectors")).select("realm", "members", R6("coherence"))


def j_theme_stats(s, d):
    members = view(s, d, "vectors").select("memory_id", F.col("realm").alias("theme"))
    return J.theme_stats(members, view(s, d, "memory")).select("themes", "memberships", "orphans", R6("avg_members"))


def j_assign_orphans(s, d):
    v = view(s, d, "vectors")
    return J.assign_orphans(v.where("memory_id % 7 = 0"), centroid(v.where("memory_id % 7 <> 0"), "realm"), 0.3).select("memory_id", "theme", R6("similarity"))


def j_split_large(s, d):
    return J.split_large(view(s, d, "vectors"), "realm", 40)


def j_mergeable(s, d):
    return J.mergeable(centroid(view(s, d, "vectors"), "realm"), -1.0).select("a", "b", R6("similarity"))


def j_surprise_query(s, d):
    return J.surprise_query(view(s, d, "surprise"), 50, domain="error", least=0.2).select("id", "action", "magnitude")


def j_blind_spots(s, d):
    return J.blind_spots(view(s, d, "surprise"), 20).select("domain", "action", "n", R6("avg_magnitude"), "examples")


def j_surprise_stats(s, d):
    return J.surprise_stats(view(s, d, "surprise")).select("domain", "n", R6("avg_magnitude"))


def j_fragile(s, d):
    return J.fragile(view(s, d, "debt"), 0.8, 30).select("id", "fragility")


def j_resolvable(s, d):
    return J.resolvable(view(s, d, "debt"), view(s, d, "evidence"), 2.0).select("id", R6("total"))


def j_debt_stats(s, d):
    return J.debt_stats(view(s, d, "debt")).select("n", "open", "resolved", "abandoned", R6("avg_open_fragility"))


def j_source_weights(s, d):
    return J.source_weights(view(s, d, "feedback")).select("source", "domain", "n", R6("rate"), R6("weight"))


def _wisdom(s, d):
    f = view(s, d, "override").groupBy("memory_id").agg(F.count(F.lit(1)).alias("support"), F.count_distinct("new_text").alias("sessions"), F.count_if(F.col("kind") == "P").alias("contradictions"))
    return f.withColumn("score", F.col("support") / 20.0)


def j_wisdom(s, d):
    return J.wisdom(_wisdom(s, d), 0.3).select("memory_id", "lifecycle")


def j_wisdom_stats(s, d):
    return J.wisdom(_wisdom(s, d), 0.3).groupBy("lifecycle").agg(F.count(F.lit(1)).alias("n"))


def _lineage_events(s, d):
    t = view(s, d, "tape")
    return t.select(F.col("session_id").alias("lineage"), F.col("ts_ms").alias("at_ms"), F.col("turn").alias("id"), F.when(F.col("tool") == "view", 0.3).otherwise(0.0).alias("support"), F.when(F.col("outcome") == 1, 0.4).otherwise(0.0).alias("contradiction"), F.when(F.col("tool") == "signup", 0.05).otherwise(0.0).alias("staleness"))


def j_adjudicated(s, d):
    return J.adjudicated(_lineage_events(s, d)).select("lineage", R6("support"), R6("contradiction"), R6("staleness"), "state")


def _lineages(s, d):
    return view(s, d, "memory").select(F.col("memory_id").alias("lineage"), F.when(F.col("memory_id") % 3 == 0, "Trusted").when(F.col("memory_id") % 3 == 1, "Watch").otherwise("Inflamed").alias("state"), F.col("strength").alias("support"), (F.col("surprise") / 4).alias("contradiction"), F.col("arousal").alias("staleness"), F.col("created_ms").alias("last_supported_ms"), F.col("kind").alias("domain"), F.array("harness", "status").alias("actions"))


def i_staleness_tick(s, d):
    return J.staleness_tick(_lineages(s, d), NOW).select("lineage", R6("new_staleness"), "new_state")


def i_expired(s, d):
    return J.expired(_lineages(s, d), "last_supported_ms", 7 * DAY, NOW, "Inflamed").select("lineage")


def j_envelope(s, d):
    return J.envelope_matches(_lineages(s, d), "wisdom", "term").select("lineage")


def j_lineage_stats(s, d):
    return J.lineage_stats(_lineages(s, d)).select("state", "n", R6("support"), R6("contradiction"))


def j_tasks(s, d):
    return J.tasks(view(s, d, "debt"), 40, realm="BUILDING").select("id", "status", "priority", "created_ms")


def j_task_view(s, d):
    e = view(s, d, "evidence")
    v = J.task_view(view(s, d, "debt").select("id", "status"), {"evidence": e.select(F.col("debt_id").alias("task_id"), "no", "confidence"), "criteria": e.select(F.col("debt_id").alias("task_id"), "no", "is_met")})
    return v.select("id", "status", F.greatest(F.size("evidence"), F.lit(0)).cast("long").alias("n_evidence"), F.greatest(F.size(F.filter("criteria", lambda c: c["is_met"])), F.lit(0)).cast("long").alias("n_met"))


def j_criteria_met(s, d):
    return J.all_criteria_met(view(s, d, "evidence").withColumnRenamed("debt_id", "task_id"))


def j_task_stats(s, d):
    return J.status_counts(view(s, d, "debt"), "status", ["Open", "Resolved", "Abandoned"])


def j_interventions(s, d):
    return J.select(view(s, d, "debt"), [F.col("created_ms").desc(), F.col("id").desc()], 25, session_id="s7", status="Open").select("id", "created_ms")


def j_stale_interventions(s, d):
    return J.expired(view(s, d, "debt").where("status = 'Open'"), "created_ms", 365 * 4 * DAY, 1009843200000).select("id")


def j_unified(s, d):
    return J.unified(view(s, d, "facts"), predicate="R", scope="F").select("id", "subject", "object")


def j_fact_chain(s, d):
    t = view(s, d, "triplet")
    return J.fact_chain(t, "o7", ["placed_by", "located_in", "part_of"]).select("id_0", "id_1", "id_2", "at")


def j_conflicts(s, d):
    return J.conflicts(view(s, d, "facts")).select("subject", "predicate", "scope", "object", "id", "rival", "support")


def j_resolve_branches(s, d):
    b = table(s, d, "fact_branch", "id", "status", "recorded_at")
    b = J.latest(b, ["id"], "recorded_at", "status").select("id", "status")
    v = b.where("id % 10 = 0").select(F.col("id").alias("winner"), (F.col("id") + 1).alias("loser"))
    return J.resolve_branches(b, v)


def j_ledger(s, d):
    return J.select(view(s, d, "override").where(F.col("at_ms") >= W0), [F.col("at_ms").desc(), F.col("id").desc()], 30, kind="O").select("id", "at_ms")


def j_compiled(s, d):
    return J.compiled(view(s, d, "override")).select("memory_id", "id", F.col("version").cast("long").alias("version"), "valid_from_ms", "valid_to_ms", "supersedes", "status")


def j_contested(s, d):
    a = view(s, d, "override").select(F.col("memory_id").cast("string").alias("subject"), F.lit("content").alias("predicate"), F.when(F.col("kind") == "O", "Active").otherwise("Superseded").alias("status"))
    return J.contested(a)


def j_epistemic(s, d):
    return J.epistemic_status(view(s, d, "tape").select(F.col("session_id").alias("memory_id"), (F.col("outcome") == 0).alias("passed")))


def j_symbol_search(s, d):
    return J.symbol_search(view(s, d, "symbol"), "red", 25, "src/Brand#1").select("symbol_id", "name", "file_path", "exact")


def j_symbols_in_file(s, d):
    return J.select(view(s, d, "symbol"), [F.col("line_start"), F.col("symbol_id")], None, file_path="src/Brand#17/f1.rs").select("symbol_id", "line_start")


def j_symbol_timeline(s, d):
    ev = view(s, d, "evidence")
    return J.select(ev, [F.col("at_ms"), F.col("no")], 50, debt_id=7).select("debt_id", "no", "at_ms")


def j_gc_candidates(s, d):
    sym = view(s, d, "symbol")
    return J.gc_candidates(sym, ["src/Brand#11"], sym.where("symbol_id % 4 <> 0").select("file_path"))


def j_calls(s, d):
    return J.calls_of(view(s, d, "calls"), 7)


def j_code_files(s, d):
    return J.select(view(s, d, "symbol").select("project", "file_path").distinct(), [F.col("file_path")], None, project="Brand#17")


def j_skills(s, d):
    v = view(s, d, "override").select(F.col("memory_id").alias("skill"), F.col("id").alias("version"), F.col("new_text").alias("content"))
    return J.contains_search(J.latest(v, ["skill"], "version"), "content", "urgent", 20, "skill").select("skill", "version")


def j_transcripts(s, d):
    t = view(s, d, "tape").groupBy("session_id").agg(F.count(F.lit(1)).alias("turns"), F.max("ts_ms").alias("last_ms"))
    return t.orderBy(F.col("last_ms").desc(), "session_id").limit(30)


def _rewards(s, d):
    return view(s, d, "tape").select(F.col("entity").alias("intent"), F.col("tool").alias("route"), F.least(F.col("value") / 100, F.lit(1.0)).alias("reward"))


def j_beta_posterior(s, d):
    return J.beta_posterior(_rewards(s, d), "intent", "route").select("intent", "route", R6("alpha"), R6("beta"), R6("mean"))


def j_best_route(s, d):
    return J.best_route(J.beta_posterior(_rewards(s, d), "intent", "route"))


def j_select_route(s, d):
    p = J.beta_posterior(_rewards(s, d), "intent", "route")
    return s.createDataFrame([("k1", J.select_route(p, "k1", 3))], "intent string, route string")


def j_recommended_window(s, d):
    o = view(s, d, "tape").select(F.col("tool").alias("session_type"), F.col("ts_ms").alias("at_ms"), (F.col("turn") % 40 + 1.0).alias("size"), F.least(F.col("value") / 100, F.lit(1.0)).alias("outcome"))
    return J.recommended_window(o)


def j_reliability(s, d):
    p = J.beta_posterior(view(s, d, "memory").where("realm IS NOT NULL").select("realm", F.col("confidence").alias("reward")), "realm")
    return p.select("realm", F.round(0.5 + 0.5 * F.col("mean"), 6).alias("reliability"))


def j_archive(s, d):
    return J.archive(view(s, d, "memory").select(F.concat_ws("/", F.coalesce("kind", F.lit("")), F.col("tier").cast("string")).alias("cell"), "memory_id", F.col("strength").alias("fitness")))


def j_decay_recommendation(s, d):
    return J.decay_recommendation(view(s, d, "tape").select(F.col("session_id").alias("memory_id"), F.col("ts_ms").alias("at_ms"))).select("memory_id", R6("days"), F.round("rate", 9).alias("rate"))


def i_session_gaps(s, d):
    return J.session_gaps(view(s, d, "tape").select("session_id", "ts_ms"), DAY).select("session_id", F.col("part").cast("long").alias("part"), "start_ms", "end_ms", "beats")


def i_live_sessions(s, d):
    ev = view(s, d, "tape").select("session_id", "ts_ms", F.when(F.col("tool") == "error", "deregister").when(F.col("tool") == "signup", "register").otherwise("heartbeat").alias("kind"))
    return J.live_sessions(ev)


def i_event_registry(s, d):
    return J.select(view(s, d, "surprise"), [F.col("ts_ms"), F.col("id")], 25, domain="view", action="k3").select("id", "ts_ms")


def i_triggers(s, d):
    t = view(s, d, "debt").select("id", F.col("created_ms").alias("time_after_ms"), "deadline_ms", F.col("fragility").alias("tension"), F.lit(0.9).alias("threshold"))
    return J.triggers(t, W0).select("id", "fired")


def i_tension(s, d):
    return J.tension(view(s, d, "tape").select(F.col("session_id").alias("trigger"), (F.col("value") / 2000).alias("amount")), 0.8).select("trigger", R6("tension"), "fired")


def i_surprise_credit(s, d):
    x = view(s, d, "surprise").select(F.col("source_memory_id").alias("memory_id"), "id", "ts_ms", (F.col("magnitude") + 0.5).alias("magnitude"), F.when(F.col("domain") == "error", -1).otherwise(1).alias("dir"))
    return J.surprise_credit(x).select("memory_id", "id", R6("delta"), R6("credit"))


def i_failure_window(s, d):
    f = view(s, d, "surprise").where("domain = 'error'").select("id", "ts_ms", "domain", F.col("action").alias("source"))
    return J.failure_window(f).select("id", "recent", "oldest_id")


def _hits(s, d):
    h = table(s, d, "recall_hit", "query_id", "memory_id", "score").groupBy("query_id", "memory_id").agg(F.max("score").alias("score"))
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy(F.col("score").desc_nulls_last(), "memory_id")
    return h.select(F.col("query_id").alias("set_id"), "memory_id", F.row_number().over(w).alias("pos"))


def i_touches(s, d):
    return J.recall_effects(_hits(s, d))[0]


def i_pairs(s, d):
    return J.recall_effects(_hits(s, d))[1].select("a", "b", R6("weight"))


def i_signature(s, d):
    c = view(s, d, "vectors").select((F.col("memory_id") % 40).alias("memory_id"), F.col("memory_id").alias("id"), F.col("memory_id").alias("ts_ms"), F.slice("embedding", 1, 4).alias("context"))
    return J.retrieval_signature(c).select("memory_id", F.posexplode("mean").alias("pos", "x")).select("memory_id", F.col("pos").cast("long").alias("pos"), R6("x"))


QUERIES = {n: f for n, f in list(globals().items()) if n[:2] in ("i_", "j_") and callable(f)}

_V = duck("vectors")
_U = ", u AS (SELECT memory_id, realm, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS u FROM vectors), flat AS (SELECT memory_id, realm, unnest(u) AS x, generate_subscripts(u, 1) - 1 AS pos FROM u)\n"
_GEO = lambda src, name: f", d_{name} AS (SELECT realm, pos, var_pop(x) AS v, sum(x) AS s, count(*) AS n FROM {src} GROUP BY 1, 2), {name} AS (SELECT realm, max(n) AS n, pow(sum(v), 2) / sum(v * v) AS effective_dim, pow(sum(v), 2) / sum(v * v) / count(*) AS isotropy, (sum(s * s) - max(n)) / (max(n) * (max(n) - 1.0)) AS mean_cosine FROM d_{name} GROUP BY 1)\n"
_CEN = lambda cond: f", cen AS (SELECT realm, list(m ORDER BY pos) AS mu FROM (SELECT realm, pos, avg(x) AS m FROM flat WHERE {cond} GROUP BY 1, 2) GROUP BY 1)\n"
_LIN = duck("memory") + ", lin AS (SELECT memory_id AS lineage, CASE memory_id % 3 WHEN 0 THEN 'Trusted' WHEN 1 THEN 'Watch' ELSE 'Inflamed' END AS state, strength AS support, surprise / 4 AS contradiction, arousal AS staleness, created_ms AS last_supported_ms, kind, harness, status FROM memory)\n"
_WIS = duck("override") + ", w AS (SELECT memory_id, count(*) AS support, count(DISTINCT new_text) AS sessions, count(*) FILTER (kind = 'P') AS contradictions FROM override GROUP BY 1), wl AS (SELECT memory_id, CASE WHEN support >= 4 AND sessions >= 2 AND contradictions = 0 AND support / 20.0 >= 0.3 THEN 'promotable' WHEN contradictions > 0 THEN 'contested' ELSE 'candidate' END AS lifecycle FROM w)\n"
_BETA = duck("tape") + ", bp AS (SELECT entity AS intent, tool AS route, 1 + sum(least(value / 100, 1.0)) AS alpha, 1 + sum(1 - least(value / 100, 1.0)) AS beta FROM tape GROUP BY 1, 2)\n"
_HITS = "WITH h AS (SELECT query_id, memory_id, max(score) AS score FROM recall_hit GROUP BY 1, 2), hp AS (SELECT query_id AS set_id, memory_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, memory_id) AS pos FROM h)\n"
SQL = {
    "j_geometry": _V + _U + _GEO("flat", "geo") + "SELECT realm, n, round(effective_dim, 4) AS effective_dim, round(isotropy, 6) AS isotropy, round(mean_cosine, 6) AS mean_cosine, CASE WHEN mean_cosine > 0.95 AND n >= 5 THEN 'high_similarity' WHEN isotropy < 0.3 AND n >= 5 THEN 'collapsed_embeddings' END AS issue FROM geo",
    "j_drift": _V + _U + ", ev AS (SELECT * FROM flat WHERE memory_id % 2 = 0)" + _GEO("flat", "geo") + _GEO("ev", "old") + "SELECT realm, round(geo.isotropy - old.isotropy, 6) AS delta FROM geo JOIN old USING (realm) WHERE abs(geo.isotropy - old.isotropy) > 0.005",
    "j_themes": _V + _U + _CEN("true") + "SELECT realm, count(*) AS members, round(avg(list_dot_product(u, mu) / sqrt(list_dot_product(mu, mu))), 6) AS coherence FROM u JOIN cen USING (realm) GROUP BY 1",
    "j_theme_stats": duck("vectors", "memory") + "SELECT count(DISTINCT realm) AS themes, count(*) AS memberships, (SELECT count(*) FROM memory WHERE memory_id NOT IN (SELECT memory_id FROM vectors)) AS orphans, round(count(*) / count(DISTINCT realm), 6) AS avg_members FROM vectors",
    "j_assign_orphans": _V + _U + _CEN("memory_id % 7 <> 0") + ", x AS (SELECT memory_id, realm, list_dot_product(u, mu) / sqrt(list_dot_product(mu, mu)) AS s FROM (SELECT memory_id, u FROM u WHERE memory_id % 7 = 0), cen) SELECT memory_id, CASE WHEN max(s) >= 0.3 THEN arg_max(realm, s) END AS theme, round(max(s), 6) AS similarity FROM x GROUP BY 1",
    "j_mergeable": _V + _U + _CEN("true") + "SELECT a.realm AS a, b.realm AS b, round(list_dot_product(a.mu, b.mu) / (sqrt(list_dot_product(a.mu, a.mu)) * sqrt(list_dot_product(b.mu, b.mu))), 6) AS similarity FROM cen a JOIN cen b ON a.realm < b.realm",
    "j_surprise_query": duck("surprise") + "SELECT id, action, magnitude FROM surprise WHERE domain = 'error' AND magnitude >= 0.2 ORDER BY ts_ms DESC, id DESC LIMIT 50",
    "j_blind_spots": duck("surprise") + ", r AS (SELECT *, row_number() OVER (PARTITION BY domain, action ORDER BY ts_ms, id) AS r FROM surprise) SELECT domain, action, count(*) AS n, round(avg(magnitude), 6) AS avg_magnitude, string_agg(CAST(id AS VARCHAR), ',' ORDER BY r) FILTER (r <= 5) AS examples FROM r GROUP BY 1, 2 ORDER BY count(*) * avg(magnitude) DESC, 1, 2 LIMIT 20",
    "j_surprise_stats": duck("surprise") + "SELECT domain, count(*) AS n, round(avg(magnitude), 6) AS avg_magnitude FROM surprise GROUP BY ROLLUP (domain)",
    "j_fragile": duck("debt") + "SELECT id, fragility FROM debt WHERE status = 'Open' AND fragility >= 0.8 ORDER BY fragility DESC, id LIMIT 30",
    "j_resolvable": duck("debt", "evidence") + "SELECT id, round(sum(confidence), 6) AS total FROM debt JOIN evidence ON debt_id = id WHERE status = 'Open' GROUP BY 1 HAVING sum(confidence) >= 2.0",
    "j_debt_stats": duck("debt") + "SELECT count(*) AS n, count(*) FILTER (status = 'Open') AS open, count(*) FILTER (status = 'Resolved') AS resolved, count(*) FILTER (status = 'Abandoned') AS abandoned, round(avg(fragility) FILTER (status = 'Open'), 6) AS avg_open_fragility FROM debt",
    "j_source_weights": duck("feedback") + "SELECT source, domain, count(*) AS n, round(avg(CAST(useful AS INTEGER)), 6) AS rate, round(least(greatest(2 * avg(CAST(useful AS INTEGER)), 0), 2), 6) AS weight FROM feedback GROUP BY 1, 2",
    "j_wisdom": _WIS + "SELECT * FROM wl",
    "j_wisdom_stats": _WIS + "SELECT lifecycle, count(*) AS n FROM wl GROUP BY 1",
    "j_adjudicated": duck("tape")
    + ", l AS (SELECT session_id AS lineage, list({'s': CASE WHEN tool = 'view' THEN 0.3e0 ELSE 0e0 END, 'c': CASE WHEN outcome = 1 THEN 0.4e0 ELSE 0e0 END, 't': CASE WHEN tool = 'signup' THEN 0.05e0 ELSE 0e0 END, 'st': ''} ORDER BY ts_ms, turn) AS ops FROM tape GROUP BY 1), m AS (SELECT lineage, list_reduce(ops, lambda a, e: {'s': CASE WHEN e.s > 0 THEN least(a.s + e.s, 10e0) ELSE a.s END, 'c': CASE WHEN e.c > 0 THEN least(a.c + e.c, 10e0) ELSE a.c END, 't': CASE WHEN e.t > 0 THEN least(CASE WHEN e.s > 0 THEN greatest(a.t - 0.1e0, 0e0) ELSE a.t END + e.t, 1e0) WHEN e.s > 0 THEN greatest(a.t - 0.1e0, 0e0) ELSE a.t END, 'st': CASE WHEN a.st = 'Inflamed' THEN 'Inflamed' WHEN (CASE WHEN e.c > 0 THEN least(a.c + e.c, 10e0) ELSE a.c END) / (CASE WHEN e.s > 0 THEN least(a.s + e.s, 10e0) ELSE a.s END + 0.01) > 0.6 THEN 'Inflamed' WHEN (CASE WHEN e.c > 0 THEN least(a.c + e.c, 10e0) ELSE a.c END) / (CASE WHEN e.s > 0 THEN least(a.s + e.s, 10e0) ELSE a.s END + 0.01) > 0.3 AND a.st = 'Trusted' THEN 'Watch' ELSE a.st END}, {'s': 1e0, 'c': 0e0, 't': 0e0, 'st': 'Trusted'}) AS r FROM l) SELECT lineage, round(r.s, 6) AS support, round(r.c, 6) AS contradiction, round(r.t, 6) AS staleness, r.st AS state FROM m",
    "j_recommended_window": duck("tape")
    + ", l AS (SELECT tool AS session_type, list({'m': turn % 40 + 1e0, 'n': least(value / 100, 1e0)} ORDER BY ts_ms, turn % 40 + 1e0, least(value / 100, 1e0)) AS ops FROM tape GROUP BY 1), m AS (SELECT session_type, list_reduce(ops, lambda a, e: {'m': a.m + (e.m * e.n + least(greatest(round(a.m), 3e0), 50e0) * (1e0 - e.n) - a.m) / (a.n + 1e0), 'n': a.n + 1e0}, {'m': 10e0, 'n': 1e0}) AS r FROM l) SELECT session_type, CAST(least(greatest(round(r.m), 3e0), 50e0) AS BIGINT) AS \"window\" FROM m",
    "i_staleness_tick": _LIN
    + ", t AS (SELECT *, state IN ('Trusted', 'Watch') AND 1735689600000 - last_supported_ms > 259200000 AS due FROM lin), n AS (SELECT *, CASE WHEN due THEN least(staleness + 0.05, 1.0) ELSE staleness END AS ns, contradiction / (support + 0.01) AS ratio FROM t) SELECT lineage, round(ns, 6) AS new_staleness, CASE WHEN NOT due THEN state WHEN ratio > 0.6 OR ns > 0.7 THEN 'Inflamed' WHEN state = 'Trusted' AND (ratio > 0.3 OR ns > 0.4) THEN 'Watch' ELSE state END AS new_state FROM n",
    "i_expired": _LIN + f"SELECT lineage FROM lin WHERE 1735689600000 - last_supported_ms > {7 * DAY} AND state = 'Inflamed'",
    "j_envelope": _LIN + "SELECT lineage FROM lin WHERE kind = 'wisdom' AND (harness = 'term' OR status = 'term')",
    "j_lineage_stats": _LIN + "SELECT state, count(*) AS n, round(sum(support), 6) AS support, round(sum(contradiction), 6) AS contradiction FROM lin GROUP BY 1",
    "j_tasks": duck("debt") + "SELECT id, status, priority, created_ms FROM debt WHERE realm = 'BUILDING' ORDER BY CASE WHEN status = 'Open' THEN 0 ELSE 1 END, priority DESC, created_ms DESC, id LIMIT 40",
    "j_task_view": duck("debt", "evidence") + "SELECT id, status, count(debt_id) AS n_evidence, count(*) FILTER (is_met) AS n_met FROM debt LEFT JOIN evidence ON debt_id = id GROUP BY 1, 2",
    "j_criteria_met": duck("evidence") + "SELECT debt_id AS task_id, count(*) AS n FROM evidence GROUP BY 1 HAVING bool_and(is_met)",
    "j_task_stats": duck("debt") + "SELECT count(*) AS n, count(*) FILTER (status = 'Open') AS open, count(*) FILTER (status = 'Resolved') AS resolved, count(*) FILTER (status = 'Abandoned') AS abandoned FROM debt",
    "j_interventions": duck("debt") + "SELECT id, created_ms FROM debt WHERE session_id = 's7' AND status = 'Open' ORDER BY created_ms DESC, id DESC LIMIT 25",
    "j_stale_interventions": duck("debt") + f"SELECT id FROM debt WHERE status = 'Open' AND 1009843200000 - created_ms > {365 * 4 * DAY}",
    "j_unified": duck("facts") + "SELECT id, subject, object FROM facts WHERE active AND predicate = 'R' AND scope = 'F'",
    "j_fact_chain": duck("triplet") + "SELECT a.id AS id_0, b.id AS id_1, c.id AS id_2, c.object AS at FROM triplet a JOIN triplet b ON b.subject = a.object AND b.predicate = 'located_in' JOIN triplet c ON c.subject = b.object AND c.predicate = 'part_of' WHERE a.subject = 'o7' AND a.predicate = 'placed_by'",
    "j_conflicts": duck("facts") + ", f AS (SELECT subject, predicate, scope, object, min(id) AS id, count(*) AS support FROM facts WHERE active GROUP BY 1, 2, 3, 4), r AS (SELECT *, min(id) OVER (PARTITION BY subject, predicate, scope) AS rival FROM f) SELECT * FROM r WHERE rival <> id",
    "j_resolve_branches": "WITH b AS (SELECT id, arg_max(status, (recorded_at, status)) AS status FROM fact_branch GROUP BY 1), v AS (SELECT id AS w, id + 1 AS l FROM b WHERE id % 10 = 0) SELECT id, CASE WHEN id IN (SELECT w FROM v) THEN 'Merged' WHEN id IN (SELECT l FROM v) THEN 'Abandoned' ELSE status END AS status FROM b",
    "j_ledger": duck("override") + f"SELECT id, at_ms FROM override WHERE at_ms >= {W0} AND kind = 'O' ORDER BY at_ms DESC, id DESC LIMIT 30",
    "j_compiled": duck("override") + "SELECT memory_id, id, row_number() OVER w AS version, at_ms AS valid_from_ms, lead(at_ms) OVER w AS valid_to_ms, lag(id) OVER w AS supersedes, CASE WHEN lead(id) OVER w IS NULL THEN 'Active' ELSE 'Superseded' END AS status FROM override WINDOW w AS (PARTITION BY memory_id ORDER BY at_ms, id)",
    "j_contested": duck("override") + "SELECT CAST(memory_id AS VARCHAR) AS subject, 'content' AS predicate, count(*) AS n FROM override WHERE kind = 'O' GROUP BY 1 HAVING count(*) > 1",
    "j_epistemic": duck("tape") + "SELECT session_id AS memory_id, CASE WHEN bool_or(outcome = 0) AND bool_or(outcome <> 0) THEN 'Mixed' WHEN bool_or(outcome = 0) THEN 'Tested' ELSE 'Failed' END AS status FROM tape GROUP BY 1",
    "j_symbol_search": duck("symbol") + ", o AS (SELECT name, kind, file_path, max(symbol_id) AS symbol_id FROM symbol WHERE starts_with(lower(name), 'red') AND starts_with(file_path, 'src/Brand#1') GROUP BY 1, 2, 3) SELECT symbol_id, name, file_path, lower(name) = 'red' AS exact FROM o ORDER BY exact DESC, name, file_path, symbol_id LIMIT 25",
    "j_symbols_in_file": duck("symbol") + "SELECT symbol_id, line_start FROM symbol WHERE file_path = 'src/Brand#17/f1.rs'",
    "j_symbol_timeline": duck("evidence") + "SELECT debt_id, no, at_ms FROM evidence WHERE debt_id = 7 ORDER BY at_ms, no LIMIT 50",
    "j_gc_candidates": duck("symbol") + ", r AS (SELECT *, row_number() OVER (PARTITION BY name, kind, file_path ORDER BY symbol_id DESC) AS r FROM symbol), x AS (SELECT symbol_id, CASE WHEN starts_with(file_path, 'src/Brand#11') THEN 'excluded' WHEN file_path NOT IN (SELECT file_path FROM symbol WHERE symbol_id % 4 <> 0) THEN 'dead' WHEN r > 1 THEN 'duplicate' END AS reason, regexp_extract(file_path, '^(.*)/', 1) AS dir FROM r) SELECT * FROM x WHERE reason IS NOT NULL",
    "j_calls": duck("calls") + "SELECT DISTINCT callee AS symbol_id, 'callee' AS role FROM calls WHERE caller = 7 UNION ALL SELECT DISTINCT caller, 'caller' FROM calls WHERE callee = 7",
    "j_code_files": duck("symbol") + "SELECT DISTINCT project, file_path FROM symbol WHERE project = 'Brand#17'",
    "j_skills": duck("override") + ", l AS (SELECT memory_id AS skill, max(id) AS version, arg_max(new_text, id) AS content FROM override GROUP BY 1) SELECT skill, version FROM l WHERE contains(lower(content), 'urgent') ORDER BY skill LIMIT 20",
    "j_transcripts": duck("tape") + "SELECT session_id, count(*) AS turns, max(ts_ms) AS last_ms FROM tape GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 30",
    "j_beta_posterior": _BETA + "SELECT intent, route, round(alpha, 6) AS alpha, round(beta, 6) AS beta, round(alpha / (alpha + beta), 6) AS mean FROM bp",
    "j_best_route": _BETA + "SELECT intent, arg_max(route, alpha / (alpha + beta)) AS route FROM bp GROUP BY 1",
    "j_reliability": duck("memory") + "SELECT realm, round(0.5 + 0.5 * (1 + sum(confidence)) / (2 + count(*)), 6) AS reliability FROM memory WHERE realm IS NOT NULL GROUP BY 1",
    "j_archive": duck("memory") + "SELECT coalesce(kind, '') || '/' || tier AS cell, arg_max(memory_id, (strength, -memory_id)) AS memory_id, max(strength) AS fitness FROM memory GROUP BY 1",
    "j_decay_recommendation": duck("tape")
    + ", g AS (SELECT session_id AS memory_id, list_sort(list(ts_ms)) AS t FROM tape GROUP BY 1), e AS (SELECT memory_id, list_reduce(list_prepend(86400000e0, list_transform(range(2, len(t) + 1), lambda i: greatest(t[i] - t[i - 1], 1)::DOUBLE)), lambda a, b: 0.3e0 * b + 0.7e0 * a) AS e FROM g) SELECT memory_id, round(e / 86400000e0, 6) AS days, round(least(greatest(0.0001e0 * sqrt(e / 86400000e0) * 0.75, 0.0001), 0.01), 9) AS rate FROM e",
    "i_session_gaps": duck("tape") + f", f AS (SELECT session_id, ts_ms, turn, CASE WHEN ts_ms - lag(ts_ms) OVER w <= {DAY} THEN 0 ELSE 1 END AS f FROM tape WINDOW w AS (PARTITION BY session_id ORDER BY ts_ms)), p AS (SELECT *, CAST(sum(f) OVER (PARTITION BY session_id ORDER BY ts_ms ROWS UNBOUNDED PRECEDING) AS BIGINT) AS part FROM f) SELECT session_id, part, min(ts_ms) AS start_ms, max(ts_ms) AS end_ms, count(*) AS beats FROM p GROUP BY 1, 2",
    "i_live_sessions": duck("tape") + ", e AS (SELECT session_id, ts_ms, CASE tool WHEN 'error' THEN 'deregister' WHEN 'signup' THEN 'register' ELSE 'heartbeat' END AS kind FROM tape), l AS (SELECT session_id, max(ts_ms) AS ts_ms, arg_max(kind, ts_ms) AS kind FROM e GROUP BY 1) SELECT * FROM l WHERE kind <> 'deregister'",
    "i_event_registry": duck("surprise") + "SELECT id, ts_ms FROM surprise WHERE domain = 'view' AND action = 'k3' ORDER BY ts_ms, id LIMIT 25",
    "i_triggers": duck("debt") + f", t AS (SELECT id, CASE WHEN created_ms <= {W0} THEN 'time' WHEN deadline_ms <= {W0} THEN 'deadline' WHEN fragility >= 0.9 THEN 'tension' END AS fired FROM debt) SELECT * FROM t WHERE fired IS NOT NULL",
    "i_tension": duck("tape") + "SELECT session_id AS trigger, round(least(sum(value / 2000), 1.0), 6) AS tension, least(sum(value / 2000), 1.0) >= 0.8 AS fired FROM tape GROUP BY 1",
    "i_failure_window": duck("surprise") + "SELECT id, count(*) OVER w AS recent, first_value(id) OVER w AS oldest_id FROM surprise WHERE domain = 'error' WINDOW w AS (PARTITION BY action ORDER BY ts_ms, id ROWS 7 PRECEDING)",
    "i_touches": _HITS + "SELECT memory_id, count(*) AS touches FROM hp WHERE pos <= 16 GROUP BY 1",
    "i_pairs": _HITS + "SELECT x.memory_id AS a, y.memory_id AS b, round(0.05e0 * count(*), 6) AS weight FROM hp x JOIN hp y ON x.set_id = y.set_id AND x.memory_id < y.memory_id WHERE x.pos <= 5 AND y.pos <= 5 GROUP BY 1, 2 HAVING 0.05e0 * count(*) >= 0.1",
    "i_signature": _V + ", c AS (SELECT memory_id % 40 AS memory_id, memory_id AS id, list_slice(embedding::DOUBLE[], 1, 4) AS c FROM vectors QUALIFY row_number() OVER (PARTITION BY memory_id % 40 ORDER BY memory_id DESC) <= 8) SELECT memory_id, pos, round(avg(x), 6) AS x FROM (SELECT memory_id, unnest(c) AS x, generate_subscripts(c, 1) - 1 AS pos FROM c) GROUP BY 1, 2",
}
