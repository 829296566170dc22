"""Queries over memories: filters, look-ups, upkeep, lexical retrieval; with SQL twins."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.operators import lexical as L
from recollect.operators import memory as M
from recollect.sources.logical import DAY, NOW, T0, duck, view

QUERY = "thread for the solvent portfolio and the overture"
EFF = "least(greatest(strength * exp(-decay_rate * greatest(1735689600000 - last_strengthened_ms, 0) / 86400000e0), 0e0), 1e0)"
LIVE = "length(trim(content)) > 0"


def _mem(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "memory")


def _note(s: SparkSession, d: str) -> DataFrame:
    """Notes as they are recalled: here keyed records, paths and names occur."""
    return view(s, d, "note")


def b_filtered(s, d):
    return M.filtered(_mem(s, d), NOW, kind="wisdom", min_confidence=0.5, min_strength=0.1, limit=50).select("memory_id", "kind", "realm", F.round("effective_strength", 6).alias("effective_strength"))


def b_by_kind(s, d):
    return M.by_kind(_mem(s, d), "correction", 20).select("memory_id", "confidence")


def b_listing(s, d):
    tags = _mem(s, d).select("memory_id", F.explode(F.array("kind", "harness")).alias("tag"))
    return M.listing(_mem(s, d), tags, "strength", 20, 10).select("memory_id", "strength", "tags")


def b_metadata(s, d):
    return M.one(_mem(s, d), 67).unionByName(M.one(_mem(s, d), 30)).select("memory_id", "kind", "realm", "status", "access_count")


def b_realms(s, d):
    return M.realms(_mem(s, d))


def b_corrupt(s, d):
    return M.corrupt(_mem(s, d)).select("memory_id")


def b_prune_by_content(s, d):
    return M.prune_by_content(_mem(s, d), ["<|endoftext|>", "digest twice"]).select("memory_id", "kind", "action")


def b_claim_info(s, d):
    return M.claim_info(_mem(s, d), NOW)


def b_pending_embeddings(s, d):
    return M.pending_embeddings(_mem(s, d), view(s, d, "vectors"), 50)


def b_embedding_coverage(s, d):
    return M.embedding_coverage(_mem(s, d), view(s, d, "vectors"))


def a_write_gates(s, d):
    return M.write_gates(_mem(s, d)).select("memory_id", "times", F.round("confidence", 6).alias("confidence"))


def a_content_hash(s, d):
    return _mem(s, d).select("memory_id", M.content_hash(F.col("kind"), F.col("realm"), F.col("content")).alias("hash"))


def b_symbol_stale(s, d):
    refs = _mem(s, d).select("memory_id", F.concat(F.lit("src/Brand#1"), (F.col("memory_id") % 5 + 1).cast("string"), F.lit("/f"), (F.col("memory_id") % 20).cast("string"), F.lit(".rs")).alias("file_path"), (F.col("memory_id") % 60).alias("line"))
    return M.symbol_stale(refs, view(s, d, "symbol")).select("memory_id", "file_path", "line")


def b_source_anchors(s, d):
    memory = _mem(s, d).select("memory_id", F.concat(F.lit("f"), (F.col("memory_id") % 50).cast("string")).alias("path"), F.sha2(F.col("kind"), 256).alias("recorded_hash"))
    files = view(s, d, "symbol").groupBy(F.concat(F.lit("f"), (F.col("symbol_id") % 40).cast("string")).alias("path")).agg(F.sha2(F.lit("wisdom"), 256).alias("current_hash"))
    return M.source_anchors(memory, files)


def i_range(s, d):
    return M.in_range(_mem(s, d), T0 + 10 * DAY, T0 + 60 * DAY, limit=100).select("memory_id", "created_ms")


def i_most_recent(s, d):
    return M.in_range(_mem(s, d), 0, NOW, limit=25).select("memory_id", "created_ms")


def i_temporal_recall(s, d):
    return M.temporal_recall(_mem(s, d), T0, T0 + 90 * DAY, NOW, 40).select("memory_id", "created_ms", F.round("score", 6).alias("score"))


def i_demotion(s, d):
    return M.demotion(_mem(s, d), NOW).select("memory_id", "tier", "next_tier")


def i_prune_episodes(s, d):
    return M.prune_episodes(_mem(s, d), NOW, 120, 40)


def i_promote_staged(s, d):
    return M.promote_staged(_mem(s, d), NOW)


def j_memory_stats(s, d):
    return M.memory_stats(_mem(s, d), NOW).select("kind", "n", F.round("avg_confidence", 6).alias("avg_confidence"), F.round("avg_strength", 6).alias("avg_strength"))


def c_tokens(s, d):
    t = _mem(s, d).select("memory_id", L.tokenize(F.col("content")).alias("t"))
    return t.select("memory_id", F.size("t").cast("long").alias("n"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


def c_postings(s, d):
    return L.postings(_mem(s, d)).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))


def c_removed(s, d):
    posts = L.remove(L.postings(_mem(s, d)), _mem(s, d).where("status = 'Archived'"))
    return posts.agg(F.count(F.lit(1)).alias("n"), F.sum("tf").alias("tf"), F.count_distinct("memory_id").alias("docs"))


def c_bm25(s, d):
    return L.bm25(_mem(s, d), QUERY, 20).select("memory_id", F.round("bm25", 6).alias("bm25"))


def c_query_terms(s, d):
    return L.select_terms(L.term_stats(_mem(s, d), L.query_tokens(QUERY))).select("term", "df", F.round("idf", 6).alias("idf"))


def c_max_idf(s, d):
    return L.max_query_idf(L.term_stats(_mem(s, d), L.query_tokens(QUERY))).select(F.round("max_idf", 6).alias("max_idf"))


def c_signature_text(s, d):
    return _note(s, d).select("memory_id", F.length(L.signature_text(F.col("content"))).cast("long").alias("n"))


def c_identity_atoms(s, d):
    return L.span_refs(_note(s, d))


def c_spans(s, d):
    return L.spans(_note(s, d)).select("class", "text", "n", "first_ms", "last_ms")


def c_span_unlink(s, d):
    return L.span_unlink(L.span_refs(_note(s, d)), _note(s, d).where("memory_id % 5 = 0")).groupBy("text").agg(F.count(F.lit(1)).alias("n"))


def c_span_histogram(s, d):
    return L.span_histogram(L.spans(_note(s, d)))


def c_span_query(s, d):
    return L.span_query(L.spans(_note(s, d)), "src mod", NOW, 20).select("class", "text", F.round("score", 6).alias("score"))


def b_provenance(s, d):
    return L.provenance_lookup(_note(s, d))


def b_correction_keys(s, d):
    return _note(s, d).select("memory_id", F.explode(L.correction_keys(F.col("content"))).alias("key"))


def b_correction_check(s, d):
    return L.correction_check(_note(s, d), "Neither the jury nor the verdict and the verdict and the counsel").select("memory_id", F.col("hits").cast("long").alias("hits"))


def b_task_state(s, d):
    return L.task_state(_note(s, d))


def c_first_person(s, d):
    return L.first_person(_note(s, d))


def c_seeds(s, d):
    return _note(s, d).select("memory_id", F.explode(L.seeds(F.col("content"))).alias("seed"))


def c_claims(s, d):
    return L.claims(_note(s, d))


def _examples(s, d):
    return _mem(s, d).select(F.col("memory_id").alias("example"), F.col("content").alias("text"), F.explode(F.array(F.col("memory_id") % 16, F.col("memory_id") % 7 + 16)).alias("feature"), F.col("strength").alias("activation"))


def c_lite_train(s, d):
    return L.lite_train(_examples(s, d)).select("term", "feature", F.round("weight", 9).alias("weight"), F.round("idf", 6).alias("idf"))


def c_lite_encode(s, d):
    texts = _mem(s, d).select(F.col("memory_id").alias("id"), F.col("content").alias("text"))
    return L.lite_encode(texts, L.lite_train(_examples(s, d))).select("id", "feature", F.round("value", 4).alias("value"))


QUERIES = {n: f for n, f in list(globals().items()) if n[:2] in ("a_", "b_", "c_", "i_", "j_") and callable(f)}

_M = duck("memory")
_N = duck("note")
_TOK = "list_filter(string_split_regex(lower(content), '[^\\p{L}\\p{N}]+'), lambda w: strlen(w) >= 2 AND NOT list_contains(" + str(L.STOP) + ", w))"
_POST = duck("memory") + f", tok AS (SELECT memory_id, {_TOK} AS t FROM memory WHERE content IS NOT NULL), docs AS (SELECT memory_id, t, len(t) AS n FROM tok WHERE len(t) > 0), words AS (SELECT memory_id, n, unnest(t) AS term FROM docs), posts AS (SELECT memory_id, n, term, count(*) AS tf FROM words GROUP BY ALL)\n"
_TERMS = (
    _POST
    + ", qt AS (SELECT unnest("
    + str(L.query_tokens(QUERY))
    + ") AS term), st AS (SELECT term, count(*) AS df FROM posts JOIN qt USING (term) GROUP BY 1), nn AS (SELECT count(*) AS n, avg(n) AS avg_length FROM docs), idf AS (SELECT term, df, ln((n - df + 0.5) / (df + 0.5) + 1.0) AS idf, n FROM st, nn), sel AS (SELECT * FROM idf WHERE (SELECT min(df) FROM idf) >= n OR df = (SELECT min(df) FROM idf) OR df / n <= 0.20 ORDER BY df, term LIMIT 4)\n"
)
_CORR = "CASE WHEN starts_with(ltrim(lower(content)), '[correction]') THEN list_filter(string_split_regex(CASE WHEN regexp_extract(lower(content), '(?:not|wrong):\\s*([^\\n]*)', 1) <> '' THEN regexp_extract(lower(content), '(?:not|wrong):\\s*([^\\n]*)', 1) ELSE regexp_replace(lower(content), '^\\s*\\[correction\\]', '') END, '[^\\p{L}\\p{N}]+'), lambda t: t <> '') ELSE [] END"
_CORRW = _N + f", w AS (SELECT memory_id, created_ms, {_CORR} AS w FROM note WHERE content IS NOT NULL), k AS (SELECT memory_id, created_ms, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS keys FROM w WHERE len(w) > 1)\n"
_SPAN = _N + "".join(
    [
        ", s AS (SELECT memory_id, realm, created_ms, 'path' AS class, unnest(regexp_extract_all(content, '" + L.PATHS.replace("'", "''") + "', 1)) AS text FROM note UNION ALL SELECT memory_id, realm, created_ms, 'name', unnest(regexp_extract_all(content, '\\b([a-z]+_[a-z0-9_]+)\\b', 1)) FROM note UNION ALL SELECT memory_id, realm, created_ms, 'hex', unnest(regexp_extract_all(content, '\\b(0x[0-9a-f]{4,})\\b', 1)) FROM note), span AS (SELECT class, text, count(*) AS n, min(created_ms) AS first_ms, max(created_ms) AS last_ms FROM s GROUP BY 1, 2)\n"
    ]
)
_EX = _M + f", ex AS (SELECT memory_id AS example, unnest(list_distinct({_TOK})) AS term, strength FROM memory WHERE content IS NOT NULL), nd AS (SELECT count(*) AS n FROM memory), df AS (SELECT term, count(*) AS df FROM ex GROUP BY 1 HAVING count(*) >= 2), f AS (SELECT term, example % 16 AS feature, strength FROM ex UNION ALL SELECT term, example % 7 + 16, strength FROM ex), model AS (SELECT term, feature, sum(strength) / any_value(df) AS weight, ln((SELECT n FROM nd) / any_value(df)) AS idf FROM f JOIN df USING (term) GROUP BY 1, 2)\n"

SQL = {
    "b_filtered": _M + f"SELECT memory_id, kind, realm, round({EFF}, 6) AS effective_strength FROM memory WHERE kind = 'wisdom' AND confidence >= 0.5 AND {EFF} >= 0.1 ORDER BY memory_id LIMIT 50",
    "b_by_kind": _M + "SELECT memory_id, confidence FROM memory WHERE kind = 'correction' ORDER BY confidence DESC, memory_id LIMIT 20",
    "b_listing": _M + "SELECT memory_id, strength, array_to_string(list_sort(list_distinct([kind, harness])), ',') AS tags FROM memory ORDER BY strength DESC, memory_id LIMIT 20 OFFSET 10",
    "b_metadata": _M + f"SELECT memory_id, kind, realm, status, access_count FROM memory WHERE memory_id IN (67, 30) AND {LIVE}",
    "b_realms": _M + f"SELECT DISTINCT realm FROM memory WHERE {LIVE} AND realm IS NOT NULL",
    "b_corrupt": _M + "SELECT memory_id FROM memory WHERE coalesce(length(trim(content)) = 0, true)",
    "b_prune_by_content": _M + "SELECT memory_id, kind, 'delete' AS action FROM memory WHERE contains(lower(content), '<|endoftext|>') OR contains(lower(content), 'digest twice')",
    "b_claim_info": _M + "SELECT memory_id, staged, harness, status, CAST(floor(greatest(1735689600000 - created_ms, 0) / 86400000e0) AS BIGINT) AS age_days FROM memory",
    "b_pending_embeddings": duck("memory", "vectors") + f"SELECT memory_id FROM memory WHERE {LIVE} AND memory_id NOT IN (SELECT memory_id FROM vectors) ORDER BY 1 LIMIT 50",
    "b_embedding_coverage": duck("memory", "vectors") + f"SELECT count(*) AS should, count(*) FILTER (memory_id IN (SELECT memory_id FROM vectors)) AS have FROM memory WHERE {LIVE}",
    "a_write_gates": _M + "SELECT min(memory_id) AS memory_id, count(*) AS times, round(least(arg_min(confidence, memory_id) + 0.05 * (count(*) - 1), 1.0), 6) AS confidence FROM memory GROUP BY coalesce(kind, ''), coalesce(realm, ''), coalesce(content, '')",
    "a_content_hash": _M + "SELECT memory_id, sha256(coalesce(kind, '') || chr(31) || coalesce(realm, '') || chr(31) || coalesce(content, '')) AS hash FROM memory",
    "b_symbol_stale": duck("memory", "symbol")
    + "SELECT memory_id, file_path, line FROM (SELECT memory_id, 'src/Brand#1' || (memory_id % 5 + 1) || '/f' || (memory_id % 20) || '.rs' AS file_path, memory_id % 60 AS line FROM memory) m WHERE NOT EXISTS (SELECT 1 FROM symbol s WHERE s.file_path = m.file_path AND m.line BETWEEN line_start AND line_end)",
    "b_source_anchors": duck("memory", "symbol")
    + "SELECT memory_id, m.path, CASE WHEN f.path IS NULL THEN 'missing' WHEN kind = 'wisdom' THEN 'fresh' ELSE 'stale' END AS state FROM (SELECT memory_id, kind, 'f' || (memory_id % 50) AS path FROM memory) m LEFT JOIN (SELECT DISTINCT 'f' || (symbol_id % 40) AS path FROM symbol) f ON m.path = f.path",
    "i_range": _M + f"SELECT memory_id, created_ms FROM memory WHERE created_ms BETWEEN {T0 + 10 * DAY} AND {T0 + 60 * DAY} ORDER BY created_ms DESC, memory_id DESC LIMIT 100",
    "i_most_recent": _M + f"SELECT memory_id, created_ms FROM memory WHERE created_ms BETWEEN 0 AND {NOW} ORDER BY created_ms DESC, memory_id DESC LIMIT 25",
    "i_temporal_recall": _M + f"SELECT memory_id, created_ms, round({EFF} * confidence, 6) AS score FROM memory WHERE {LIVE} AND created_ms BETWEEN {T0} AND {T0 + 90 * DAY} ORDER BY created_ms DESC, memory_id DESC LIMIT 40",
    "i_demotion": _M
    + "SELECT memory_id, tier, CASE WHEN NOT pinned AND ((tier = 0 AND age > 7 + 2 * 0 + 0 * access_count AND age > 2) OR (tier = 1 AND age > 45 + 7 * access_count AND age > 14) OR (tier = 2 AND age > 365 + 30 * access_count AND age > 120)) THEN tier + 1 ELSE tier END AS next_tier FROM (SELECT *, greatest(1735689600000 - created_ms, 0) / 86400000e0 AS age FROM memory)",
    "i_prune_episodes": _M
    + f", e AS (SELECT memory_id, created_ms, {EFF} AS eff, greatest(1735689600000 - created_ms, 0) / 86400000e0 AS age FROM memory WHERE kind = 'episode'), g AS (SELECT memory_id FROM e WHERE age > 120 AND eff < 0.3), r AS (SELECT *, row_number() OVER (ORDER BY created_ms, memory_id) AS rn, count(*) OVER () AS n FROM e WHERE memory_id NOT IN (SELECT memory_id FROM g)) SELECT memory_id FROM g UNION ALL SELECT memory_id FROM r WHERE n > 40 AND rn <= n - 32",
    "i_promote_staged": _M + "SELECT memory_id, CASE WHEN access_count > 0 THEN 'unstage' WHEN greatest(1735689600000 - created_ms, 0) / 86400000e0 > 7 THEN 'prune' ELSE 'keep' END AS action FROM memory WHERE staged",
    "j_memory_stats": _M + f"SELECT kind, count(*) AS n, round(avg(confidence), 6) AS avg_confidence, round(avg({EFF}), 6) AS avg_strength FROM memory WHERE {LIVE} AND kind IS NOT NULL GROUP BY ROLLUP (kind)",
    "c_tokens": _M + f"SELECT memory_id, coalesce(len({_TOK}), 0) AS n, coalesce(len(list_distinct({_TOK})), 0) AS n_distinct FROM memory",
    "c_postings": _POST + "SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM posts GROUP BY 1",
    "c_removed": _POST + "SELECT count(*) AS n, CAST(sum(tf) AS BIGINT) AS tf, count(DISTINCT memory_id) AS docs FROM posts WHERE memory_id NOT IN (SELECT memory_id FROM memory WHERE status = 'Archived')",
    "c_bm25": _TERMS + "SELECT memory_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * p.n / avg_length))), 6) AS bm25 FROM posts p JOIN sel USING (term), nn GROUP BY 1 ORDER BY sum(idf * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * p.n / avg_length))) DESC, 1 LIMIT 20",
    "c_query_terms": _TERMS + "SELECT term, df, round(idf, 6) AS idf FROM sel",
    "c_max_idf": _TERMS + "SELECT round(max(idf), 6) AS max_idf FROM idf",
    "c_identity_atoms": _N + ", a AS (SELECT memory_id, list_distinct(regexp_extract_all(content, '" + L.PATHS.replace("'", "''") + "', 1)) AS a FROM note) SELECT memory_id, unnest(a) AS text FROM a",
    "c_spans": _SPAN + "SELECT * FROM span",
    "c_span_unlink": _N + ", a AS (SELECT memory_id, unnest(list_distinct(regexp_extract_all(content, '" + L.PATHS.replace("'", "''") + "', 1))) AS text FROM note WHERE memory_id % 5 <> 0) SELECT text, count(*) AS n FROM a GROUP BY 1",
    "c_span_histogram": _SPAN + "SELECT class, count(*) AS n_rows, count(*) FILTER (n = 1) AS singletons, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM span GROUP BY 1",
    "c_span_query": _SPAN
    + f", x AS (SELECT class, text, (CASE WHEN contains(lower(text), 'src') THEN 1e0 ELSE 0e0 END + CASE WHEN contains(lower(text), 'mod') THEN 1e0 ELSE 0e0 END) / 2 * CASE WHEN lower(text) = 'src mod' THEN 2e0 ELSE 1e0 END * (1 + ln(1 + n) / 10) * (0.5e0 + 0.5e0 / (1 + greatest({NOW} - last_ms, 0) / 86400000e0 / 365e0)) AS score FROM span WHERE contains(lower(text), 'src') OR contains(lower(text), 'mod')) SELECT class, text, round(score, 6) AS score FROM x ORDER BY x.score DESC, class, text LIMIT 20",
    "b_provenance": _N
    + ", k AS (SELECT memory_id, created_ms, unnest(regexp_extract_all(lower(content), '(?:^|\\s)((?:sha|input):[^\\s;,]+)', 1)) AS key FROM note WHERE starts_with(lower(ltrim(content)), '[done]')) SELECT key, arg_min(memory_id, created_ms * 1000000 + memory_id) AS memory_id, count(*) AS n FROM k GROUP BY 1",
    "b_correction_keys": _CORRW + "SELECT memory_id, unnest(keys) AS key FROM k",
    "b_correction_check": _CORRW
    + ", g AS (SELECT list_transform(range(1, 12), lambda i: w[i] || ' ' || w[i + 1]) AS g FROM (SELECT string_split('neither the jury nor the verdict and the verdict and the counsel', ' ') AS w)) SELECT memory_id, len(list_intersect(keys, g)) AS hits FROM k, g WHERE len(list_intersect(keys, g)) >= 2 ORDER BY created_ms DESC, memory_id DESC LIMIT 3",
    "b_task_state": _N
    + ", t AS (SELECT memory_id, created_ms, nullif(regexp_replace(regexp_replace(regexp_extract(lower(content), '^\\s*\\[task\\].*?(?:id|task):([^\\s]+)', 1), '[^\\p{L}\\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g'), '') AS slug FROM note) SELECT slug, arg_max(memory_id, created_ms * 1000000 + memory_id) AS memory_id, count(*) AS n FROM t WHERE slug IS NOT NULL GROUP BY 1",
    "c_first_person": _N
    + " SELECT memory_id, predicate, trim(object) AS object, predicate = 'dislikes' AS negative FROM ("
    + " UNION ALL ".join(f"SELECT memory_id, '{n}' AS predicate, unnest(regexp_extract_all(lower(content), '{p.replace(chr(39), chr(39) * 2)}', 1)) AS object FROM note" for n, p in L.FIRST_PERSON.items())
    + ")",
    "c_lite_train": _EX + "SELECT term, feature, round(weight, 9) AS weight, round(idf, 6) AS idf FROM model",
    "c_lite_encode": _EX
    + f", tf AS (SELECT id, term, count(*) AS tf FROM (SELECT memory_id AS id, unnest({_TOK}) AS term FROM memory WHERE content IS NOT NULL) GROUP BY 1, 2), v AS (SELECT id, feature, sum(tf * idf * weight) AS value FROM tf JOIN model USING (term) GROUP BY 1, 2) SELECT id, feature, round(value, 4) AS value FROM v QUALIFY row_number() OVER (PARTITION BY id ORDER BY value DESC, feature) <= 8",
    "c_signature_text": _N + "SELECT memory_id, length(array_to_string(list_filter(string_split(content, chr(10)), lambda x: regexp_matches(x, '^\\s*(" + "|".join(re.escape(x) for x in L.SIGNATURES) + ")')), chr(10))) AS n FROM note",
    "c_seeds": _N
    + "SELECT memory_id, unnest(list_distinct(list_concat(regexp_extract_all(c, '@([\\p{L}\\p{N}_-]+)', 1), regexp_extract_all(c, '\"([^\"]+)\"', 1), regexp_extract_all(c, '\\s(\\p{Lu}[\\p{L}\\p{N}]+)', 1)))) AS seed FROM (SELECT memory_id, content AS c FROM note)",
    "c_claims": _N
    + ", l AS (SELECT memory_id, unnest(string_split(content, chr(10))) AS line FROM note) SELECT memory_id, "
    + ", ".join(f"trim(regexp_extract(line, '^\\[([^\\]]+)\\] \\[([^\\]]+)\\] (.*?)(?:->(.*?))?(?:->(.*?))?(?: F:[A-Z]+)?$', {i})) AS {n}" for i, n in enumerate(("type", "domain", "subject", "predicate", "object"), 1))
    + " FROM l WHERE regexp_matches(line, '^\\[[^\\]]+\\] \\[[^\\]]+\\] ')",
}
