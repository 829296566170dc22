"""Queries of sources, sinks, streams and routing; with SQL twins where SQL says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollect import storage
from recollect.operators.fold import coverage
from recollect.plans import router
from recollect.sources import log
from recollect.sources.logical import NOW, T0, duck, view
from recollect.sources.tables import table
from recollect.streaming import logs

OP = ["instance_id", "seqno", "op_type", "memory_id", "content", "op_ts_ms"]


def _ops(s, d):
    once = table(s, d, "content_op", *OP).groupBy("instance_id", "seqno")
    return once.agg(*[F.max(c).alias(c) for c in OP[2:]])


def a_log_roundtrip(s, d):
    path = storage.new_path(s, "log")
    log.append(_ops(s, d), path)
    return log.read(s, path).select(*OP)


def a_coverage(s, d):
    return coverage(table(s, d, "content_op", "instance_id", "seqno"))


def a_uncovered(s, d):
    ops = _ops(s, d)
    return log.prune(ops, coverage(ops.where("seqno <= 100"))).select("instance_id", "seqno")


def a_sync(s, d):
    ops = _ops(s, d)
    return log.sync(ops, ops.where("seqno % 2 = 0 AND seqno < 200"))[1]


def a_op_clock(s, d):
    c = log.op_clock({k: "op_ts_ms" for k in ("PutPayload", "UpdateMemoryContent", "DeleteMemory")})
    return _ops(s, d).select("instance_id", "seqno", c.alias("clock"))


def a_chain_intact(s, d):
    stored = log.chained(_ops(s, d))
    bad = stored.withColumn("content", F.when(F.col("seqno") == 77, "altered").otherwise(F.col("content")))
    return log.broken(bad)


def a_from_seqno(s, d):
    return log.from_seqno(_ops(s, d), 300).select("instance_id", "seqno", F.get_json_object("json", "$.op_type").alias("op_type"))


def a_snapshot(s, d):
    root = storage.new_path(s, "snapshot")
    log.save_snapshot(s, {"state": view(s, d, "memory").select("memory_id", "strength"), "facts": view(s, d, "triplet")}, root)
    log.save_snapshot(s, {"state": view(s, d, "memory").select("memory_id", (F.col("strength") / 2).alias("strength"))}, root)
    return log.load_snapshot(s, root)["state"].select("memory_id", F.round("strength", 6).alias("strength"))


def a_torn_tail(s, d):
    """Operations as lines; the last write of the file was cut short."""
    path = storage.new_path(s, "lines")
    line = F.to_json(F.struct("instance_id", "seqno", "op_type"))
    last = _ops(s, d).agg(F.max(F.struct("instance_id", "seqno")).alias("m")).select("m.*")
    torn = last.withColumn("value", F.lit('{"instance_id": 99, "seq')).select(F.lit(1).alias("o"), "value")
    _ops(s, d).select(F.lit(0).alias("o"), line.alias("value")).unionByName(torn).coalesce(1).sortWithinPartitions("o").select("value").write.text(path)
    return log.complete_lines(s, path, "instance_id long, seqno long, op_type string")


def a_vector_sidecar(s, d):
    path = storage.new_path(s, "sidecar")
    log.save_vectors(view(s, d, "vectors"), path)
    return log.load_vectors(s, path, 64).select("memory_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"))


def a_import_jsonl(s, d):
    path = storage.new_path(s, "jsonl")
    view(s, d, "memory").select(F.col("memory_id").alias("id"), "kind", "confidence", "decay_rate", "realm", "pinned").write.json(path)
    return log.import_jsonl(s, path, 8).select("id", "kind", "pinned", F.round("decay_rate", 6).alias("decay_rate"), "embed_pending", F.size("embedding").cast("long").alias("dim"))


def a_graph_dump(s, d):
    root = storage.new_path(s, "graph")
    log.dump_graph(view(s, d, "memory"), view(s, d, "triplet"), root)
    n = s.read.json(f"{root}/nodes").agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit("nodes"))
    return n.unionByName(s.read.json(f"{root}/edges").agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit("edges")))


def a_transcripts(s, d):
    path = storage.new_path(s, "transcripts")
    view(s, d, "note").select("content").where("content <> ''").select(F.regexp_replace("content", "\n", " ").alias("value")).write.text(f"{path}/a/b")
    return log.transcripts(s, path).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("line")).alias("chars"))


def a_statistics_sink(s, d):
    path = storage.new_path(s, "stats")
    stats = view(s, d, "memory").where("kind IS NOT NULL").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    log.save_statistics(stats, path, NOW)
    return s.read.json(path).select("kind", "n", F.col("ts").cast("long").alias("ts"))


def _event_stream(s, d):
    return logs.tail(s, f"{d}/events.parque[t]", "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))


def a_stream_tail(s, d):
    out = logs.drain(_event_stream(s, d).select("event_id", "event_type"), storage.new_path(s, "stream"))
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def i_stream_windows(s, d):
    out = logs.drain(logs.windowed_counts(_event_stream(s, d), window="1 hour"), storage.new_path(s, "stream"), "complete")
    return out.select(F.unix_millis("start").alias("start_ms"), "event_type", "n", F.round("total", 4).alias("total"))


def i_stream_sessions(s, d):
    out = logs.drain(logs.sessions(_event_stream(s, d), "12 hours", "1 hour"), storage.new_path(s, "stream"), "complete")
    return out.select("user_id", F.unix_millis("start").alias("start_ms"), "n")


def i_stream_credit(s, d):
    x = _event_stream(s, d).select(F.col("user_id").alias("memory_id"), F.col("event_id").alias("id"), F.unix_millis("ts").alias("ts_ms"), (F.least(F.col("value") / 200, F.lit(1.0)) + 0.5).alias("magnitude"), F.when(F.col("event_type") == "error", -1).otherwise(1).alias("dir"))
    return logs.drain(logs.surprise_credit(x), storage.new_path(s, "stream")).select("memory_id", "id", F.round("delta", 6).alias("delta"), F.round("credit", 6).alias("credit"))


def i_stream_triggers(s, d):
    armed = s.createDataFrame([(1, "error"), (2, "signup")], "trigger_id long, event_type string")
    out = logs.drain(logs.matches(_event_stream(s, d), armed), storage.new_path(s, "stream"))
    return out.groupBy("trigger_id").agg(F.count(F.lit(1)).alias("n"))


def h_stream_refutations(s, d):
    x = _event_stream(s, d).select(F.concat(F.lit("u"), (F.col("user_id") % 10).cast("string")).alias("a"), F.lit("view").alias("b"), F.col("event_id").alias("turn"), (F.col("event_type") == "view").alias("hit"))
    return logs.drain(logs.refutation_changes(x), storage.new_path(s, "stream"))


def b_intent(s, d):
    return view(s, d, "memory").where("content IS NOT NULL").select("memory_id", router.intent(F.col("content")).alias("intent"))


def b_routed(s, d):
    r = router.Request(subject="c7", freetext="thread for the solvent portfolio", time_from_ms=T0, time_to_ms=NOW)
    return router.execute(r, view(s, d, "memory"), view(s, d, "triplet"), view(s, d, "tape"), NOW, 20).select(F.col("lane").cast("long").alias("lane"), "id")


def b_time_window(s, d):
    low, high, _ = router.time_window("what happened between 2024-02-01 and 2024-03-10", NOW)
    return view(s, d, "memory").where((F.col("created_ms") >= low) & (F.col("created_ms") < high)).select("memory_id")


QUERIES = {n: f for n, f in list(globals().items()) if n[:2] in ("a_", "b_", "h_", "i_") and callable(f)}

_O = "WITH o AS (SELECT instance_id, seqno, max(op_type) AS op_type, max(memory_id) AS memory_id, max(content) AS content, max(op_ts_ms) AS op_ts_ms FROM content_op GROUP BY 1, 2)\n"
_INT = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(content), '{w}')" for w in words) + f" THEN '{n}'" for n, words in router.INTENTS.items()) + " ELSE 'general' END"
SQL = {
    "a_log_roundtrip": _O + "SELECT * FROM o",
    "a_coverage": "SELECT instance_id, max(seqno) AS covered FROM content_op GROUP BY 1",
    "a_uncovered": _O + "SELECT instance_id, seqno FROM o WHERE seqno > coalesce((SELECT max(seqno) FROM o c WHERE c.instance_id = o.instance_id AND seqno <= 100), 0)",
    "a_sync": _O + "SELECT instance_id, max(seqno) AS covered FROM o GROUP BY 1",
    "a_op_clock": _O + "SELECT instance_id, seqno, CASE WHEN op_ts_ms > 0 THEN op_ts_ms END AS clock FROM o",
    "a_chain_intact": _O + ", n AS (SELECT instance_id, seqno, lag(seqno) OVER (PARTITION BY instance_id ORDER BY seqno) AS p FROM o) SELECT instance_id, seqno FROM n WHERE seqno = 77 OR p = 77",
    "a_from_seqno": _O + "SELECT instance_id, seqno, op_type FROM o WHERE seqno >= 300",
    "a_snapshot": duck("memory") + "SELECT memory_id, round(strength / 2, 6) AS strength FROM memory",
    "a_torn_tail": _O + "SELECT instance_id, seqno, op_type FROM o",
    "a_vector_sidecar": duck("vectors") + "SELECT memory_id, round(list_sum(list_transform(embedding, lambda x: CAST(CAST(x AS FLOAT) AS DOUBLE))), 4) AS total FROM vectors WHERE len(embedding) = 64",
    "a_import_jsonl": duck("memory") + "SELECT memory_id AS id, kind, pinned, CASE WHEN pinned THEN 0e0 ELSE round(decay_rate, 6) END AS decay_rate, true AS embed_pending, CAST(8 AS BIGINT) AS dim FROM memory",
    "a_graph_dump": duck("memory", "triplet") + "SELECT count(*) AS n, 'nodes' AS what FROM memory WHERE length(trim(content)) > 0 UNION ALL SELECT count(*), 'edges' FROM triplet WHERE valid_to_ms = 0",
    "a_transcripts": duck("note") + "SELECT count(*) AS n, CAST(sum(length(replace(content, chr(10), ' '))) AS BIGINT) AS chars FROM note WHERE content <> ''",
    "a_statistics_sink": duck("memory") + f"SELECT kind, count(*) AS n, {NOW} AS ts FROM memory WHERE kind IS NOT NULL GROUP BY 1",
    "a_stream_tail": "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
    "i_stream_windows": "SELECT epoch_ms(date_trunc('hour', ts)) AS start_ms, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "i_stream_sessions": "WITH f AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 12 HOURS THEN 0 ELSE 1 END AS f FROM events), p AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS part FROM f) SELECT user_id, CAST(floor(epoch_us(min(ts)) / 1000) AS BIGINT) AS start_ms, count(*) AS n FROM p GROUP BY user_id, part",
    "i_stream_triggers": "SELECT CASE event_type WHEN 'error' THEN 1 ELSE 2 END::BIGINT AS trigger_id, count(*) AS n FROM events WHERE event_type IN ('error', 'signup') GROUP BY 1",
    "b_intent": duck("memory") + f"SELECT memory_id, {_INT} AS intent FROM memory WHERE content IS NOT NULL",
    "b_time_window": duck("memory") + "SELECT memory_id FROM memory WHERE created_ms >= 1706745600000 AND created_ms < 1710115200000",
}
