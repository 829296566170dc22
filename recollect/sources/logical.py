"""Logical tables of the memory store over the given tables, as SQL that Spark and DuckDB both read.

``MS(x)`` stands for epoch milliseconds of a timestamp column. All numbers that
must be double are written with an exponent.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from recollect.sources.tables import table

T0 = 1704067200000
NOW = 1735689600000
DAY = 86400000

VIEWS: dict[str, str] = {
    "memory": """SELECT doc_id AS memory_id, kind, realm, text AS content, 1704067200000 + (doc_id % 8000) * 3600000 AS created_ms, session_id AS source_session,
        CASE WHEN doc_id % 2 = 0 THEN 'term' ELSE 'relay' END AS harness, source,
        ((doc_id * 37) % 101) / 100e0 AS strength, ((doc_id * 53) % 101) / 100e0 AS confidence, 1e-3 * (1 + doc_id % 5) AS decay_rate, doc_id % 9 AS access_count,
        1704067200000 + (doc_id % 8000) * 3600000 AS last_strengthened_ms, doc_id % 11 = 0 AS pinned, doc_id % 3 AS tier, doc_id % 4 = 0 AS staged,
        CASE doc_id % 7 WHEN 0 THEN 'Archived' WHEN 1 THEN 'Verified' WHEN 2 THEN 'Observed' WHEN 3 THEN 'Proposed' ELSE 'Active' END AS status, doc_id % 4 AS epistemic,
        ((doc_id * 17) % 101) / 100e0 AS surprise, ((doc_id * 19) % 101) / 100e0 AS arousal, ((doc_id * 23) % 101) / 100e0 AS competitive_weight,
        ((doc_id * 29) % 101) / 100e0 AS lure_risk, ((doc_id * 31) % 101) / 100e0 AS spacing_quality, ((doc_id * 41) % 201) / 100e0 - 1e0 AS valence, doc_id % 5 AS replication_count
        FROM {documents}""",
    "claim": """SELECT doc_id AS memory_id, realm, source AS domain, CASE WHEN kind = 'correction' THEN 'CORRECTION' ELSE 'OPERATIONAL' END AS type, 'node-' || CAST(CAST(floor(doc_id / 8e0) AS BIGINT) % 3 AS VARCHAR(9)) AS subject,
        CASE doc_id % 8 WHEN 0 THEN 'use-ssh' WHEN 1 THEN 'use-ssh-not-slurm' WHEN 2 THEN 'must-use-slurm' WHEN 3 THEN 'cannot-use-slurm' WHEN 4 THEN 'enable-cache' WHEN 5 THEN 'disable-cache' WHEN 6 THEN 'keep-logs' ELSE 'keep-logs-only' END AS predicate,
        CASE doc_id % 3 WHEN 0 THEN 'local' WHEN 1 THEN 'remote' ELSE 'both' END AS object FROM {documents}""",
    "note": """SELECT memory_id, max(content) AS content, max(realm) AS realm, min(ts_ms) AS created_ms, max(kind) AS kind FROM {recall_hit} GROUP BY memory_id""",
    "vectors": "SELECT vec_id AS memory_id, 'r' || CAST(label AS VARCHAR(9)) AS realm, embedding FROM {embeddings}",
    "tape": """SELECT event_id AS turn, event_type AS tool, 'k' || CAST(event_id % 10 AS VARCHAR(9)) AS entity,
        CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS outcome, user_id AS session_id, MS(ts) AS ts_ms, value FROM {events}""",
    "triplet": """SELECT o_orderkey AS id, 'o' || CAST(o_orderkey AS VARCHAR(19)) AS subject, 'placed_by' AS predicate, 'c' || CAST(o_custkey AS VARCHAR(19)) AS object, o_totalprice / 500000e0 AS weight,
        MS(o_orderdate) AS valid_from_ms, CASE WHEN o_orderstatus = 'F' THEN MS(o_orderdate) + 7776000000 ELSE 0 END AS valid_to_ms, o_custkey AS source_memory_id, o_orderpriority AS source_file,
        MS(o_orderdate) + 86400000 AS ingested_ms FROM {orders}
        UNION ALL SELECT 1000000000 + c_custkey, 'c' || CAST(c_custkey AS VARCHAR(19)), 'located_in', 'n' || CAST(c_nationkey AS VARCHAR(19)), 1e0, 0, 0, c_custkey, 'customer', 0 FROM {customer}
        UNION ALL SELECT 2000000000 + n_nationkey, 'n' || CAST(n_nationkey AS VARCHAR(19)), 'part_of', 'r' || CAST(n_regionkey AS VARCHAR(19)), 1e0, 0, 0, n_nationkey, 'nation', 0 FROM {nation}
        UNION ALL SELECT 3000000000 + s_suppkey, 's' || CAST(s_suppkey AS VARCHAR(19)), 'located_in', 'n' || CAST(s_nationkey AS VARCHAR(19)), 0.5e0, 0, 0, s_suppkey, 'supplier', 0 FROM {supplier}""",
    "supersession": """SELECT old_id, new_id, at_ms FROM (SELECT o_orderkey AS old_id, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS new_id,
        lead(MS(o_orderdate)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS at_ms FROM {orders}) WHERE new_id IS NOT NULL""",
    "delta": """SELECT user_id AS memory_id, event_id % 4 AS instance_id, event_id AS seqno,
        ((event_id * 37) % 21 - 10) / 100e0 AS strength_delta, CASE WHEN event_id % 10 = 0 THEN NULL ELSE MS(ts) END AS op_ts_ms, event_type = 'view' AS touch FROM {events}""",
    "debt": """SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'Open' WHEN 'F' THEN 'Resolved' ELSE 'Abandoned' END AS status, c_mktsegment AS realm, o_orderpriority AS domain,
        (6 - CAST(substr(o_orderpriority, 1, 1) AS INTEGER)) / 5e0 AS fragility, MS(o_orderdate) AS created_ms, MS(o_orderdate) + 2592000000 AS deadline_ms, 's' || CAST(o_custkey % 50 AS VARCHAR(9)) AS session_id,
        6 - CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    "evidence": "SELECT l_orderkey AS debt_id, l_linenumber AS no, l_discount * 10e0 AS confidence, l_linestatus = 'F' AS is_met, MS(l_shipdate) AS at_ms FROM {lineitem}",
    "feedback": "SELECT l_returnflag AS source, l_linestatus AS domain, l_discount >= 0.05e0 AS useful FROM {lineitem}",
    "override": "SELECT o_orderkey AS id, o_custkey AS memory_id, o_orderpriority AS new_text, MS(o_orderdate) AS at_ms, 's' || CAST(o_custkey % 50 AS VARCHAR(9)) AS session_id, o_orderstatus AS kind FROM {orders}",
    "facts": """SELECT l_orderkey * 10000000 + l_partkey * 10 + l_linenumber AS id, 'o' || CAST(l_orderkey AS VARCHAR(19)) AS subject, l_returnflag AS predicate, 'p' || CAST(l_partkey AS VARCHAR(19)) AS object,
        l_linestatus AS scope, l_discount * 10e0 AS confidence, l_quantity > 5e0 AS active, MS(l_shipdate) AS at_ms FROM {lineitem}""",
    "symbol": "SELECT p_partkey AS symbol_id, p_name AS name, p_type AS kind, 'src/' || p_brand || '/f' || CAST(p_partkey % 20 AS VARCHAR(9)) || '.rs' AS file_path, p_size AS line_start, p_size + 10 AS line_end, p_brand AS project FROM {part}",
    "calls": """SELECT caller, callee FROM (SELECT l_partkey AS caller, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS callee FROM {lineitem}) WHERE callee IS NOT NULL""",
    "edge": """SELECT src, dst, type, max(weight) AS weight FROM (
        SELECT c_custkey AS src, (c_custkey * 7 + 3) % 150 AS dst, 'SameSession' AS type, 0.6e0 AS weight FROM {customer}
        UNION ALL SELECT c_custkey, (c_custkey * 11 + 5) % 150, 'CoRetrieved', ((c_custkey * 13) % 101) / 100e0 FROM {customer}
        UNION ALL SELECT c_custkey % 150, c_custkey, 'SemanticNeighbor', ((c_custkey * 29) % 101) / 100e0 FROM {customer}
        UNION ALL SELECT c_custkey, (c_custkey + 1) % 150, 'DerivedFrom', ((c_custkey * 31) % 101) / 100e0 FROM {customer} WHERE c_custkey % 3 = 0) WHERE src <> dst GROUP BY src, dst, type""",
    "surprise": "SELECT event_id AS id, event_type AS domain, 'k' || CAST(event_id % 10 AS VARCHAR(9)) AS action, least(value / 200e0, 1e0) AS magnitude, user_id AS source_memory_id, MS(ts) AS ts_ms, 's' || CAST(user_id % 5 AS VARCHAR(9)) AS realm FROM {events}",
}


def _needs(sql: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", sql)))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A logical table as a DataFrame; only the columns later used are read."""
    sql = re.sub(r"MS\(([^()]*)\)", r"unix_millis(CAST(\1 AS TIMESTAMP))", VIEWS[name])
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in _needs(sql)})


def duck(*names: str, recursive: bool = False) -> str:
    """The same tables as the head of a DuckDB statement: ``WITH name AS (...), ...``."""
    parts = []
    for n in names:
        sql = re.sub(r"MS\(([^()]*)\)", r"CAST(floor(epoch_us(\1) / 1000) AS BIGINT)", VIEWS[n])
        parts.append(f"{n} AS ({re.sub(r'\{(\w+)\}', r'\1', sql)})")
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n"
