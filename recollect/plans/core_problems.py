"""Queries of the general data problems (3 history, 5 hierarchy, 7 change feed) with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect import storage
from recollect.operators.changefeed import ChangedTable
from recollect.operators.hierarchy import descendants, hierarchy, levels
from recollect.operators.history import HistoryTable
from recollect.sources.tables import table

#: A feed is applied as a bulk load and the tail of the last days, so that late and corrected rows meet a built table.
TAIL_DAYS = 30
#: Least number of buckets; more as the rows ask for.
BUCKETS = 16


def _deliveries(feed: DataFrame, at: str) -> list[DataFrame]:
    cut = feed.agg(F.max(at) - F.expr(f"INTERVAL {TAIL_DAYS} DAYS")).first()[0]
    if cut is None:
        return [feed]
    late = F.col(at) > F.lit(cut)
    return [feed.where(late.isNull() | ~late), feed.where(late)]


def history_table(spark: SparkSession, sf_dir: str) -> HistoryTable:
    facts = table(spark, sf_dir, "constraint_fact", "id", "subject", "predicate", "object", "valid_from_ms", "valid_to_ms", "recorded_at")
    history = HistoryTable(spark, storage.new_path(spark, "history"), BUCKETS)
    for batch in _deliveries(facts, "recorded_at"):
        history.apply(batch)
    return history


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history_table(spark, sf_dir).versions()


def p3_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of versions and the latest one of every entity."""
    versions = history_table(spark, sf_dir).versions()
    latest = F.max(F.struct("valid_from_ms", "valid_to_ms", "object"))
    return versions.groupBy("subject", "predicate").agg(F.count(F.lit(1)).alias("n_versions"), latest.alias("l")).select("subject", "predicate", "n_versions", "l.object", "l.valid_from_ms", "l.valid_to_ms")


def _branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "fact_branch", "id", "parent_id", "recorded_at")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy(_branches(spark, sf_dir))


def p5_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (ancestor, descendant) pair with its distance."""
    return descendants(levels(_branches(spark, sf_dir)))


def _changed(spark: SparkSession, sf_dir: str) -> ChangedTable:
    feed = table(spark, sf_dir, "content_op", "instance_id", "seqno", "op_type", "memory_id", "content", "op_ts_ms", "received_at")
    changed = ChangedTable(spark, storage.new_path(spark, "feed"), BUCKETS)
    for batch in _deliveries(feed, "received_at"):
        changed.apply(batch)
    return changed


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changed(spark, sf_dir).state().select("memory_id", "instance_id", "seqno")


def p7_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Present content of every memory alive, from the same table."""
    return _changed(spark, sf_dir).state().select("memory_id", "content")


_P3 = """
WITH last AS (
  SELECT id, lower(trim(subject)) AS subject, lower(trim(predicate)) AS predicate, object, valid_from_ms, coalesce(nullif(valid_to_ms, 0), 9223372036854775807) AS stop
  FROM constraint_fact WHERE id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY recorded_at DESC, valid_from_ms DESC, nullif(valid_to_ms, 0) DESC NULLS LAST, lower(trim(subject)) DESC NULLS LAST, lower(trim(predicate)) DESC NULLS LAST, object DESC NULLS LAST) = 1),
usable AS (
  SELECT * FROM last WHERE length(trim(subject)) > 0 AND length(trim(predicate)) > 0 AND length(trim(object)) > 0 AND stop > valid_from_ms
  QUALIFY row_number() OVER (PARTITION BY subject, predicate, valid_from_ms ORDER BY id DESC) = 1),
seg AS (
  SELECT subject, predicate, object, valid_from_ms, least(stop, coalesce(lead(valid_from_ms) OVER w, 9223372036854775807)) AS stop
  FROM usable WINDOW w AS (PARTITION BY subject, predicate ORDER BY valid_from_ms)),
flag AS (
  SELECT *, CASE WHEN lag(stop) OVER w = valid_from_ms AND lag(object) OVER w = object THEN 0 ELSE 1 END AS fresh
  FROM seg WINDOW w AS (PARTITION BY subject, predicate ORDER BY valid_from_ms)),
isl AS (SELECT *, sum(fresh) OVER (PARTITION BY subject, predicate ORDER BY valid_from_ms) AS island FROM flag),
versions AS (
  SELECT subject, predicate, any_value(object) AS object, min(valid_from_ms) AS valid_from_ms,
    CAST(CASE WHEN max(stop) = 9223372036854775807 THEN 0 ELSE max(stop) END AS BIGINT) AS valid_to_ms
  FROM isl GROUP BY subject, predicate, island)
"""

_P5 = """
WITH RECURSIVE last AS (
  SELECT id, nullif(parent_id, 0) AS parent_id FROM fact_branch WHERE id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY recorded_at DESC, nullif(parent_id, 0) DESC NULLS LAST) = 1),
link AS (SELECT l.id, p.id AS parent_id FROM last l LEFT JOIN last p ON l.parent_id = p.id),
tree AS (
  SELECT id, id AS root_id, CAST(0 AS BIGINT) AS depth, CAST(id AS VARCHAR) AS path FROM link WHERE parent_id IS NULL
  UNION ALL
  SELECT l.id, t.root_id, t.depth + 1, t.path || '/' || CAST(l.id AS VARCHAR) FROM link l JOIN tree t ON l.parent_id = t.id)
"""

_P7 = """
WITH once AS (
  SELECT instance_id, seqno, max(op_type) AS op_type, max(memory_id) AS memory_id, max(content) AS content,
    max(CASE WHEN op_ts_ms > 0 THEN op_ts_ms END) AS clock
  FROM content_op WHERE instance_id IS NOT NULL AND seqno IS NOT NULL AND memory_id IS NOT NULL GROUP BY 1, 2),
eff AS (
  SELECT *, coalesce(last_value(clock IGNORE NULLS) OVER (PARTITION BY instance_id ORDER BY seqno ROWS UNBOUNDED PRECEDING), 0) AS eff FROM once),
life AS (
  SELECT *, last_value(CASE op_type WHEN 'PutPayload' THEN 1 WHEN 'DeleteMemory' THEN 0 END IGNORE NULLS)
    OVER (PARTITION BY memory_id ORDER BY eff, instance_id, seqno ROWS UNBOUNDED PRECEDING) AS alive,
    last_value(CASE op_type WHEN 'PutPayload' THEN 1 WHEN 'DeleteMemory' THEN 0 END IGNORE NULLS)
    OVER (PARTITION BY memory_id ORDER BY eff, instance_id, seqno ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS finally
  FROM eff),
state AS (
  SELECT memory_id, instance_id, seqno, content FROM life
  WHERE finally = 1 AND alive = 1 AND (op_type = 'PutPayload' OR op_type = 'UpdateMemoryContent' AND content IS NOT NULL)
  QUALIFY row_number() OVER (PARTITION BY memory_id ORDER BY eff DESC, instance_id DESC, seqno DESC) = 1)
"""

QUERIES = {f.__name__: f for f in (p3_found, p3_latest, p5_found, p5_descendants, p7_found, p7_state)}
SQL = {
    "p3_found": _P3 + "SELECT * FROM versions",
    "p3_latest": _P3 + """SELECT subject, predicate, count(*) AS n_versions, arg_max(object, valid_from_ms) AS object, max(valid_from_ms) AS valid_from_ms,
      arg_max(valid_to_ms, valid_from_ms) AS valid_to_ms FROM versions GROUP BY 1, 2""",
    "p5_found": _P5 + "SELECT * FROM tree UNION ALL SELECT id, 0, -1, '' FROM link WHERE id NOT IN (SELECT id FROM tree)",
    "p5_descendants": _P5 + """, up AS (
      SELECT id AS ancestor_id, id, CAST(0 AS BIGINT) AS distance FROM tree
      UNION ALL SELECT u.ancestor_id, l.id, u.distance + 1 FROM up u JOIN link l ON l.parent_id = u.id)
      SELECT * FROM up WHERE distance > 0""",
    "p7_found": _P7 + "SELECT memory_id, instance_id, seqno FROM state",
    "p7_state": _P7 + "SELECT memory_id, content FROM state",
}
