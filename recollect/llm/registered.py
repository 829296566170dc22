"""Queries of the training-data operators over the tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm.fusion import best, fuse, positions
from recollect.llm.near_duplicates import NearDuplicates
from recollect.llm.packing import pack
from recollect.llm.subjects import classify, fit, prepared
from recollect.llm.tokenize import decode, encode
from recollect.llm.vector_search import nearest
from recollect.llm.weighting import characteristic, log_entropy
from recollect.operators.components import components
from recollect.sources.tables import table

SCORES = ["semantic_score", "strength", "actr_activation", "surprise_boost"]

CAPACITY = 2048


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuse(table(spark, sf_dir, "recall_hit", "query_id", "memory_id", *SCORES), "query_id", "memory_id", SCORES)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best(_fused(spark, sf_dir), "query_id", "memory_id").select("query_id", "memory_id")


def p1_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hit with its rank in each score, its fused value and its position."""
    return positions(_fused(spark, sf_dir), "query_id", "memory_id").withColumn("rrf", F.round("rrf", 9))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = nearest(table(spark, sf_dir, "content_op", "memory_id", "embedding"), "memory_id", "embedding", k=5, probes=4, ef=24, least=0.9)
    return near.select(F.least("memory_id", "neighbour").alias("memory_a"), F.greatest("memory_id", "neighbour").alias("memory_b")).distinct()


def p2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every memory whose id is divisible by 100, against all memories."""
    ops = table(spark, sf_dir, "content_op", "memory_id", "embedding")
    return nearest(ops, "memory_id", "embedding", k=5, probes=8, ef=64, queries=lambda item: item % 100 == 0)


def _weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_entropy(table(spark, sf_dir, "recall_hit", "memory_id", "content"))


def p4_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight of every term of every memory."""
    return _weights(spark, sf_dir).withColumn("weight", F.round("weight", 6))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return characteristic(table(spark, sf_dir, "recall_hit", "memory_id", "content"), tf=3, df=5).select("memory_id", "term")


def _near(spark: SparkSession, sf_dir: str) -> NearDuplicates:
    return NearDuplicates(table(spark, sf_dir, "recall_hit", "memory_id", "content", "realm"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir).pairs()


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per memory with its group and the number of links of its class."""
    near = _near(spark, sf_dir)
    group = components(near.links).withColumnRenamed("id", "rep")
    degree = near.links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    rep = near.docs.select("memory_id").join(near.members(), "memory_id", "left").select("memory_id", F.coalesce("rep", "memory_id").alias("rep"))
    return rep.join(group, "rep", "left").join(degree, "rep", "left").select("memory_id", F.coalesce("component", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents", "doc_id", "text"))


def p8_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text put together again from its ids; null texts come back empty."""
    return decode(p8_ids(spark, sf_dir))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(p8_ids(spark, sf_dir).select("doc_id", F.size("ids").alias("n_tokens")), CAPACITY)


def p9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container and place of every piece of every text, in tokens of byte_bpe_50k."""
    return _packed(spark, sf_dir).drop("by_pattern")


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used, the least possible number, the part filled, and the part of the pieces that patterns placed."""
    placed = F.avg(F.col("by_pattern").cast("double")).alias("by_pattern")
    used = _packed(spark, sf_dir).agg(F.countDistinct("container_id").alias("containers"), F.sum("n_tokens").alias("tokens"), placed)
    return used.select("containers", F.ceil(F.col("tokens") / CAPACITY).alias("least"), (F.col("tokens") / (F.col("containers") * CAPACITY)).alias("filled"), "by_pattern")


def p10_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas of every document with the share of its words."""
    docs = prepared(table(spark, sf_dir, "documents", "doc_id", "text", "lang"), table(spark, sf_dir, "area_label", "doc_id", "area"))
    return classify(docs, fit(docs))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_shares(spark, sf_dir).select("doc_id", "area")


_P1 = """
WITH once AS (
  SELECT query_id, memory_id, max(CASE WHEN isnan(semantic_score) THEN NULL ELSE semantic_score END) AS a, max(CASE WHEN isnan(strength) THEN NULL ELSE strength END) AS b,
    max(CASE WHEN isnan(actr_activation) THEN NULL ELSE actr_activation END) AS c, max(CASE WHEN isnan(surprise_boost) THEN NULL ELSE surprise_boost END) AS d
  FROM recall_hit WHERE query_id IS NOT NULL AND memory_id IS NOT NULL GROUP BY 1, 2),
ranked AS (
  SELECT query_id, memory_id, CAST(rank() OVER (PARTITION BY query_id ORDER BY a DESC NULLS LAST) AS INTEGER) AS semantic_score_rank,
    CAST(rank() OVER (PARTITION BY query_id ORDER BY b DESC NULLS LAST) AS INTEGER) AS strength_rank,
    CAST(rank() OVER (PARTITION BY query_id ORDER BY c DESC NULLS LAST) AS INTEGER) AS actr_activation_rank,
    CAST(rank() OVER (PARTITION BY query_id ORDER BY d DESC NULLS LAST) AS INTEGER) AS surprise_boost_rank FROM once),
fused AS (SELECT *, 0.0::DOUBLE + 1.0::DOUBLE / (60 + semantic_score_rank) + 1.0::DOUBLE / (60 + strength_rank) + 1.0::DOUBLE / (60 + actr_activation_rank) + 1.0::DOUBLE / (60 + surprise_boost_rank) AS rrf FROM ranked)
"""

_P4 = """
WITH once AS (SELECT memory_id, max(content) AS content FROM recall_hit WHERE memory_id IS NOT NULL GROUP BY 1),
post AS (
  SELECT memory_id, term, count(*) AS tf FROM (SELECT memory_id, unnest(regexp_extract_all(lower(content), '[\\p{L}\\p{N}]{2,}')) AS term FROM once) GROUP BY 1, 2),
n AS (SELECT count(DISTINCT memory_id) AS n FROM post),
stats AS (SELECT term, count(*) AS df, ln(sum(tf)) - sum(tf * ln(tf)) / sum(tf) AS h FROM post GROUP BY 1),
weights AS (
  SELECT memory_id, p.term, tf, df, ln(1 + tf) * greatest(1 - h / ln((SELECT n FROM n)), 0) AS weight FROM post p JOIN stats s ON p.term = s.term)
"""

_P6 = """
WITH once AS (SELECT memory_id, max(content) AS content, max(realm) AS realm FROM recall_hit WHERE memory_id IS NOT NULL GROUP BY 1),
t AS (SELECT DISTINCT memory_id, realm, unnest(regexp_extract_all(lower(content), '[\\p{L}\\p{N}]{2,}')) AS term FROM once WHERE realm IS NOT NULL),
n AS (SELECT memory_id, count(*) AS n FROM t GROUP BY 1),
shared AS (SELECT x.memory_id AS a, y.memory_id AS b, count(*) AS i FROM t x JOIN t y ON x.realm = y.realm AND x.term = y.term AND x.memory_id < y.memory_id GROUP BY 1, 2)
SELECT a AS memory_a, b AS memory_b FROM shared JOIN n p ON p.memory_id = a JOIN n q ON q.memory_id = b WHERE i / (p.n + q.n - i) >= 0.6 - 1e-12
"""

_P2 = """
WITH v AS (
  SELECT memory_id, any_value(embedding)::DOUBLE[] AS e FROM content_op
  WHERE memory_id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY 1),
u AS (SELECT memory_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS u FROM v),
near AS (
  SELECT x.memory_id AS a, y.memory_id AS b, list_dot_product(x.u, y.u) AS s FROM u x JOIN u y ON x.memory_id <> y.memory_id AND list_dot_product(x.u, y.u) >= 0.9
  QUALIFY row_number() OVER (PARTITION BY x.memory_id ORDER BY list_dot_product(x.u, y.u) DESC, y.memory_id) <= 5)
SELECT DISTINCT least(a, b) AS memory_a, greatest(a, b) AS memory_b FROM near
"""

_P6_GROUPS = """
WITH RECURSIVE once AS (SELECT memory_id, max(content) AS content, max(realm) AS realm FROM recall_hit WHERE memory_id IS NOT NULL GROUP BY 1),
k AS (SELECT memory_id, realm, list_sort(list_distinct(regexp_extract_all(lower(content), '[\\p{L}\\p{N}]{2,}'))) AS t FROM once WHERE realm IS NOT NULL),
cls AS (SELECT memory_id, realm, t, min(memory_id) OVER (PARTITION BY realm, t) AS rep FROM k WHERE len(t) > 0),
r AS (SELECT DISTINCT rep, realm, t FROM cls),
links AS (SELECT x.rep AS a, y.rep AS b FROM r x JOIN r y ON x.realm = y.realm AND x.rep <> y.rep AND len(list_intersect(x.t, y.t)) / (len(x.t) + len(y.t) - len(list_intersect(x.t, y.t))) >= 0.6 - 1e-12),
reach AS (SELECT rep AS a, rep AS b FROM r UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT memory_id, (SELECT min(b) FROM reach WHERE reach.a = cls.rep) AS group_id, (SELECT count(*) FROM links WHERE links.a = cls.rep) AS n_links FROM cls
"""

QUERIES = {f.__name__: f for f in (p1_found, p1_ranking, p2_found, p2_neighbours, p4_found, p4_weights, p6_found, p6_groups, p8_ids, p8_decoded, p9_pack, p9_fill, p10_found, p10_shares)}
SQL = {
    "p1_found": _P1 + "SELECT query_id, memory_id FROM fused QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, memory_id) = 1",
    "p1_ranking": _P1 + "SELECT * REPLACE (round(rrf, 9) AS rrf), CAST(row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, memory_id) AS INTEGER) AS position FROM fused",
    "p2_found": _P2,
    "p4_found": _P4 + "SELECT memory_id, term FROM weights WHERE tf >= 3 AND df <= 5",
    "p4_weights": _P4 + "SELECT * REPLACE (round(weight, 6) AS weight) FROM weights",
    "p6_found": _P6,
    "p6_groups": _P6_GROUPS,
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
