"""How characteristic a term is of a record, by log-entropy weighting (problem 4).

weight = ln(1 + tf) * (1 - H / ln N), where H is the entropy of the term's
spread over records. Two aggregations give everything: (record, term) -> tf, and
term -> sum tf, sum tf ln tf, count, since H = ln gf - sum(tf ln tf) / gf.

Defined results: records with null id are ignored; null, empty and termless
contents give no rows; with one record the global factor is 1; repeated rows of
a record count once (its greatest content); an empty table gives no rows. Other
columns are dropped.
"""

from __future__ import annotations

from math import log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.functions.text import terms
from recollect.storage import materialize


def records(rows: DataFrame, record: str = "memory_id", content: str = "content") -> DataFrame:
    """One row per record; of its repeats the greatest content, so a present one beats an empty one."""
    return rows.where(F.col(record).isNotNull()).groupBy(record).agg(F.max(content).alias(content))


def postings(once: DataFrame, record: str = "memory_id", content: str = "content") -> DataFrame:
    """(record, term, tf); the aggregation keeps the records' partitioning and needs no shuffle."""
    return once.select(record, F.explode(terms(F.col(content))).alias("term")).groupBy(record, "term").agg(F.count(F.lit(1)).alias("tf"))


def least_weight(tf: int, df: int, n: int) -> float:
    """The weight no (record, term) with ``tf`` or more uses in at most ``df`` of ``n`` records falls below.

    The entropy of a term in df records is at most ln df, so its global factor is
    at least 1 - ln df / ln n: a threshold on the weight that loses no such term.
    """
    return log(1 + tf) * max(1.0 - log(df) / log(n), 0.0) if n > 1 else log(1 + tf)


def characteristic(rows: DataFrame, tf: int, df: int, record: str = "memory_id", content: str = "content") -> DataFrame:
    """(record, term, tf, df, weight) of terms used ``tf`` times or more and in at most ``df`` records.

    The weight selects; the counts are the exact check of what it lets through.
    """
    post = materialize(postings(records(rows, record, content), record, content), "postings")
    n = post.select(record).distinct().count()
    weighted = _weighted(post, n, record)
    heavy = weighted.where(F.col("weight") >= least_weight(tf, df, n) - 1e-9)
    return heavy.where((F.col("tf") >= tf) & (F.col("df") <= df))


def log_entropy(rows: DataFrame, record: str = "memory_id", content: str = "content") -> DataFrame:
    """(record, term, tf, df, weight) of every term of every record.

    The term statistics are pre-aggregated map-side; the join back is keyed by
    term, unique on one side, so adaptive execution splits a common term.
    """
    post = materialize(postings(records(rows, record, content), record, content), "postings")
    return _weighted(post, post.select(record).distinct().count(), record)


def _weighted(post: DataFrame, n: int, record: str) -> DataFrame:
    tf = F.col("tf").cast("double")
    stats = post.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum(tf).alias("_gf"), F.sum(tf * F.log(tf)).alias("_s"))
    entropy = F.log("_gf") - F.col("_s") / F.col("_gf")
    share = F.lit(1.0) - entropy / F.log(F.lit(float(n))) if n > 1 else F.lit(1.0)
    stats = stats.select("term", "df", F.greatest(share, F.lit(0.0)).alias("_share"))
    return post.join(stats, "term").select(record, "term", "tf", "df", (F.log1p(tf) * F.col("_share")).alias("weight"))
