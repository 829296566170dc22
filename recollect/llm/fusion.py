"""One ranking from several differently scaled scores, by reciprocal rank fusion (problem 1).

Each score only gives ranks inside its query; an item's fused value is the sum
of 1/(k + rank), so no range or distribution can dominate.

Defined results: null and NaN scores share the rank after all present ones;
equal scores share the better rank; repeated rows of an item count once with
its greatest scores; rows without query or item are ignored; ties of the fused
value go to the smaller item id; an empty table gives no rows. Other columns of
the input are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.operators.ordering import HOT_ROWS, SPLITS, block_of, hot_bounds, ordered

RRF_K = 60


def _once(hits: DataFrame, query: str, item: str, scores: list[str]) -> DataFrame:
    rows = hits.where(F.col(query).isNotNull() & F.col(item).isNotNull())
    present = [F.max(F.nanvl(F.col(s).cast("double"), F.lit(None).cast("double"))).alias(s) for s in scores]
    return rows.groupBy(query, item).agg(*present)


def _hot_rank(rows: DataFrame, query: str, item: str, score: str, splits: int) -> DataFrame:
    """Rank in queries too large for one task: value ranges are ranked apart, counts of higher ranges added.

    A value that fills a range bound forms a group of its own, in which all rows
    share one rank; such groups and missing values are never sorted, so no mass
    of ties ends in one task.
    """
    bounds = hot_bounds(rows.where(F.col(score).isNotNull()), [query], score, 0, splits)
    if bounds is None:
        return rows.withColumn(f"{score}_rank", F.lit(1))
    rows = rows.join(F.broadcast(bounds), query, "left")
    at_bound = F.array_contains("_bounds", F.col(score))
    group = F.when(F.col(score).isNull(), -1).otherwise(2 * block_of(F.col(score), F.col("_bounds")) + F.coalesce(at_bound, F.lit(False)).cast("int"))
    rows = rows.withColumn("_g", group).drop("_bounds")
    counts = rows.groupBy(query, "_g").agg(F.count(F.lit(1)).alias("_n"))
    higher = F.sum("_n").over(Window.partitionBy(query).orderBy(F.col("_g").desc()).rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.join(F.broadcast(counts.select(query, "_g", F.coalesce(higher, F.lit(0)).alias("_above"))), [query, "_g"])
    shared = F.col("_g") % 2 != 0
    salt = F.when(shared, F.pmod(F.xxhash64(item), F.lit(splits))).otherwise(0)
    inside = F.rank().over(Window.partitionBy(query, "_g", "_salt").orderBy(F.col(score).desc()))
    return rows.withColumn("_salt", salt).withColumn(f"{score}_rank", (F.when(shared, F.lit(1)).otherwise(inside) + F.col("_above")).cast("int")).drop("_g", "_above", "_salt")


def fuse(hits: DataFrame, query: str, item: str, scores: list[str], k: int = RRF_K, hot_rows: int = HOT_ROWS, splits: int = SPLITS) -> DataFrame:
    """(query, item, one rank per score, rrf) of every distinct hit.

    One shuffle by (query, item) with map-side combine and one by query; only
    queries above ``hot_rows`` hits take the route by value ranges.
    """
    rows = _once(hits, query, item, scores)
    hot = rows.groupBy(query).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows).select(query)
    hot_keys = [r[0] for r in hot.collect()]  # at most rows / hot_rows
    total: Column = sum((F.lit(1.0) / (F.lit(float(k)) + F.col(f"{s}_rank")) for s in scores), F.lit(0.0))
    out = [query, item, *[f"{s}_rank" for s in scores]]

    def plain(part: DataFrame) -> DataFrame:
        for s in scores:
            part = part.withColumn(f"{s}_rank", F.rank().over(Window.partitionBy(query).orderBy(F.col(s).desc_nulls_last())))
        return part.select(*out)

    if not hot_keys:
        return plain(rows).withColumn("rrf", total)
    keys = F.broadcast(rows.sparkSession.createDataFrame([(h,) for h in hot_keys], hot.schema))
    large = rows.join(keys, query, "left_semi")
    for s in scores:
        large = _hot_rank(large, query, item, s, splits)
    return plain(rows.join(keys, query, "left_anti")).unionByName(large.select(*out)).withColumn("rrf", total)


def positions(fused: DataFrame, query: str, item: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add ``position``, 1 for the first of each query; ties go to the smaller item."""
    rows = fused.withColumn("_minus", -F.col("rrf"))
    return ordered(rows, [query], ["_minus", item], number="position", hot_rows=hot_rows).drop("_minus")


def best(fused: DataFrame, query: str, item: str) -> DataFrame:
    """The first item of each query, by a pre-aggregated maximum."""
    return fused.groupBy(query).agg(F.max(F.struct("rrf", (-F.col(item)).alias("_m"))).alias("_b")).select(query, (-F.col("_b._m")).alias(item))
