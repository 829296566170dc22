"""Validity history of changing attributes, by affected-chain rebuild (problem 3).

The store keeps the last record of every fact id, the id's entity, and the
chain of versions of every entity (subject, predicate). A batch of late or
corrected records touches some entities: only their records are fetched, all
their intervals built anew, and their chains replaced in one manifest commit.

Defined results: rows with null id, subject, predicate, object or start are
ignored, as are blank ones; an end of 0 or null is open; a set end not after the
start makes the row void; repeated rows change nothing; of equal ids the last
recorded counts (ties: the greatest row); an empty feed gives an empty history.
Extra columns of the input are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollect.operators.bucket_store import BucketStore
from recollect.operators.ordering import HOT_ROWS, block_of, hot_bounds
from recollect.storage import materialize

OPEN = 2**63 - 1
ENTITY = ["subject", "predicate"]
FACT = "subject string, predicate string, object string, id bigint, valid_from_ms bigint, valid_to_ms bigint, recorded_at timestamp_ntz"
VERSION = "subject string, predicate string, object string, valid_from_ms bigint, valid_to_ms bigint"


def last_records(changes: DataFrame) -> DataFrame:
    """One row per id, the last recorded; entities trimmed and in lower case, pre-aggregated map-side."""
    clean = changes.where(F.col("id").isNotNull()).select(
        "id",
        F.struct(
            F.col("recorded_at").cast("timestamp_ntz").alias("recorded_at"),
            F.col("valid_from_ms"),
            F.nullif(F.col("valid_to_ms"), F.lit(0)).alias("valid_to_ms"),
            F.lower(F.trim("subject")).alias("subject"),
            F.lower(F.trim("predicate")).alias("predicate"),
            F.col("object"),
        ).alias("r"),
    )
    return clean.groupBy("id").agg(F.max("r").alias("r")).select("id", "r.*")


def usable(facts: DataFrame) -> DataFrame:
    """Rows that say something: all fields present, end open or after the start."""
    present = [F.length(F.trim(c)) > 0 for c in ("subject", "predicate", "object")]
    facts = facts.withColumn("valid_to_ms", F.nullif("valid_to_ms", F.lit(0)))
    return facts.where(present[0] & present[1] & present[2] & F.col("valid_from_ms").isNotNull() & (F.col("valid_to_ms").isNull() | (F.col("valid_to_ms") > F.col("valid_from_ms"))))


def build_chains(facts: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Versions of each entity from the last records of its facts.

    The fact with the latest start decides; each therefore holds until the next
    start or its own end. Neighbouring segments of one object join. One shuffle
    by entity; an entity above ``hot_rows`` is cut into blocks of starts.
    """
    one = usable(facts).groupBy(*ENTITY, "valid_from_ms").agg(F.max(F.struct("id", "object", F.coalesce("valid_to_ms", F.lit(OPEN)).alias("stop"))).alias("r"))
    one = one.select(*ENTITY, "valid_from_ms", "r.object", "r.stop")
    bounds = hot_bounds(one, ENTITY, "valid_from_ms", hot_rows)
    if bounds is None:
        keys, blocks = ENTITY, None
    else:
        one = one.join(F.broadcast(bounds), ENTITY, "left").withColumn("blk", block_of(F.col("valid_from_ms"), F.col("_bounds"))).drop("_bounds")
        keys = [*ENTITY, "blk"]
        blocks = Window.partitionBy(*ENTITY).orderBy("blk")
    within = Window.partitionBy(*keys).orderBy("valid_from_ms")

    after = F.lead("valid_from_ms").over(within)
    if blocks is not None:
        firsts = one.groupBy(*keys).agg(F.min("valid_from_ms").alias("first")).select(*keys, F.lead("first").over(blocks).alias("carry"))
        one = one.join(firsts, keys)
        after = F.coalesce(after, "carry")
    segments = one.withColumn("stop", F.least("stop", F.coalesce(after, F.lit(OPEN)))).drop("carry")

    before = F.lag(F.struct("stop", "object")).over(within)
    if blocks is not None:
        lasts = segments.groupBy(*keys).agg(F.max_by(F.struct("stop", "object"), "valid_from_ms").alias("l")).select(*keys, F.lag("l").over(blocks).alias("carry"))
        segments = segments.join(lasts, keys)
        before = F.coalesce(before, "carry")
    same = before.isNotNull() & (before["stop"] == F.col("valid_from_ms")) & (before["object"] == F.col("object"))
    starts = segments.withColumn("begin", F.when(~F.coalesce(same, F.lit(False)), F.col("valid_from_ms"))).drop("carry")

    begin = F.last("begin", ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, 0))
    if blocks is not None:
        carried = starts.groupBy(*keys).agg(F.max("begin").alias("b")).select(*keys, F.max("b").over(blocks.rowsBetween(Window.unboundedPreceding, -1)).alias("carry"))
        starts = starts.join(carried, keys)
        begin = F.coalesce(begin, "carry")
    return (
        starts.withColumn("island", begin)
        .groupBy(*ENTITY, "island")
        .agg(F.max("stop").alias("stop"), F.min("object").alias("object"))
        .select(*ENTITY, "object", F.col("island").alias("valid_from_ms"), F.when(F.col("stop") == OPEN, F.lit(0)).otherwise(F.col("stop")).cast("long").alias("valid_to_ms"))
    )


class HistoryTable:
    """History kept in a :class:`BucketStore`; ``apply`` takes batches in any order of delivery."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16, hot_rows: int = HOT_ROWS):
        parse = spark.createDataFrame
        schemas = {"facts": parse([], FACT).schema, "owner": parse([], "id bigint, subject string, predicate string").schema, "chains": parse([], VERSION).schema}
        self.store, self.hot_rows = BucketStore(spark, root, buckets, schemas, {"facts": ENTITY, "owner": ["id"], "chains": ENTITY}), hot_rows

    def versions(self) -> DataFrame:
        return self.store.read("chains")

    def apply(self, changes: DataFrame) -> int:
        """Fold one batch in; returns the committed version.

        Reads and rewrites the id buckets of the batch and the entity buckets
        touched, no others: at most one bucket of bounded size per changed row.
        """
        store = self.store
        news = materialize(last_records(changes), "history-news")
        store.expect(news.count())
        id_buckets = store.touched(news, "id")
        owner = store.read("owner", id_buckets)
        moved = owner.join(news.select("id"), "id")
        entities = materialize(news.select(*ENTITY).union(moved.select(*ENTITY)).distinct(), "history-entities")
        buckets = store.touched(entities, *ENTITY)

        old = store.read("facts", buckets)
        columns = ["id", "recorded_at", "valid_from_ms", "valid_to_ms", "subject", "predicate", "object"]
        touched_old = _semi(old, entities)
        untouched_old = _semi(old, entities, "left_anti")
        row = F.struct("recorded_at", "valid_from_ms", "valid_to_ms", "subject", "predicate", "object")
        merged = materialize(
            touched_old.select(*columns).unionByName(news.select(*columns)).groupBy("id").agg(F.max(row).alias("r")).select("id", "r.*"), "history-merged"
        )
        facts = store.stage("facts", untouched_old.select(*columns).unionByName(merged), *ENTITY)
        owners = store.stage("owner", owner.join(news, "id", "left_anti").unionByName(merged.join(news.select("id"), "id", "left_semi").select("id", *ENTITY)), "id")
        kept = _semi(store.read("chains", buckets), entities, "left_anti")
        chains = store.stage("chains", kept.unionByName(build_chains(merged, self.hot_rows)), *ENTITY)
        return store.commit({"facts": (buckets, facts), "owner": (id_buckets, owners), "chains": (buckets, chains)})


def _semi(rows: DataFrame, entities: DataFrame, how: str = "left_semi") -> DataFrame:
    e = entities.toDF("_s", "_p")
    return rows.join(e, rows["subject"].eqNullSafe(e["_s"]) & rows["predicate"].eqNullSafe(e["_p"]), how)
