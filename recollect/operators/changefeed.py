"""Present state of a table from a change feed, by bucketed copy-on-write (problem 7).

The feed delivers operations repeatedly, late and out of order. The store holds
the operations once each, bucketed by the key they change, the state, bucketed by
key, and the clocks, bucketed by block: a writer's numbers are cut into blocks of
``CLOCK_BLOCK``, with one row per block for the clock it passes on. A batch routes
its changes to buckets, merges only those, writes replacement files and commits a
manifest. A late clock may move operations applied earlier: their blocks and
buckets are then touched as well, and no others, however long a writer's past.

The state of a key needs no ordered fold. With P, D and S the last put, delete
and content-setting operation (a put, or an update with content) in the order
(clock, writer, number), the key lives iff P > D, and S then holds its content:
an update after P finds the key alive, one before P is overwritten by it. Three
maxima, pre-aggregated map-side, so that a key with a third of all rows is no
burden.

Defined results: operations with null writer, number or key are ignored; a clock
of 0, null or below counts as missing; before a writer's first known clock the
clock is 0; copies of one operation count once, with the greatest clock and
content any copy carries; an empty feed gives an empty state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollect.operators.bucket_store import BucketStore
from recollect.storage import materialize

CLOCK_BLOCK = 8192
BLOCK_KEY = ["instance_id", "blk"]
OP = "instance_id bigint, seqno bigint, op_type string, memory_id bigint, has_content boolean, content string, clock bigint"


def distinct_operations(feed: DataFrame) -> DataFrame:
    """One row per (instance_id, seqno) with the clock any copy carries (null if none); ``blk`` is its block of numbers."""
    rows = feed.where(F.col("instance_id").isNotNull() & F.col("seqno").isNotNull() & F.col("memory_id").isNotNull())
    has = F.col("has_content") if "has_content" in feed.columns else F.col("content").isNotNull()
    rows = rows.select("instance_id", "seqno", "op_type", "memory_id", has.alias("has_content"), "content", F.when(F.col("op_ts_ms") > 0, F.col("op_ts_ms")).alias("clock"))
    rows = rows.withColumn("blk", F.floor(F.col("seqno") / CLOCK_BLOCK))
    once = rows.repartition(*BLOCK_KEY).groupBy(*BLOCK_KEY, "seqno")
    return once.agg(F.max("op_type").alias("op_type"), F.max("memory_id").alias("memory_id"), F.max("has_content").alias("has_content"), F.max("content").alias("content"), F.max("clock").alias("clock"))


def block_ends(ops: DataFrame) -> DataFrame:
    """(instance_id, blk, last, gap) per block: its last clock, and whether operations before its first clock need an earlier one."""
    at = F.when(F.col("clock").isNotNull(), F.col("seqno"))
    ends = ops.groupBy("instance_id", "blk").agg(F.max_by("clock", at).alias("last"), F.min("seqno").alias("_lo"), F.min(at).alias("_first"))
    return ends.select("instance_id", "blk", "last", (F.col("_first").isNull() | (F.col("_first") > F.col("_lo"))).alias("gap"))


def arriving(ends: DataFrame) -> DataFrame:
    """(instance_id, blk, gap, carry): the clock that comes into each block from the blocks before; one row per block is sorted."""
    over = Window.partitionBy("instance_id").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    return ends.select("instance_id", "blk", "gap", F.last("last", ignorenulls=True).over(over).alias("carry"))


def carried(ops: DataFrame, carry: DataFrame) -> DataFrame:
    """Add ``eff``: the clock, or the nearest earlier one of the block, or what comes into the block, else 0."""
    within = Window.partitionBy(*BLOCK_KEY).orderBy("seqno").rowsBetween(Window.unboundedPreceding, 0)
    filled = ops.withColumn("_own", F.last("clock", ignorenulls=True).over(within)).join(carry.select(*BLOCK_KEY, "carry"), BLOCK_KEY)
    return filled.withColumn("eff", F.coalesce("_own", "carry", F.lit(0).cast("long"))).drop("_own", "carry")


def carry_clocks(ops: DataFrame) -> DataFrame:
    """Add ``eff`` to a whole set of operations; writers are cut into blocks, so none runs in one task."""
    ops = ops.withColumn("blk", F.floor(F.col("seqno") / CLOCK_BLOCK))
    return carried(ops, arriving(block_ends(ops))).drop("blk")


def fold_state(ops: DataFrame) -> DataFrame:
    """(memory_id, instance_id, seqno, content) of each key alive, from operations with ``eff``."""
    order = [F.col("eff"), F.col("instance_id"), F.col("seqno")]

    def last(kind: Column, *more: str) -> Column:
        return F.max(F.when(kind, F.struct(*order, *more)))

    put, delete = F.col("op_type") == "PutPayload", F.col("op_type") == "DeleteMemory"
    sets = put | ((F.col("op_type") == "UpdateMemoryContent") & F.col("has_content"))
    state = ops.groupBy("memory_id").agg(last(put).alias("p"), last(delete).alias("d"), last(sets, "content").alias("s"))
    alive = state.where(F.col("p").isNotNull() & (F.col("d").isNull() | (F.col("p") > F.col("d"))))
    return alive.select("memory_id", F.col("s.instance_id").alias("instance_id"), F.col("s.seqno").alias("seqno"), F.col("s.content").alias("content"))


class ChangedTable:
    """Current state under a feed; ``apply`` takes batches in any order of delivery."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16):
        schema = lambda ddl: spark.createDataFrame([], ddl).schema
        schemas = {
            "ops": schema(OP + ", eff bigint"),
            "clocks": schema("instance_id bigint, blk bigint, seqno bigint, memory_id bigint, clock bigint, eff bigint"),
            "ends": schema("instance_id bigint, blk bigint, last bigint, gap boolean"),
            "state": schema("memory_id bigint, instance_id bigint, seqno bigint, content string"),
        }
        keys = {"ops": ["memory_id"], "clocks": BLOCK_KEY, "ends": ["instance_id"], "state": ["memory_id"]}
        self.store = BucketStore(spark, root, buckets, schemas, keys)

    def state(self) -> DataFrame:
        return self.store.read("state")

    def _clocks(self, news: DataFrame) -> tuple[DataFrame, dict]:
        """(instance_id, seqno, memory_id, eff, was) of every operation whose clock may differ, and what to commit.

        Read are the blocks of ``CLOCK_BLOCK`` numbers that the batch names, one
        row for each block of their writers, and those later blocks that begin
        without a clock and to which another one now arrives.
        """
        store = self.store
        blocks = materialize(news.select(*BLOCK_KEY).distinct(), "feed-blocks")
        writers, own = store.touched(blocks, "instance_id"), store.touched(blocks, *BLOCK_KEY)
        known = store.read("clocks", own)
        both = known.join(blocks, BLOCK_KEY, "left_semi").select(*BLOCK_KEY, "seqno", "memory_id", "clock", F.col("eff").alias("was"))
        both = both.unionByName(news.select(*BLOCK_KEY, "seqno", "memory_id", "clock", F.lit(None).cast("long").alias("was")))
        merged = both.repartition(*BLOCK_KEY).groupBy(*BLOCK_KEY, "seqno").agg(F.max("memory_id").alias("memory_id"), F.max("clock").alias("clock"), F.max("was").alias("was"))
        merged = materialize(merged, "feed-merged")

        old_ends = store.read("ends", writers)
        ends = materialize(old_ends.join(blocks, BLOCK_KEY, "left_anti").unionByName(block_ends(merged)), "feed-ends")
        carry = arriving(ends).select(*BLOCK_KEY, "gap", "carry")
        moved = carry.join(arriving(old_ends).select(*BLOCK_KEY, F.col("carry").alias("before")), BLOCK_KEY).where(F.col("gap") & ~F.col("carry").eqNullSafe(F.col("before")))
        later = materialize(moved.select(*BLOCK_KEY).join(blocks, BLOCK_KEY, "left_anti"), "feed-later")
        more = store.touched(later, *BLOCK_KEY)
        every = merged
        if more:
            again = store.read("clocks", more).join(later, BLOCK_KEY, "left_semi")
            every = merged.unionByName(again.select(*BLOCK_KEY, "seqno", "memory_id", "clock", F.col("eff").alias("was")))
        clocks = materialize(carried(every, carry), "feed-clocks")

        touched = sorted({*own, *more})
        kept = store.read("clocks", touched).join(blocks.unionByName(later), BLOCK_KEY, "left_anti")
        names = [f.name for f in store.schemas["clocks"].fields]
        staged = store.stage("clocks", kept.select(*names).unionByName(clocks.select(*names)), *BLOCK_KEY)
        return clocks, {"clocks": (touched, staged), "ends": (writers, store.stage("ends", ends, "instance_id"))}

    def apply(self, feed: DataFrame) -> int:
        """Merge one batch into the buckets it touches; returns the committed version."""
        store = self.store
        news = materialize(distinct_operations(feed), "feed-news")
        store.expect(news.count())
        clocks, commit = self._clocks(news)
        late = F.col("was").isNull() | (F.col("was") != F.col("eff"))
        buckets = store.touched(clocks.where(late).select("memory_id").union(news.select("memory_id")), "memory_id")

        old = store.read("ops", buckets).alias("o").join(clocks.where(late).select("instance_id", "seqno", "eff").alias("m"), ["instance_id", "seqno"], "left")
        names = [f.name for f in store.schemas["ops"].fields]
        old = old.select(*[F.coalesce("m.eff", "o.eff").alias("eff") if n == "eff" else n if n in ("instance_id", "seqno") else F.col(f"o.{n}").alias(n) for n in names])
        rows = old.unionByName(news.join(clocks.select("instance_id", "seqno", "eff"), ["instance_id", "seqno"]).select(*names))
        if store.version:  # an operation may come again in a later batch
            once = rows.groupBy("instance_id", "seqno")
            rows = once.agg(*[F.max(n).alias(n) for n in names if n not in ("instance_id", "seqno")])
        ops = store.stage("ops", rows, "memory_id")
        fresh = store.spark.read.schema(store.schemas["ops"]).parquet(*ops.values()) if ops else rows.limit(0)
        state = store.stage("state", fold_state(fresh), "memory_id")
        return store.commit(commit | {"ops": (buckets, ops), "state": (buckets, state)})
