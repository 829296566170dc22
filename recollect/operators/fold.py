"""Ordered folds of state changes (A3, A11, F28, I17): clamped steps that a plain sum cannot express."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.operators.changefeed import carry_clocks
from recollect.operators.ordering import HOT_ROWS, with_block


def fold_deltas(deltas: DataFrame, start: float = 0.5, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(memory_id, strength, applied): deltas in the order (clock, writer, number), each clamped to [0, 1].

    A missing clock is the writer's last one; of the deltas of one clock only the
    first applies (a later one is not later than the last applied), those without
    any clock all do, and repeats of (writer, number) count once.

    A run of clamped steps is itself one step x -> min(max(x + s, lo), hi), and
    such steps compose. A memory above ``hot_rows`` deltas is therefore cut into
    ranges of clocks, each folded to one step, and the steps are folded in order.
    """
    once = deltas.groupBy("instance_id", "seqno").agg(F.first("memory_id").alias("memory_id"), F.max("op_ts_ms").alias("clock"), F.max("strength_delta").alias("strength_delta"))
    eff = carry_clocks(once).select("memory_id", "eff", "instance_id", "seqno", "strength_delta")
    first = F.min(F.struct("instance_id", "seqno", "strength_delta")).alias("f")
    timed = eff.where("eff > 0").groupBy("memory_id", "eff").agg(first).select("memory_id", "eff", "f.*")
    rows = with_block(timed.unionByName(eff.where("eff <= 0")), ["memory_id"], "eff", hot_rows)
    lists = rows.groupBy("memory_id", "_blk").agg(F.array_sort(F.collect_list(F.struct("eff", "instance_id", "seqno", "strength_delta"))).alias("ops"))
    still = F.struct(F.lit(0.0).alias("s"), F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"), F.lit(0).cast("long").alias("n"))

    def within(x, low, high):
        return F.least(F.greatest(x, low), high)

    def then(a, s, low, high, n):
        return F.struct((a["s"] + s).alias("s"), within(a["lo"] + s, low, high).alias("lo"), within(a["hi"] + s, low, high).alias("hi"), (a["n"] + n).alias("n"))

    zero, one = F.lit(0.0), F.lit(1.0)
    steps = lists.select("memory_id", "_blk", F.aggregate("ops", still, lambda a, o: then(a, o["strength_delta"], zero, one, F.lit(1))).alias("f"))
    chains = steps.groupBy("memory_id").agg(F.array_sort(F.collect_list(F.struct("_blk", "f"))).alias("fs"))  # one entry a range
    whole = chains.select("memory_id", F.aggregate("fs", still, lambda a, x: then(a, x["f"]["s"], x["f"]["lo"], x["f"]["hi"], x["f"]["n"])).alias("r"))
    return whole.select("memory_id", within(F.lit(start) + F.col("r.s"), F.col("r.lo"), F.col("r.hi")).alias("strength"), F.col("r.n").alias("applied"))


def coverage(ops: DataFrame) -> DataFrame:
    """Greatest number seen of each writer."""
    return ops.groupBy("instance_id").agg(F.max("seqno").alias("covered"))


def uncovered(ops: DataFrame, covered: DataFrame) -> DataFrame:
    """Operations not covered yet; covered segments are pruned."""
    return ops.join(F.broadcast(covered), "instance_id", "left").where(F.col("covered").isNull() | (F.col("seqno") > F.col("covered"))).drop("covered")  # one row a writer
