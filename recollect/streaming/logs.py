"""Structured Streaming over the log: tail, counters, sessions, windows, credit, triggers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def tail(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1000) -> DataFrame:
    """A4: files that appear below a folder, each once; the checkpoint remembers what was read."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def transcript_tail(spark: SparkSession, path: str) -> DataFrame:
    """New transcript lines, each once."""
    return spark.readStream.option("recursiveFileLookup", "true").text(path)


def apply_batches(stream: DataFrame, apply: Callable[[DataFrame], object], checkpoint: str):
    """Hand each micro-batch to an idempotent apply (for one, a bucketed table's): exactly once in effect."""
    return stream.writeStream.foreachBatch(lambda batch, _: apply(batch) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, watermark: str = "10 minutes", window: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Counts and sums per window and type; rows later than the watermark are dropped."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    return events.withWatermark("ts", watermark).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", watermark: str = "1 hour") -> DataFrame:
    """I4: sessions that end when the gap passes without an event."""
    return events.withWatermark("ts", watermark).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def _credit(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    from recollect.operators.registries import BLEED, CREDIT_DECAY, GATE, IGNORE, MOST, STREAK

    credit, last, streak = state.get if state.exists else (0.0, 0, 0)
    rows = pd.concat(list(batches)).sort_values(["ts_ms", "id"])
    out = []
    for i, m, d in rows[["id", "magnitude", "dir"]].itertuples(index=False):
        if m <= IGNORE:
            continue
        credit = CREDIT_DECAY * credit + d * ((m - IGNORE) / (1 - IGNORE)) ** 2
        streak = min(streak + 1, 8) if d == last else 1
        last = int(d)
        if abs(credit) >= GATE and streak >= STREAK:
            delta = min(MOST, 0.02 + 0.06 * min(abs(credit) - GATE, 1.0)) * (1 if credit > 0 else -1)
            credit *= BLEED
            out.append((key[0], i, delta, credit))
    state.update((float(credit), int(last), int(streak)))
    yield pd.DataFrame(out, columns=["memory_id", "id", "delta", "credit"])


def surprise_credit(stream: DataFrame) -> DataFrame:
    """The credit fold with state per memory kept between batches."""
    return stream.groupBy("memory_id").applyInPandasWithState(_credit, "memory_id long, id long, delta double, credit double", "credit double, last int, streak int", "append", GroupStateTimeout.NoTimeout)


def _refute(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    support, against, refuted = state.get if state.exists else (0, 0, False)
    out = []
    for hit, turn in pd.concat(list(batches)).sort_values("turn")[["hit", "turn"]].itertuples(index=False):
        support, against = support + int(hit), against + int(not hit)
        ratio = against / (support + against)
        if not refuted and ratio > 0.4:
            refuted = True
            out.append((*key, turn, "refuted"))
        elif refuted and ratio < 0.2:
            refuted = False
            out.append((*key, turn, "live"))
    state.update((int(support), int(against), bool(refuted)))
    yield pd.DataFrame(out, columns=["a", "b", "turn", "status"])


def refutation_changes(stream: DataFrame) -> DataFrame:
    """Changes of status under hysteresis, per rule (a, b), from observations (a, b, turn, hit)."""
    return stream.groupBy("a", "b").applyInPandasWithState(_refute, "a string, b string, turn long, status string", "support long, against long, refuted boolean", "append", GroupStateTimeout.NoTimeout)


def matches(events: DataFrame, triggers: DataFrame) -> DataFrame:
    """Events that match an armed trigger's type; triggers are a registry, joined as they stand at each batch."""
    return events.join(triggers, "event_type").select("trigger_id", "event_id", "ts")


def drain(stream: DataFrame, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there and return its result, written to the shared folder.

    Appended rows go to a Parquet sink, which commits each batch once; a complete
    result replaces the one before it.
    """
    path = f"{checkpoint}-result"
    out = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        out = out.format("parquet").option("path", path)
    else:
        out = out.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path))
    out.start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
