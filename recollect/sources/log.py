"""The operation log and its neighbours as files (A1-A25): append, verify, prune, import, export, snapshots."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollect import storage
from recollect.operators.fold import coverage, uncovered

CHAIN_BLOCK = 4096


def append(ops: DataFrame, path: str) -> None:
    """A1, A2: add operations to the log, one folder per writer; the file commit makes them durable together."""
    ops.write.mode("append").partitionBy("instance_id").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The whole log; columns added later read as null in older files."""
    return spark.read.option("mergeSchema", "true").parquet(path).withColumn("instance_id", F.col("instance_id").cast("long"))


def from_seqno(ops: DataFrame, seqno: int) -> DataFrame:
    """Operations from a number on as JSON, for other consumers."""
    return ops.where(F.col("seqno") >= seqno).select("instance_id", "seqno", F.to_json(F.struct(*sorted(ops.columns))).alias("json"))


def op_clock(columns: dict[str, str]) -> Column:
    """A10: logical clock of an operation, from the column its type keeps it in; 0 and null are no clock."""
    out = F.lit(None).cast("long")
    for kind, column in columns.items():
        out = F.when(F.col("op_type") == kind, F.when(F.col(column) > 0, F.col(column))).otherwise(out)
    return out


def chained(ops: DataFrame) -> DataFrame:
    """Add ``hash`` of each record and ``chain``, which also covers the record before it of the same writer.

    A chain over the hashes of neighbours, not over the whole past, can be
    checked in parallel and still shows a missing, altered or moved record.
    Writers are cut into blocks of numbers, the last hash of a block is carried
    over, so no writer runs in one task.
    """
    rows = ops.withColumn("hash", F.sha2(F.to_json(F.struct(*sorted(ops.columns))), 256)).withColumn("_blk", F.floor(F.col("seqno") / CHAIN_BLOCK))
    within = Window.partitionBy("instance_id", "_blk").orderBy("seqno")
    over = Window.partitionBy("instance_id").orderBy("_blk")
    carry = rows.groupBy("instance_id", "_blk").agg(F.max_by("hash", "seqno").alias("_l")).select("instance_id", "_blk", F.lag("_l").over(over).alias("_carry"))
    linked = rows.withColumn("_h", F.lag("hash").over(within)).join(carry, ["instance_id", "_blk"])
    return linked.withColumn("chain", F.sha2(F.concat_ws("", F.coalesce("_h", "_carry", F.lit("")), "hash"), 256)).drop("_blk", "_h", "_carry")


def broken(stored: DataFrame) -> DataFrame:
    """Records whose stored chain is not what their content and neighbour give."""
    again = chained(stored.drop("hash", "chain")).select("instance_id", "seqno", F.col("chain").alias("_c"))
    return stored.join(again, ["instance_id", "seqno"]).where(~F.col("chain").eqNullSafe(F.col("_c"))).select("instance_id", "seqno")


class DamagedLog(ValueError):
    """A log file holds a bad record that others follow."""


def complete_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a JSON-lines log; a bad last line of a file is a torn write and skipped.

    A bad line that others follow is damage, and raises :class:`DamagedLog`. Lines
    are told apart by file, block and place in the block; only one row per file
    that has a bad line reaches the driver's check.
    """
    rows = spark.read.schema(schema + ", _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    place = F.struct(F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    placed = storage.materialize(rows.select("*", F.col("_metadata.file_path").alias("_file"), place.alias("_at")), "log-lines")
    ends = placed.groupBy("_file").agg(F.max("_at").alias("end"), F.min(F.when(F.col("_bad").isNotNull(), F.col("_at"))).alias("bad"))
    damaged = ends.where(F.col("bad") < F.col("end")).select("_file").first()
    if damaged:
        raise DamagedLog(f"{damaged[0]} is damaged before its end")
    return placed.where(F.col("_bad").isNull()).drop("_bad", "_file", "_at")


def prune(ops: DataFrame, covered: DataFrame) -> DataFrame:
    """What a snapshot with this coverage does not hold yet."""
    return uncovered(ops, covered)


def sync(foreign: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New operations of other writers, and the coverage after taking them."""
    fresh = uncovered(foreign, coverage(known))
    return fresh, coverage(known.unionByName(fresh))


def save_snapshot(spark: SparkSession, tables: dict[str, DataFrame], root: str) -> int:
    """Write each table as Parquet, then commit by the next manifest; returns its version."""
    versions = [int(n[9:-5]) for n in storage.list_names(spark, root) if n.startswith("snapshot-")]
    version = max(versions, default=0) + 1
    for name, df in tables.items():
        df.write.parquet(f"{root}/v{version}/{name}")
    if not storage.write_text(spark, f"{root}/snapshot-{version}.json", json.dumps({"tables": sorted(tables), "folder": f"v{version}"})):
        raise RuntimeError(f"snapshot {version} of {root} exists")
    return version


def load_snapshot(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Tables of the last committed snapshot, also registered as views of their names."""
    versions = [int(n[9:-5]) for n in storage.list_names(spark, root) if n.startswith("snapshot-") and n.endswith(".json")]
    if not versions:
        return {}
    manifest = json.loads(storage.read_text(spark, f"{root}/snapshot-{max(versions)}.json"))
    out = {name: spark.read.parquet(f"{root}/{manifest['folder']}/{name}") for name in manifest["tables"]}
    for name, df in out.items():
        df.createOrReplaceTempView(name)
    return out


MEMORY_JSON = "id bigint, kind string, content string, confidence double, decay_rate double, created_at_ms bigint, accessed_at_ms bigint, realm string, embedding array<float>, pinned boolean"


def import_jsonl(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """Memories from JSON lines; a missing vector becomes zeros, a pinned memory does not decay."""
    rows = spark.read.schema(MEMORY_JSON).json(path)
    zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
    pinned = F.coalesce("pinned", F.lit(False))
    return rows.withColumns({"embedding": F.coalesce("embedding", zero), "embed_pending": F.col("embedding").isNull(), "pinned": pinned, "decay_rate": F.when(pinned, 0.0).otherwise(F.col("decay_rate"))})


#: Columns of an old relational store, in the names of the JSON lines.
RELATIONAL = {"id": "id", "type": "kind", "kind": "kind", "content": "content", "confidence": "confidence", "decay_rate": "decay_rate", "created_at": "created_at_ms", "accessed_at": "accessed_at_ms", "realm": "realm", "pinned": "pinned"}


def import_jdbc(spark: SparkSession, url: str, table: str, kinds: list[str] | None = None, **options: str) -> DataFrame:
    """Memories of a relational store, whichever of the known columns it has; the filter on kinds is pushed to it.

    Give ``partitionColumn``, ``lowerBound``, ``upperBound`` and ``numPartitions``
    as options to read a large table in parallel.
    """
    rows = spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
    rows = rows.select(*[F.col(c).alias(c.lower()) for c in rows.columns])
    known = {RELATIONAL[c]: c for c in rows.columns if c in RELATIONAL}
    if "id" not in known or "content" not in known:
        raise ValueError(f"{table} has no id or no content")
    out = rows.select(*[F.col(c).alias(name) for name, c in known.items()])
    return out if kinds is None else out.where(F.col("kind").isin(kinds))


def export_relational(spark: SparkSession, url: str, table: str, path: str, kinds: list[str] | None = None, **options: str) -> None:
    """Memories of a relational store as JSON lines that :func:`import_jsonl` reads."""
    import_jdbc(spark, url, table, kinds, **options).write.json(path)


def dump_graph(memory: DataFrame, triplets: DataFrame, root: str) -> None:
    """Live nodes and open edges as JSON lines."""
    memory.where(F.length(F.trim("content")) > 0).select("memory_id", "kind", "realm", "content").write.json(f"{root}/nodes")
    triplets.where("valid_to_ms = 0").select("subject", "predicate", "object", "weight").write.json(f"{root}/edges")


def save_vectors(vectors: DataFrame, path: str) -> None:
    """Vectors as a Parquet column of their own, so that scans of state never read them."""
    vectors.select("memory_id", F.col("embedding").cast("array<float>").alias("embedding")).write.parquet(path)


def load_vectors(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """The vectors of :func:`save_vectors` that have the given width; others are left out as damaged."""
    return spark.read.schema("memory_id long, embedding array<float>").parquet(path).where(F.size("embedding") == dim)


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Lines of all transcripts below a folder, with their file; see streaming.logs for the incremental reader."""
    return spark.read.option("recursiveFileLookup", "true").text(path).select(F.input_file_name().alias("file"), F.col("value").alias("line"))


def save_statistics(stats: DataFrame, path: str, ts_ms: int) -> None:
    """One dated JSON file set per snapshot of statistics."""
    stats.withColumn("ts", F.lit(ts_ms)).write.mode("append").partitionBy("ts").json(path)
