"""Hash-bucketed tables replaced bucket by bucket under a versioned manifest.

A store is a folder with files of immutable Parquet per (table, bucket) and
``manifest-<n>.json`` naming those of version n. A change reads and rewrites
only the buckets it touches, then commits by creating the next manifest with an
atomic rename: readers see the old version or the new one, never a mixture, and
a job lost half-way leaves the old version in force.

A bucket is meant to hold about ``BUCKET_ROWS`` rows, so what a change rewrites is
bounded by the keys it names, not by the table: the number of buckets, a power of
two kept in the manifest, follows the rows written, and a table that has outgrown
it four times over is bucketed anew.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recollect import storage


BUCKET_ROWS = 250_000


class ConcurrentCommit(RuntimeError):
    """Another writer committed the next version first; read again and retry."""


class BucketStore:
    """Tables bucketed by ``pmod(xxhash64(key), buckets)``; ``keys`` names the key columns of each table."""

    def __init__(self, spark: SparkSession, root: str, buckets: int, schemas: dict[str, T.StructType], keys: dict[str, list[str]] | None = None):
        self.spark, self.root, self.least, self.schemas, self.keys = spark, root, buckets, schemas, keys or {}
        self._rows = 0

    @property
    def buckets(self) -> int:
        """Number of buckets of the committed version; of the version to come while there is none."""
        version, _, meta = self._manifest()
        return meta["buckets"] if version else self._wanted(self._rows)

    def _wanted(self, rows: int) -> int:
        want = self.least
        while want * BUCKET_ROWS < rows:
            want *= 2
        return want

    def expect(self, rows: int) -> None:
        """Say that ``rows`` more rows are about to be written, before buckets are asked for."""
        version, tables, meta = self._manifest()
        self._rows = meta["rows"] + rows
        want = self._wanted(self._rows)
        if version and want > 4 * meta["buckets"]:
            everything = {t: self.read(t) for t in self.schemas}
            staged = {t: (list(range(meta["buckets"])), self.stage(t, df, *self.keys[t], buckets=want)) for t, df in everything.items()}
            self.commit(staged, buckets=want)

    def bucket(self, *keys, buckets: int | None = None):
        return F.pmod(F.xxhash64(*keys), F.lit(buckets or self.buckets)).cast("int")

    def _manifest(self) -> tuple[int, dict[str, dict[str, str]], dict[str, int]]:
        versions = self._versions()
        if not versions:
            return 0, {t: {} for t in self.schemas}, {"buckets": self.least, "rows": 0}
        found = json.loads(storage.read_text(self.spark, f"{self.root}/manifest-{max(versions)}.json"))
        return max(versions), found["tables"], found["meta"]

    def _versions(self) -> list[int]:
        return [int(n[9:-5]) for n in storage.list_names(self.spark, self.root) if n.startswith("manifest-") and n.endswith(".json")]

    @property
    def version(self) -> int:
        return self._manifest()[0]

    def files(self, table: str) -> dict[str, str]:
        """bucket -> folder of the committed version."""
        return self._manifest()[1].get(table, {})

    def read(self, table: str, buckets: list[int] | None = None) -> DataFrame:
        """Rows of ``table`` in the given buckets (default all) of the committed version."""
        wanted = None if buckets is None else set(buckets)
        paths = [p for b, p in self.files(table).items() if wanted is None or int(b) in wanted]
        if not paths:
            return self.spark.createDataFrame([], self.schemas[table])
        return self.spark.read.schema(self.schemas[table]).parquet(*paths)

    def touched(self, df: DataFrame, *keys) -> list[int]:
        """Buckets that rows of ``df`` fall into: at most ``buckets`` numbers."""
        return sorted(r[0] for r in df.select(self.bucket(*keys)).distinct().collect())

    def stage(self, table: str, df: DataFrame, *keys, buckets: int | None = None) -> dict[str, str]:
        """Write replacement files, not yet visible; bucket -> path.

        The rebalance hint lets adaptive execution split a bucket that one hot
        key makes large over several tasks and files.
        """
        folder = f"{self.root}/{table}/{uuid.uuid4().hex}"
        columns = [F.col(c.name).cast(c.dataType) for c in self.schemas[table].fields]
        df.select(*columns, self.bucket(*keys, buckets=buckets).alias("bkt")).hint("rebalance", "bkt").write.partitionBy("bkt").parquet(folder)
        return {n[4:]: f"{folder}/{n}" for n in storage.list_names(self.spark, folder) if n.startswith("bkt=")}

    def commit(self, replaced: dict[str, tuple[list[int], dict[str, str]]], buckets: int | None = None) -> int:
        """Make staged files current: per table the buckets replaced and their new paths."""
        version, tables, meta = self._manifest()
        meta = {"buckets": buckets or (meta["buckets"] if version else self.buckets), "rows": max(self._rows, meta["rows"])}
        for table, (touched, paths) in replaced.items():
            gone = set(touched)
            tables[table] = {b: p for b, p in tables.get(table, {}).items() if int(b) not in gone} | paths
        if not storage.write_text(self.spark, f"{self.root}/manifest-{version + 1}.json", json.dumps({"tables": tables, "meta": meta})):
            raise ConcurrentCommit(f"version {version + 1} of {self.root} exists")
        return version + 1

    def vacuum(self, keep: int = 2) -> int:
        """Delete what only versions before the last ``keep`` name; returns the folders deleted.

        Not to be run while a reader still uses one of those versions or a writer
        has staged files it has not committed.
        """
        versions = sorted(self._versions())
        kept = versions[-keep:]
        named = {p for v in kept for t in json.loads(storage.read_text(self.spark, f"{self.root}/manifest-{v}.json"))["tables"].values() for p in t.values()}
        deleted = 0
        for table in self.schemas:
            for batch in storage.list_names(self.spark, f"{self.root}/{table}"):
                folder = f"{self.root}/{table}/{batch}"
                parts = [f"{folder}/{n}" for n in storage.list_names(self.spark, folder) if n.startswith("bkt=")]
                for part in [folder] if not named & set(parts) else [p for p in parts if p not in named]:
                    storage.delete(self.spark, part)
                    deleted += 1
        for v in versions[:-keep]:
            storage.delete(self.spark, f"{self.root}/manifest-{v}.json")
        return deleted
