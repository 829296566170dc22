"""Filters, look-ups, upkeep and statistics of memories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions.scoring import age_days, effective_strength


def live(memory: DataFrame) -> DataFrame:
    """Rows with content; deleted ones keep metadata but lose it."""
    return memory.where(F.length(F.trim("content")) > 0)


def filtered(memory: DataFrame, now_ms: int, kind: str | None = None, realm: str | None = None, min_confidence: float = 0.0, min_strength: float = 0.0, limit: int = 100) -> DataFrame:
    """B1: all given conditions, by id."""
    out = memory.where(F.col("confidence") >= min_confidence).withColumn("effective_strength", effective_strength(now_ms)).where(F.col("effective_strength") >= min_strength)
    for name, value in (("kind", kind), ("realm", realm)):
        if value is not None:
            out = out.where(F.col(name) == value)
    return out.orderBy("memory_id").limit(limit)


def by_kind(memory: DataFrame, kind: str, limit: int) -> DataFrame:
    """B2: most confident of a kind."""
    return memory.where(F.col("kind") == kind).orderBy(F.col("confidence").desc(), "memory_id").limit(limit)


def listing(memory: DataFrame, tags: DataFrame, sort_by: str, limit: int, offset: int) -> DataFrame:
    """A page of memories with the sorted list of their tags, joined after the page is cut."""
    page = memory.orderBy(F.col(sort_by).desc(), "memory_id").offset(offset).limit(limit)
    tag = tags.groupBy("memory_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    return page.join(tag, "memory_id", "left").withColumn("tags", F.array_join(F.coalesce("tags", F.array().cast("array<string>")), ","))


def one(memory: DataFrame, memory_id: int) -> DataFrame:
    """Metadata, content and state of one memory; the key reaches the scan."""
    return live(memory).where(F.col("memory_id") == memory_id)


def realms(memory: DataFrame) -> DataFrame:
    """Realms in use."""
    return live(memory).select("realm").where(F.col("realm").isNotNull()).distinct()


def corrupt(memory: DataFrame) -> DataFrame:
    """Blank content or an affect that is not finite."""
    bad = lambda c: F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    return memory.where(F.coalesce(F.length(F.trim("content")) == 0, F.lit(True)) | bad("valence") | bad("arousal"))


def prune_by_content(memory: DataFrame, patterns: list[str], action: str = "delete") -> DataFrame:
    """Memories whose content holds a pattern, without regard to case, as change rows."""
    low = F.lower("content")
    hit: Column = F.lit(False)
    for p in patterns:
        hit = hit | F.contains(low, F.lit(p.lower()))
    return memory.where(hit).select("memory_id", "kind", F.lit(action).alias("action"), F.substring("content", 1, 80).alias("preview"))


def claim_info(memory: DataFrame, now_ms: int) -> DataFrame:
    """Staging, harness, status and age in whole days."""
    return memory.select("memory_id", "staged", "harness", "status", F.floor(age_days(F.col("created_ms"), now_ms)).alias("age_days"))


def pending_embeddings(memory: DataFrame, vectors: DataFrame, limit: int) -> DataFrame:
    """Live memories without a vector, by id."""
    return live(memory).join(vectors.select("memory_id"), "memory_id", "left_anti").select("memory_id").orderBy("memory_id").limit(limit)


def embedding_coverage(memory: DataFrame, vectors: DataFrame) -> DataFrame:
    """How many should and do have a vector."""
    has = vectors.select("memory_id", F.lit(1).alias("_has")).distinct()
    return live(memory).join(has, "memory_id", "left").agg(F.count(F.lit(1)).alias("should"), F.count("_has").alias("have"))


def write_gates(memory: DataFrame) -> DataFrame:
    """Equal content of one kind and realm reinforces its first row by 0.05 a time, up to 1.

    Grouping is by a content hash, pre-aggregated, so a text that a third of all
    rows share stays one partial sum per task.
    """
    h = content_hash(F.col("kind"), F.col("realm"), F.col("content"))
    again = memory.withColumn("hash", h).groupBy("hash").agg(F.min("memory_id").alias("memory_id"), F.count(F.lit(1)).alias("times"), F.min_by("confidence", "memory_id").alias("confidence"))
    return again.select("memory_id", "times", F.least(F.col("confidence") + 0.05 * (F.col("times") - 1), F.lit(1.0)).alias("confidence"))


def content_hash(kind: Column, realm: Column, content: Column) -> Column:
    """SHA-256 over kind, realm and content, null as empty."""
    return F.sha2(F.concat_ws("\x1f", F.coalesce(kind, F.lit("")), F.coalesce(realm, F.lit("")), F.coalesce(content, F.lit(""))), 256)


def source_anchors(memory: DataFrame, files: DataFrame) -> DataFrame:
    """Memories anchored to a file, and whether its content hash is still the recorded one."""
    joined = memory.join(files, "path", "left")
    state = F.when(F.col("current_hash").isNull(), "missing").when(F.col("current_hash") == F.col("recorded_hash"), "fresh").otherwise("stale")
    return joined.select("memory_id", "path", state.alias("state"))


def symbol_stale(memory_refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """References (memory_id, file_path, line) that no symbol of the file covers.

    The range test runs inside an equi-join on the file, then an anti-join on the reference.
    """
    covered = memory_refs.join(symbols.select("file_path", "line_start", "line_end"), "file_path").where(F.col("line").between(F.col("line_start"), F.col("line_end"))).select("memory_id", "file_path", "line").distinct()
    return memory_refs.join(covered, ["memory_id", "file_path", "line"], "left_anti")


def in_range(memory: DataFrame, start_ms: int, end_ms: int, realm: str | None = None, limit: int | None = None) -> DataFrame:
    """Created in [start, end], newest first."""
    out = memory.where(F.col("created_ms").between(start_ms, end_ms))
    if realm is not None:
        out = out.where(F.col("realm") == realm)
    out = out.orderBy(F.col("created_ms").desc(), F.col("memory_id").desc())
    return out if limit is None else out.limit(limit)


def temporal_recall(memory: DataFrame, start_ms: int, end_ms: int, now_ms: int, limit: int) -> DataFrame:
    """Range query scored by effective strength times confidence, kept in time order."""
    hits = in_range(live(memory), start_ms, end_ms, limit=limit)
    return hits.withColumn("score", effective_strength(now_ms) * F.col("confidence"))


#: Days a tier lasts, with extra days per access, and idle days that suffice.
TIERS = {0: (7, 0, 2), 1: (45, 7, 14), 2: (365, 30, 120)}


def demotion(memory: DataFrame, now_ms: int) -> DataFrame:
    """The next tier of each memory, 3 meaning deletion; pinned ones stay.

    A tier is left when the age exceeds its days plus rehearsal bonus and the
    last access lies further back than its idle days.
    """
    age, idle = age_days(F.col("created_ms"), now_ms), age_days(F.col("last_strengthened_ms"), now_ms)
    out = F.col("tier")
    for tier, (days, bonus, quiet) in TIERS.items():
        out = F.when(~F.col("pinned") & (F.col("tier") == tier) & (age > days + bonus * F.col("access_count")) & (idle > quiet), F.lit(tier + 1)).otherwise(out)
    return memory.withColumn("next_tier", out.cast("long"))


def prune_episodes(memory: DataFrame, now_ms: int, max_age_days: int, max_count: int, weak: float = 0.3) -> DataFrame:
    """Old and weak episodes, and the oldest beyond the count, which is then cut to 80 percent.

    The cut needs no global sort: the oldest rows to go are a bounded top-n.
    """
    episodes = memory.where(F.col("kind") == "episode").withColumn("eff", effective_strength(now_ms))
    gone = episodes.where((age_days(F.col("created_ms"), now_ms) > max_age_days) & (F.col("eff") < weak)).select("memory_id")
    left = episodes.join(gone, "memory_id", "left_anti")
    n = left.count()
    if n <= max_count:
        return gone
    surplus = left.orderBy("created_ms", "memory_id").limit(n - int(max_count * 0.8)).select("memory_id")
    return gone.unionByName(surplus)


def promote_staged(memory: DataFrame, now_ms: int) -> DataFrame:
    """Staged memories that were recalled become permanent; unused for 7 days they go."""
    action = F.when(F.col("access_count") > 0, "unstage").when(age_days(F.col("created_ms"), now_ms) > 7, "prune").otherwise("keep")
    return memory.where("staged").select("memory_id", action.alias("action"))


def memory_stats(memory: DataFrame, now_ms: int) -> DataFrame:
    """Per kind and over all (kind null): count, mean confidence, mean effective strength; one pass of rollup."""
    rows = live(memory).withColumn("eff", effective_strength(now_ms)).where(F.col("kind").isNotNull())
    return rows.rollup("kind").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("avg_confidence"), F.avg("eff").alias("avg_strength"))
