"""Triplets and associations.

Loops over hops have a small fixed bound; each hop's result is written to the
shared folder, so plans stay short and a lost executor costs one hop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.storage import materialize

#: What an association type is worth when followed.
PRIOR = {"DerivedFrom": 1.0, "SameArtifact": 0.8, "SameSession": 0.6, "CoRetrieved": 0.5, "Supports": 0.4, "Contradicts": 0.3, "SemanticNeighbor": 0.7}
REVERSE = 0.3


def valid_at(at_ms: int) -> Column:
    """Open or not yet ended."""
    return (F.col("valid_to_ms") == 0) | (F.lit(at_ms) < F.col("valid_to_ms"))


def lookup(triplets: DataFrame, at_ms: int, **fixed: str) -> DataFrame:
    """Facts valid at a time with the given subject, predicate or object."""
    out = triplets.where(valid_at(at_ms))
    for column, value in fixed.items():
        out = out.where(F.col(column) == value)
    return out


def entity(triplets: DataFrame, name: str, at_ms: int, limit: int) -> DataFrame:
    """Facts that name an entity on either side, once each, by id."""
    return triplets.where(valid_at(at_ms) & ((F.col("subject") == name) | (F.col("object") == name))).orderBy("id").limit(limit)


def as_of(triplets: DataFrame, superseded: DataFrame, world_ms: int) -> DataFrame:
    """True at a world time and not superseded by then."""
    begun = (F.col("valid_from_ms") == 0) | (F.col("valid_from_ms") <= world_ms)
    gone = superseded.where(F.col("at_ms") <= world_ms).select(F.col("old_id").alias("id"))
    return triplets.where(begun & valid_at(world_ms)).join(gone, "id", "left_anti")


def believed_at(triplets: DataFrame, superseded: DataFrame, ingest_ms: int) -> DataFrame:
    """Known at an ingestion time and not superseded by then."""
    gone = superseded.where(F.col("at_ms") <= ingest_ms).select(F.col("old_id").alias("id"))
    return triplets.where(F.coalesce("ingested_ms", "valid_from_ms") <= ingest_ms).join(gone, "id", "left_anti")


def deduplicated(triplets: DataFrame) -> DataFrame:
    """Of equal open facts the heaviest, ties to the smaller id; closed facts stay."""
    best = F.max_by(F.struct(*[c for c in triplets.columns if c not in ("subject", "predicate", "object")]), F.struct("weight", -F.col("id"))).alias("r")
    open_ = triplets.where("valid_to_ms = 0").groupBy("subject", "predicate", "object").agg(best)
    rest = [F.col(f"r.{c}").alias(c) if c not in ("subject", "predicate", "object") else F.col(c) for c in triplets.columns]
    return open_.select(*rest).unionByName(triplets.where("valid_to_ms <> 0"))


def invalidated(triplets: DataFrame, closures: DataFrame) -> DataFrame:
    """Close open facts named by (id, now_ms) or (source_file, now_ms) events; the earliest counts."""
    key = "id" if "id" in closures.columns else "source_file"
    first = closures.groupBy(key).agg(F.min("now_ms").alias("_closed"))
    out = triplets.join(first, key, "left")
    return out.withColumn("valid_to_ms", F.when((F.col("valid_to_ms") == 0) & F.col("_closed").isNotNull(), F.col("_closed")).otherwise(F.col("valid_to_ms"))).drop("_closed")


def purged(triplets: DataFrame) -> DataFrame:
    """Open facts only."""
    return triplets.where("valid_to_ms = 0")


def directed(triplets: DataFrame, at_ms: int, direction: str = "both", types: list[str] | None = None) -> DataFrame:
    """Edges (src, dst, weight, id, source_memory_id) of the valid facts; reverse ones weigh 0.3 as much."""
    t = triplets.where(valid_at(at_ms))
    if types:
        t = t.where(F.col("predicate").isin(types))
    out = t.select(F.col("subject").alias("src"), F.col("object").alias("dst"), "weight", "id", "source_memory_id")
    back = t.select(F.col("object").alias("src"), F.col("subject").alias("dst"), (REVERSE * F.col("weight")).alias("weight"), "id", "source_memory_id")
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction]


def spreading(triplets: DataFrame, seeds: list[str], depth: int, decay: float, at_ms: int, cut: float = 0.01, most: int | None = None) -> DataFrame:
    """(memory_id, activation) by level-wise spreading; a node keeps its first level's greatest activation.

    Facts met on a level give their source memory the activation of that level's node.
    """
    spark = triplets.sparkSession
    edges = directed(triplets, at_ms)
    layer = spark.createDataFrame([(s, 1.0) for s in sorted(set(seeds))], "node string, activation double")
    seen, found = layer.select("node"), None
    for level in range(depth + 1):
        met = edges.join(layer.withColumnRenamed("node", "src"), "src")
        hits = met.where(F.col("source_memory_id").isNotNull()).select(F.col("source_memory_id").alias("memory_id"), "activation")
        found = hits if found is None else found.unionByName(hits)
        if level == depth:
            break
        nxt = met.select(F.col("dst").alias("node"), (F.col("activation") * F.greatest("weight", F.lit(0.0)) * decay).alias("activation")).where(F.col("activation") >= cut)
        nxt = nxt.groupBy("node").agg(F.max("activation").alias("activation")).join(seen, "node", "left_anti")
        if most is not None:
            nxt = nxt.orderBy(F.col("activation").desc(), "node").limit(most)
        layer = materialize(nxt, "spread-layer")
        seen = seen.unionByName(layer.select("node"))
    return found.groupBy("memory_id").agg(F.max("activation").alias("activation"))


def traverse(triplets: DataFrame, superseded: DataFrame, start: str, hops: int, at_ms: int, direction: str = "out", types: list[str] | None = None, most: int | None = None) -> DataFrame:
    """(node, hops, weight) by breadth-first levels, each node at its first level with its heaviest path."""
    spark = triplets.sparkSession
    edges = directed(triplets.join(superseded.select(F.col("old_id").alias("id")), "id", "left_anti"), at_ms, direction, types)
    layer = spark.createDataFrame([(start, 0, 1.0)], "node string, hops int, weight double")
    levels = [layer]
    for h in range(1, hops + 1):
        step = layer.select(F.col("node").alias("src"), F.col("weight").alias("so_far")).join(edges, "src")
        nxt = step.groupBy(F.col("dst").alias("node")).agg(F.max(F.col("so_far") * F.col("weight")).alias("weight")).select("node", F.lit(h).alias("hops"), "weight")
        for old in levels:
            nxt = nxt.join(old.select("node"), "node", "left_anti")
        layer = materialize(nxt, "bfs-layer")
        levels.append(layer)
    out = levels[1]
    for level in levels[2:]:
        out = out.unionByName(level)
    return out if most is None else out.orderBy("hops", F.col("weight").desc(), "node").limit(most)


def pagerank(edges: DataFrame, seeds: list, damping: float, rounds: int, node_type: str = "string") -> DataFrame:
    """(node, score) with restart at the seeds, weights normalised per source, scores renormalised each round.

    One join and one pre-aggregated sum a round, each written before the next.
    """
    spark = edges.sparkSession
    total = edges.groupBy("src").agg(F.sum("weight").alias("_t")).where(F.col("_t") > 0)
    share = materialize(edges.join(total, "src").select("src", "dst", (F.col("weight") / F.col("_t")).alias("share")), "pagerank-edges")
    restart = spark.createDataFrame([(s, (1.0 - damping) / len(seeds)) for s in seeds], f"node {node_type}, score double")
    scores = restart
    for _ in range(rounds):
        flow = share.join(scores.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), (damping * F.col("score") * F.col("share")).alias("score"))
        new = materialize(flow.unionByName(restart).groupBy("node").agg(F.sum("score").alias("score")), "pagerank")
        norm = new.agg(F.sum("score")).first()[0] or 1.0
        scores = new.withColumn("score", F.col("score") / norm)
    return scores


def transfer(triplets: DataFrame, a: str, b: str, c: str, at_ms: int) -> DataFrame:
    """Answers to a : b :: c : ?, by the predicates that lead from a to b, with their support."""
    t = triplets.where((F.col("valid_from_ms") <= at_ms) & valid_at(at_ms))
    how = t.where((F.col("subject") == a) & (F.col("object") == b)).select("predicate").distinct()
    hits = t.where(F.col("subject") == c).join(how, "predicate", "left_semi")
    return hits.groupBy("object").agg(F.count(F.lit(1)).alias("support"), F.max("weight").alias("weight"))


def both_ways(triplets: DataFrame, predicate: str, at_ms: int) -> DataFrame:
    """(id, other) pairs linked by a predicate in either direction."""
    t = lookup(triplets, at_ms, predicate=predicate)
    return t.select(F.col("subject").alias("name"), F.col("object").alias("other")).union(t.select("object", "subject")).distinct()


def chain(superseded: DataFrame, start: int, most: int = 20) -> DataFrame:
    """(step, id) of what replaced what, from a start, stopping at a repeat; at most ``most`` point look-ups."""
    out, at, seen = [], start, {start}
    for step in range(1, most + 1):
        nxt = superseded.where(F.col("old_id") == at).agg(F.min("new_id")).first()[0]
        if nxt is None or nxt in seen:
            break
        out.append((step, nxt))
        seen.add(nxt)
        at = nxt
    return superseded.sparkSession.createDataFrame(out, "step int, id long")


#: Classes of kinds, by what they may cite.
def kind_class(kind: Column, content: Column) -> Column:
    """Thought, Decision, Observation or Artifact, from kind and the beginning of the content."""
    low = F.lower(F.substring(content, 1, 64))
    return (
        F.when(kind.isin("wisdom", "insight", "preference"), "Thought")
        .when(kind.isin("correction") | F.contains(low, F.lit("decid")), "Decision")
        .when(kind.isin("operational") & F.contains(low, F.lit("src/")), "Artifact")
        .otherwise("Observation")
    )


def legal(source: Column, target: Column) -> Column:
    """An observation or decision may not cite a thought."""
    return ~(source.isin("Observation", "Decision") & (target == "Thought"))


def merged_edges(edges: DataFrame) -> DataFrame:
    """One edge per (src, dst, type), the heaviest; no loops."""
    return edges.where("src <> dst").groupBy("src", "dst", "type").agg(F.max("weight").alias("weight"))


def census(edges: DataFrame) -> DataFrame:
    """Per type the number of edges and a five-bucket histogram of weights."""
    bucket = F.least(F.floor(F.col("weight") * 5), F.lit(4))
    return edges.groupBy("type").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(bucket == i).alias(f"b{i}") for i in range(5)])


def decayed(edges: DataFrame, kind: str, factor: float, below: float) -> DataFrame:
    """Weaken edges of a type, then drop those below a floor."""
    w = F.when(F.col("type") == kind, F.col("weight") * factor).otherwise(F.col("weight"))
    return edges.withColumn("weight", w).where((F.col("type") != kind) | (F.col("weight") >= below))


def without_type(edges: DataFrame, kind: str) -> DataFrame:
    """Drop a type."""
    return edges.where(F.col("type") != kind)


def densified(memory: DataFrame) -> DataFrame:
    """Link each memory with the three before it of its session and realm, 0.6 * 0.7^i."""
    w = Window.partitionBy("source_session", "realm").orderBy("created_ms", "memory_id")
    rows = memory.where(F.col("source_session").isNotNull())
    lagged = rows.select(F.col("memory_id").alias("src"), *[F.lag("memory_id", i).over(w).alias(f"_{i}") for i in (1, 2, 3)])
    before = F.array(*[F.struct(F.col(f"_{i}").alias("dst"), F.lit(0.6 * 0.7 ** (i - 1)).alias("weight")) for i in (1, 2, 3)])
    out = lagged.select("src", F.explode(before).alias("e")).select("src", "e.dst", F.lit("SameSession").alias("type"), "e.weight")
    return out.where(F.col("dst").isNotNull())


def coactivation(sets: DataFrame, most: int = 16) -> DataFrame:
    """(a, b, n, contexts, multiplier) of members that occur together in (set_id, member, context).

    Sets are bounded lists (the top hits of one recall), so the pairs of a set are too.
    """
    pairs = sets.join(sets.select("set_id", F.col("member").alias("other")), "set_id").where("member < other")
    out = pairs.groupBy(F.col("member").alias("a"), F.col("other").alias("b")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("context").alias("contexts"))
    return out.withColumn("multiplier", F.least(F.col("n") * F.col("contexts"), F.lit(most)).cast("double"))


def strongest_pairs(pairs: DataFrame, per: int) -> DataFrame:
    """Pairs that are among the ``per`` strongest of either member."""
    sides = pairs.select(F.col("a").alias("m"), "a", "b", "n").unionByName(pairs.select(F.col("b").alias("m"), "a", "b", "n"))
    rank = F.row_number().over(Window.partitionBy("m").orderBy(F.col("n").desc(), "a", "b"))
    return sides.withColumn("_r", rank).where(F.col("_r") <= per).select("a", "b", "n").distinct()


def couplings(sets: DataFrame) -> DataFrame:
    """0.02 forward and 0.3 of it back for members in order (set_id, pos, member), 1 at most."""
    pairs = sets.join(sets.select("set_id", F.col("pos").alias("q"), F.col("member").alias("other")), "set_id").where("pos < q")
    both = pairs.select(F.col("member").alias("src"), F.col("other").alias("dst"), F.lit(0.02).alias("w")).unionByName(pairs.select(F.col("other").alias("src"), F.col("member").alias("dst"), F.lit(0.006).alias("w")))
    return both.groupBy("src", "dst").agg(F.least(F.sum("w"), F.lit(1.0)).alias("weight"))


def settle(coupling: DataFrame, seeds: DataFrame, steps: int) -> DataFrame:
    """(node, level) after ``steps`` sigmoid updates of activity flowing over couplings."""
    level = seeds
    for _ in range(steps):
        inflow = coupling.join(level.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("weight") * F.col("level")).alias("_in"))
        both = inflow.join(level, "node", "full").select("node", (1.0 / (1.0 + F.exp(-(F.coalesce("_in", F.lit(0.0)) + F.coalesce("level", F.lit(0.0)) - 0.5) * 4.0))).alias("level"))
        level = materialize(both, "settle")
    return level


def illegal_edges(edges: DataFrame, memory: DataFrame) -> DataFrame:
    """Edges whose ends' classes do not allow them."""
    c = memory.select("memory_id", kind_class(F.col("kind"), F.col("content")).alias("class"))
    both = edges.join(c.toDF("src", "c1"), "src").join(c.toDF("dst", "c2"), "dst")
    return both.where(~legal(F.col("c1"), F.col("c2"))).select("src", "dst", "type", "c1", "c2")


def replication_sessions(memory: DataFrame, confirms: DataFrame) -> DataFrame:
    """Distinct sessions a memory is known from: its own and those of what confirms it."""
    own = memory.select("memory_id", "source_session")
    more = confirms.join(memory.select(F.col("memory_id").alias("by"), "source_session"), "by").select("memory_id", "source_session")
    return own.unionByName(more).groupBy("memory_id").agg(F.count_distinct("source_session").alias("sessions"))


def forgotten(triplets: DataFrame, edges: DataFrame, deleted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts and associations left when memories are deleted."""
    ids = deleted.select("memory_id").distinct()
    t = triplets.join(ids.withColumnRenamed("memory_id", "source_memory_id"), "source_memory_id", "left_anti")
    e = edges.join(ids.toDF("src"), "src", "left_anti").join(ids.toDF("dst"), "dst", "left_anti")
    return t, e


def expanded(edges: DataFrame, seeds: list[int], hops: int, usable: DataFrame, fan_out: int = 16, decay: float = 0.55) -> DataFrame:
    """(memory_id, activation): best product of decay, type prior and weight over paths of up to two hops.

    The 16 heaviest edges of a node are followed (ties: smaller target).
    """
    spark = edges.sparkSession
    prior: Column = F.lit(0.0)
    for kind, p in PRIOR.items():
        prior = F.when(F.col("type") == kind, F.lit(p)).otherwise(prior)
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.col("weight").desc(), "dst", "type"))
    kept = edges.withColumn("_r", rank).where(F.col("_r") <= fan_out).join(usable.select(F.col("memory_id").alias("dst")), "dst", "left_semi")
    step = kept.select("src", "dst", (decay * prior * F.col("weight")).alias("w"))
    layer = spark.createDataFrame([(s, 1.0) for s in seeds], "src long, act double")
    found = None
    for _ in range(min(hops, 2)):
        reach = step.join(layer, "src").groupBy("dst").agg(F.max(F.col("act") * F.col("w")).alias("act"))
        reach = materialize(reach, "expand")
        found = reach if found is None else found.unionByName(reach)
        layer = reach.withColumnRenamed("dst", "src")
    best = found.groupBy(F.col("dst").alias("memory_id")).agg(F.max("act").alias("activation"))
    return best.where(~F.col("memory_id").isin(seeds))


def ppr_lane(edges: DataFrame, seeds: list[int], weights: list[float], rounds: int = 25, alpha: float = 0.15, degree: int = 64, most: int = 4000, hops: int = 4, tolerance: float = 1e-4) -> DataFrame:
    """Personalised PageRank on the neighbourhood of the seeds: four hops, 64 heaviest edges a node, until the change is small.

    The neighbourhood ends at ``most`` nodes: seeds always, then by hop, then by the heaviest edge that leads there.
    """
    spark = edges.sparkSession
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.col("weight").desc(), "dst"))
    flat = edges.groupBy("src", "dst").agg(F.max("weight").alias("weight"))
    capped = flat.withColumn("_r", rank).where(F.col("_r") <= degree).drop("_r")
    nodes = spark.createDataFrame([(s,) for s in seeds], "src long")
    nodes = layer = nodes.distinct()
    room = most - len(set(seeds))
    for _ in range(hops):
        if room <= 0:
            break
        reach = capped.join(layer, "src").groupBy("dst").agg(F.max("weight").alias("weight")).withColumnRenamed("dst", "src").join(nodes, "src", "left_anti")
        layer = materialize(reach.orderBy(F.col("weight").desc(), "src").limit(room).select("src"), "ppr-nodes")
        nodes, room = nodes.unionByName(layer), room - layer.count()
    local = capped.join(nodes, "src", "left_semi").join(nodes.withColumnRenamed("src", "dst"), "dst", "left_semi")
    total = local.groupBy("src").agg(F.sum("weight").alias("_t")).where(F.col("_t") > 0)
    share = materialize(local.join(total, "src").select("src", "dst", (F.col("weight") / F.col("_t")).alias("share")), "ppr-edges")
    z = sum(weights)
    start = spark.createDataFrame([(s, w / z) for s, w in zip(seeds, weights, strict=True)], "node long, p double")
    score = start.select("node", F.col("p").alias("score"))
    for _ in range(rounds):
        flow = share.join(score.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), ((1 - alpha) * F.col("score") * F.col("share")).alias("score"))
        new = materialize(flow.unionByName(start.select("node", (alpha * F.col("p")).alias("score"))).groupBy("node").agg(F.sum("score").alias("score")), "ppr")
        moved = new.join(score.withColumnRenamed("score", "old"), "node", "full").agg(F.sum(F.abs(F.coalesce("score", F.lit(0.0)) - F.coalesce("old", F.lit(0.0))))).first()[0]
        score = new
        if moved < tolerance:
            break
    return score.where(~F.col("node").isin(seeds)).select(F.col("node").alias("memory_id"), "score")
