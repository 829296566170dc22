"""Full hierarchies from parent-child links, by level-wise frontier joins from the roots (problem 5).

The frontier of level l joins the links that are still open and gives level l + 1:
each node's root and its ancestors in order, which are its path and its ancestor
pairs. A level is one job that reads the open links and the last level only, and
is written where the finished tree is read from. Open links are rewritten without
the nodes reached as soon as those are half of them, so wide levels are paid for
once and deep ones read little. What no frontier reaches lies in a ring or below.

Defined results: null ids are ignored; of equal ids the last recorded counts
(ties: the greater parent); a parent that is null, 0 or unknown makes a root;
a node that is its own parent is a ring; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from recollect.storage import materialize, new_path

LEVEL = "id long, root_id long, up array<long>"


def last_links(links: DataFrame) -> DataFrame:
    """(id, parent_id) of the last record per id, parent null where there is none."""
    rows = links.where(F.col("id").isNotNull()).select("id", F.struct("recorded_at", F.nullif(F.col("parent_id"), F.lit(0)).alias("parent_id")).alias("r"))
    return rows.groupBy("id").agg(F.max("r").alias("r")).select("id", F.col("r.parent_id").alias("parent_id"))


def levels(links: DataFrame) -> DataFrame:
    """(id, root_id, depth, up) per id, ``up`` being its ancestors from the root down; root 0, depth -1, none in or below a ring.

    A level too large to travel is joined by a sort; a parent with a third of all
    children is skew on one side only, which adaptive execution splits.
    """
    spark = links.sparkSession
    nodes = materialize(last_links(links), "tree-nodes")
    known = nodes.select(F.col("id").alias("parent_id"), F.lit(True).alias("_known"))
    nodes = materialize(nodes.join(known, "parent_id", "left").select("id", F.when(F.col("_known"), F.col("parent_id")).alias("parent")), "tree-links")
    folder = new_path(spark, "tree-levels")

    def keep(level: int, rows: DataFrame) -> int:
        seen = Observation()
        rows.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{folder}/level={level}")
        return seen.get["n"]

    none = F.array().cast("array<long>")
    roots = nodes.where(F.col("parent").isNull()).select("id", F.col("id").alias("root_id"), none.alias("up"))
    last, reached, level = keep(0, roots), 0, 0
    left = nodes.where(F.col("parent").isNotNull())
    n_left = left.count()
    while last and n_left:
        above = spark.read.schema(LEVEL).parquet(f"{folder}/level={level}").select(F.col("id").alias("parent"), "root_id", "up")
        level += 1
        last = keep(level, left.join(above, "parent").select("id", "root_id", F.concat("up", F.array("parent")).alias("up")))
        reached += last
        if last and 2 * reached >= n_left:
            done = spark.read.schema(LEVEL + ", level int").parquet(folder).select("id")
            left = materialize(left.join(done, "id", "left_anti"), "tree-left")
            n_left, reached = n_left - reached, 0
    tree = spark.read.schema(LEVEL + ", level int").parquet(folder).select("id", "root_id", F.col("level").cast("long").alias("depth"), "up")
    lost = left.join(tree.select("id"), "id", "left_anti").select("id", F.lit(0).cast("long").alias("root_id"), F.lit(-1).cast("long").alias("depth"), none.alias("up"))
    return tree.unionByName(lost)


def hierarchy(links: DataFrame) -> DataFrame:
    """(id, root_id, depth, path) per id; root 0, depth -1 and an empty path in or below a ring."""
    path = F.concat_ws("/", F.transform(F.concat("up", F.array("id")), lambda x: x.cast("string")))
    return levels(links).select("id", "root_id", "depth", F.when(F.col("depth") >= 0, path).otherwise(F.lit("")).alias("path"))


def descendants(tree: DataFrame) -> DataFrame:
    """(ancestor_id, id, distance) for every node of :func:`levels` and each of its proper ancestors: its ancestor pairs."""
    return tree.select("id", "depth", F.posexplode("up").alias("pos", "ancestor_id")).select("ancestor_id", "id", (F.col("depth") - F.col("pos")).alias("distance"))
