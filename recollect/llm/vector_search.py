"""The k most similar vectors for every vector: a small-world graph per shard, results merged (problem 2).

Vectors are brought to unit length and equal ones collapse to the least id. They
are parted into cells by k-means over a bounded sample (``SAMPLE_PER_CELL``
vectors a cell, at most ``MAX_CELLS`` cells), each into its nearest. A cell of
more than twice ``SHARD`` vectors is parted again in the same way, by centres
trained on a sample of its own, until cells are small: two levels hold
MAX_CELLS^2 x SHARD vectors. So the size of a cell stays, and their number grows
with the collection.

A query visits its own cell and the next nearest, ``probes`` in all; where a cell
is parted again, its own members visit ``probes`` of the parts, and visitors half
as many on the second level and one below. The number of visits never depends on
the number of vectors.

Each cell is a shard with a graph (:class:`recollect.operators.hnsw.Hnsw`), built
by inserting its members in batches. A task holds one graph at a time; visitors
stream past it batch by batch, and a shard that more than ``VISITS`` vectors visit
is copied, each copy serving a part of them. The best k of all shards are kept,
and copies of a vector are put back after the search.

Defined results: usable vectors have the given number of finite values, not all
zero; rows with other vectors or a null id are ignored; repeated rows count
once; ties go to the smaller id; an empty table gives no rows; extra columns are
dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.operators.hnsw import Hnsw
from recollect.storage import materialize

SHARD = 4096
MAX_CELLS = 4096
SAMPLE_PER_CELL = 64
#: Visitors of one copy of a shard.
VISITS = 16 * SHARD
#: Levels of cells; what is still too large below them (vectors k-means cannot part) is cut by id hash.
DEPTH = 4
ROUTED = "node long, member boolean, asks boolean, id long, vec binary"


def _unit(dim: int):
    def run(batches):
        for batch in batches:
            ids, lists = batch.column("id"), batch.column("vec")
            right = np.asarray(lists.is_valid()) & np.asarray(ids.is_valid())
            offsets = lists.offsets.to_numpy().astype(np.int64)
            right &= np.diff(offsets) == dim
            at = offsets[:-1][right]
            if not len(at):
                continue
            values = lists.values.to_numpy(zero_copy_only=False)
            x = values[at[:, None] + np.arange(dim)].astype(np.float64)
            good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
            x = x[good]
            x /= np.abs(x).max(axis=1, keepdims=True)
            x = (x / np.sqrt((x * x).sum(axis=1, keepdims=True))).astype(np.float32)
            kept = ids.to_numpy(zero_copy_only=False)[right][good].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(kept), _binary(x)], names=["id", "vec"])

    return run


def _binary(x: np.ndarray) -> pa.Array:
    n, width = len(x), x.shape[1] * 4
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(x))])


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, dim), dtype=np.float32)
    start = int(np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset])
    return np.frombuffer(column.buffers()[2], dtype=np.float32, count=len(column) * dim, offset=start).reshape(-1, dim)


def unit_vectors(rows: DataFrame, item: str, vector: str, dim: int) -> DataFrame:
    """(id, vec) of the usable rows, vec being the bytes of ``dim`` float32 of unit length."""
    return rows.select(F.col(item).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("vec")).mapInArrow(_unit(dim), "id long, vec binary")


def train_cells(sample: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Unit-length centroids of ``cells`` groups of the sample (spherical k-means, fixed seed)."""
    rng = np.random.default_rng(7)
    cells = min(cells, len(sample))
    centres = sample[rng.choice(len(sample), cells, replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([(sample[i : i + 8192] @ centres.T).argmax(axis=1) for i in range(0, len(sample), 8192)])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), centres).astype(np.float32)
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray, probes: int) -> np.ndarray:
    s = x @ centres.T
    probes = min(probes, len(centres))
    part = np.argpartition(-s, probes - 1, axis=1)[:, :probes] if probes < len(centres) else np.broadcast_to(np.arange(probes), s.shape).copy()
    return np.take_along_axis(part, np.argsort(-np.take_along_axis(s, part, 1), axis=1, kind="stable"), 1)


def _visits(centres: np.ndarray, dim: int, probes: int):
    """Vectors -> (node, n, visits): how many a cell holds and how many visit it."""

    def run(batches):
        for batch in batches:
            near = _nearest(_matrix(batch.column("vec"), dim), centres, probes)
            asks = batch.column("asks").to_numpy(zero_copy_only=False)
            n = np.bincount(near[:, 0], minlength=len(centres))
            visits = np.bincount(near[asks, 1:].ravel(), minlength=len(centres))
            cell = np.nonzero(n + visits)[0]
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n[cell]), pa.array(visits[cell])], names=["node", "n", "visits"])

    return run


def _sent(batch: pa.RecordBatch, near: np.ndarray, member: np.ndarray, first: int, most: np.ndarray) -> pa.RecordBatch:
    """Rows for the cells of ``near``: a member goes to its nearest as one, and asks in the next ``most`` - 1; a visitor asks in ``most``."""
    n = len(near)
    asks = batch.column("asks").to_numpy(zero_copy_only=False)
    rows, nodes, members = [], [], []
    for p in range(near.shape[1]):
        go = np.nonzero((asks & (p < most)) | (member if p == 0 else np.zeros(n, dtype=bool)))[0]
        rows.append(go)
        nodes.append(first + near[go, p])
        members.append(member[go] & (p == 0))
    take = pa.array(np.concatenate(rows))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(nodes)), pa.array(np.concatenate(members)), batch.column("asks").take(take), batch.column("id").take(take), batch.column("vec").take(take)], names=["node", "member", "asks", "id", "vec"]
    )


def _route(centres: np.ndarray, dim: int, probes: int):
    """Send each vector to its cell as a member, and to those it visits."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if n:
                yield _sent(batch, _nearest(_matrix(batch.column("vec"), dim), centres, probes), np.ones(n, dtype=bool), 0, np.full(n, probes))

    return run


def _runs(values: np.ndarray):
    """(start, end) of the runs of equal values."""
    cut = np.nonzero(np.diff(values))[0] + 1
    return zip(np.concatenate([[0], cut]), np.concatenate([cut, [len(values)]]), strict=True)


def _reroute(dim: int, probes: int, visits: int):
    """Rows sorted by (node, kind), a node's centres first -> rows of its parts; node numbers grow by a factor of MAX_CELLS."""

    def run(batches):
        node, held, centres = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            nodes, kinds = batch.column("node").to_numpy(), batch.column("kind").to_numpy()
            for start, end in _runs(nodes * 2 + kinds):
                part = batch.slice(start, end - start)
                if nodes[start] != node:
                    node, held, centres = nodes[start], [], None
                if kinds[start] == 0:
                    held.append(_matrix(part.column("vec"), dim))
                    continue
                if centres is None:
                    centres = np.concatenate(held)
                member = part.column("member").to_numpy(zero_copy_only=False)
                yield _sent(part, _nearest(_matrix(part.column("vec"), dim), centres, probes), member, int(node) * MAX_CELLS, np.where(member, probes, visits))

    return run


def _trained(dim: int, shard: int):
    def run(table: pa.Table) -> pa.Table:
        n = table.column("n")[0].as_py()
        x = _matrix(table.column("vec"), dim)
        centres = train_cells(x[np.argsort(table.column("id").to_numpy())], min(MAX_CELLS, -(-n // shard)))
        return pa.table({"node": pa.array(np.full(len(centres), table.column("node")[0].as_py())), "vec": _binary(centres)})

    return run


def _split(rows: DataFrame, big: DataFrame, dim: int, probes: int, visits: int, shard: int) -> DataFrame:
    """Part the cells in ``big`` (node, n, visits) again; rows of other cells keep their place.

    Centres come from a sample of each cell's own members and meet the cell's
    rows by a sort, not by a broadcast; a cell's rows are salted over tasks.
    """
    want = F.least(F.ceil(F.col("n") / shard), F.lit(MAX_CELLS)) * SAMPLE_PER_CELL
    members = rows.where("member").join(big.select("node", "n"), "node")
    sample = members.where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1_000_003)) < F.ceil(want * 1_000_003 / F.col("n"))).select("node", "id", "vec", "n")
    centres = materialize(sample.groupBy("node").applyInArrow(_trained(dim, shard), "node long, vec binary"), "cell-centres")
    salts = big.select("node", F.ceil((F.col("n") + F.col("visits")) / (4.0 * VISITS)).cast("int").alias("salts"))
    none = F.lit(False)
    head = centres.join(salts, "node").select("node", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), none.alias("member"), none.alias("asks"), F.lit(0).cast("long").alias("id"), "vec")
    body = rows.join(salts, "node").select("node", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("kind"), "member", "asks", "id", "vec")
    met = head.unionByName(body).repartition("node", "salt").sortWithinPartitions("node", "salt", "kind")
    parts = met.select("node", "kind", "member", "asks", "id", "vec").mapInArrow(_reroute(dim, probes, visits), ROUTED)
    rest = rows.join(big.select("node"), "node", "left_anti").withColumn("node", F.col("node") * MAX_CELLS)
    return materialize(rest.unionByName(parts), "cell-rows")


def _sizes(rows: DataFrame) -> DataFrame:
    return materialize(rows.groupBy("node").agg(F.count_if("member").alias("n"), F.count_if(~F.col("member")).alias("visits")), "cell-sizes")


def _search(dim: int, k: int, ef: int, least: float):
    """Rows sorted by (shard, members first) -> (a, b, similarity): a graph at a time, visitors as they come."""

    def found(query: np.ndarray, ids: np.ndarray, rows: np.ndarray, sim: np.ndarray):
        r, c = np.nonzero((rows >= 0) & (sim >= least))
        a, b, s = query[r], ids[rows[r, c]], sim[r, c]
        return pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b]), pa.array(s[a != b].astype(np.float64))], names=["a", "b", "similarity"])

    def run(batches):
        shard, held, graph, ids = None, [], None, None

        def build():
            table = pa.Table.from_batches(held)
            ids = table.column("id").to_numpy()
            order = np.argsort(ids, kind="stable")
            graph = Hnsw(_matrix(table.column("vec"), dim)[order])
            asks = table.column("asks").to_numpy()[order] & table.column("first").to_numpy()[order]
            own = np.nonzero(asks)[0]
            ids = ids[order]
            return graph, ids, found(ids[own], ids, *graph.search(graph.x[own], k + 1, ef, own)) if len(own) else None

        for batch in batches:
            if not batch.num_rows:
                continue
            shards, member = batch.column("shard").to_numpy(), batch.column("member").to_numpy(zero_copy_only=False)
            for start, end in _runs(shards.astype(np.int64) * 2 + member):
                part = batch.slice(start, end - start)
                if shards[start] != shard:
                    if held and graph is None:  # nobody visited the last shard
                        out = build()[2]
                        if out is not None:
                            yield out
                    shard, held, graph = shards[start], [], None
                if member[start]:
                    held.append(part)
                    continue
                if graph is None:
                    if not held:
                        continue
                    graph, ids, out = build()
                    if out is not None:
                        yield out
                yield found(part.column("id").to_numpy(), ids, *graph.search(_matrix(part.column("vec"), dim), k, ef))
        if held and graph is None:
            out = build()[2]
            if out is not None:
                yield out

    return run


def nearest(rows: DataFrame, item: str, vector: str, k: int, dim: int = 64, probes: int = 3, ef: int = 24, least: float = -2.0, queries=None, shard: int = SHARD, max_cells: int = MAX_CELLS) -> DataFrame:
    """(item, neighbour, similarity, position) of the k most similar vectors of each query.

    ``queries`` is a condition on ``item`` that picks the vectors that ask, all by
    default; ``least`` leaves out neighbours below a similarity. Shuffles: equal
    vectors (map-side combine), and vectors to the shards they meet; everything
    later carries ids only. ``max_cells`` bounds the cells of the first level.
    """
    spark = rows.sparkSession
    vectors = unit_vectors(rows, item, vector, dim)
    reps = materialize(vectors.groupBy("vec").agg(F.min("id").alias("id"), F.max("id").alias("_hi")).select("id", "vec", (F.col("id") != F.col("_hi")).alias("copied")), "vectors")
    members = None
    if not reps.where("copied").isEmpty():
        members = materialize(vectors.join(reps.where("copied").select(F.col("id").alias("rep"), "vec"), "vec").select("id", "rep").distinct(), "vector-copies")

    n = reps.count()
    cells = max(1, min(max_cells, -(-n // shard)))
    part = min(1.0, SAMPLE_PER_CELL * cells / max(n, 1))
    picked = F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < int(part * 1_000_003) + 1
    sample = reps.where(picked).select("vec").orderBy(F.xxhash64("vec")).limit(SAMPLE_PER_CELL * cells).collect()  # bounded by the two constants
    if not sample:
        return spark.createDataFrame([], f"{item} long, neighbour long, similarity double, position int")
    centres = train_cells(np.frombuffer(b"".join(r[0] for r in sample), dtype=np.float32).reshape(-1, dim), cells)

    asks = F.lit(True) if queries is None else queries(F.col("id"))
    if queries is not None and members is not None:  # a class asks if any of its members does
        asking = members.where(queries(F.col("id"))).select(F.col("rep").alias("id")).distinct().withColumn("_asks", F.lit(True))
        reps = reps.join(asking, "id", "left")
        asks = asks | F.coalesce("_asks", F.lit(False))
    ready = reps.select("id", "vec", asks.alias("asks"))
    routed = ready.mapInArrow(_route(centres, dim, probes), ROUTED)
    sizes = materialize(ready.select("vec", "asks").mapInArrow(_visits(centres, dim, probes), "node long, n long, visits long").groupBy("node").agg(F.sum("n").alias("n"), F.sum("visits").alias("visits")), "cell-sizes")
    for level in range(2, DEPTH + 1):
        big = materialize(sizes.where(F.col("n") > 2 * shard), "large-cells")
        if big.isEmpty():
            break
        routed = _split(routed, big, dim, probes, max(1, probes // 2) if level == 2 else 1, shard)
        sizes = _sizes(routed)

    # one row a cell: how many shards it is (only if no level could part it), and how many copies serve its visitors
    pieces, copies = F.ceil(F.col("n") / (2.0 * shard)), F.greatest(F.ceil(F.col("visits") / VISITS), F.lit(1))
    plan = sizes.where("n > 0").select("node", pieces.cast("int").alias("pieces"), copies.cast("int").alias("copies"))
    before = F.sum(F.col("pieces") * F.col("copies")).over(Window.orderBy("node").rowsBetween(Window.unboundedPreceding, -1))
    plan = materialize(plan.withColumn("first", F.coalesce(before, F.lit(0)).cast("int")), "shards")
    width = int(min(plan.agg(F.sum(F.col("pieces") * F.col("copies"))).first()[0], 20_000))
    piece, copy = F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int"), F.pmod(F.xxhash64("id", F.lit(7)), F.col("copies")).cast("int")
    zero = F.lit(0)
    # a member is in each copy of its own piece, and asks in the first; a visitor asks in one copy of each piece, a member of the others too
    home = F.transform(F.sequence(zero, F.col("copies") - 1), lambda c: F.struct((F.col("first") + piece * F.col("copies") + c).alias("shard"), F.lit(True).alias("member"), (c == 0).alias("first")))
    others = F.filter(F.sequence(zero, F.col("pieces") - 1), lambda p: F.col("asks") & (~F.col("member") | (p != piece)))
    away = F.transform(others, lambda p: F.struct((F.col("first") + p * F.col("copies") + copy).alias("shard"), F.lit(False).alias("member"), F.lit(True).alias("first")))
    to = F.explode(F.when(F.col("member"), F.concat(home, away)).otherwise(away)).alias("to")
    sent = routed.join(plan, "node").select(to, "asks", "id", "vec").select("to.shard", "to.member", "to.first", "asks", "id", "vec")
    by_shard = sent.repartitionById(width, F.col("shard") % width).sortWithinPartitions("shard", F.col("member").desc())  # up to 20,000 shards, no two meet by hash
    found = by_shard.mapInArrow(_search(dim, k, ef, least), "a long, b long, similarity double")
    position = F.row_number().over(Window.partitionBy("a").orderBy(F.col("similarity").desc(), "b"))
    top = found.groupBy("a", "b").agg(F.max("similarity").alias("similarity")).withColumn("position", position).where(F.col("position") <= k)
    if members is None:
        out = top
    else:
        out = _with_copies(materialize(top, "neighbours"), members, k)
    out = out.select(F.col("a").alias(item), F.col("b").alias("neighbour"), "similarity", F.col("position").cast("int").alias("position"))
    return out if queries is None else out.where(queries(F.col(item)))


def _with_copies(top: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """Neighbours of every vector from those of the representatives.

    A copy's nearest are the first of its own class, then the neighbours of the
    representative, each followed by its first copies. At most k rows a vector,
    whatever the size of a class.
    """
    rank = F.row_number().over(Window.partitionBy("rep").orderBy("id"))
    heads = materialize(members.withColumn("rank", rank).where(F.col("rank") <= k + 1), "copy-heads")  # limited per task before the shuffle
    sizes = members.groupBy("rep").agg(F.count(F.lit(1)).alias("size"))
    mine = members.join(sizes, "rep").join(heads.select("id", F.col("rank").alias("own")), "id", "left")
    inner = mine.join(heads.select("rep", F.col("id").alias("b"), "rank"), "rep").where((F.col("id") != F.col("b")) & ((F.col("rank") <= k) | F.col("own").isNotNull()))
    inner = inner.select(F.col("id").alias("a"), "b", F.lit(1.0).alias("similarity"))
    spread = top.join(heads.where(F.col("rank") <= k).select(F.col("rep").alias("b"), F.col("id").alias("copy")), "b", "left").select("a", F.coalesce("copy", "b").alias("b"), "similarity")
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.col("similarity").desc(), "b"))
    spread = spread.withColumn("place", place).where(F.col("place") <= k)
    cross = spread.join(mine.select(F.col("rep").alias("a"), "id", "size"), "a", "left").where(F.col("id").isNull() | (F.col("place") <= k + 1 - F.col("size")))
    both = inner.unionByName(cross.select(F.coalesce("id", "a").alias("a"), "b", "similarity"))
    return both.withColumn("position", F.row_number().over(Window.partitionBy("a").orderBy(F.col("similarity").desc(), "b"))).where(F.col("position") <= k)
