"""Sparse codes over a product dictionary, their index, prototypes and attractors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ATOMS, SHORTLIST, ACTIVE = 128, 16, 64
RATE, PENALTY = 0.01, 1e-4
VIGILANCE, MAX_PROTOTYPES = 0.01, 2048


def dictionary(dim: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Two halves of ``ATOMS`` random unit vectors each, of a fixed seed."""
    rng = np.random.default_rng(seed)
    halves = rng.standard_normal((2, ATOMS, dim // 2))
    halves /= np.linalg.norm(halves, axis=2, keepdims=True)
    return halves[0], halves[1]


def encode(x: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features (ascending) and activations of each row: best 16 atoms a half, best 64 pairs, positive part, sum 1."""
    half = x.shape[1] // 2
    a, b = x[:, :half] @ left.T, x[:, half:] @ right.T
    la, lb = np.argsort(-a, axis=1, kind="stable")[:, :SHORTLIST], np.argsort(-b, axis=1, kind="stable")[:, :SHORTLIST]
    both = (np.take_along_axis(a, la, 1)[:, :, None] + np.take_along_axis(b, lb, 1)[:, None, :]).reshape(len(x), -1)
    ids = (la[:, :, None] * ATOMS + lb[:, None, :]).reshape(len(x), -1)
    top = np.lexsort((ids, -both), axis=1)[:, :ACTIVE]
    ids, both = np.take_along_axis(ids, top, 1), np.take_along_axis(both, top, 1)
    order = np.argsort(ids, axis=1)
    ids, both = np.take_along_axis(ids, order, 1), np.maximum(np.take_along_axis(both, order, 1), 0.0)
    return ids, both / np.maximum(both.sum(axis=1, keepdims=True), 1e-9)


def decode(ids: np.ndarray, act: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Activation-weighted sum of the atoms."""
    return np.concatenate([np.einsum("nk,nkd->nd", act, left[ids // ATOMS]), np.einsum("nk,nkd->nd", act, right[ids % ATOMS])], axis=1)


def encoded(rows: DataFrame, dim: int) -> DataFrame:
    """(memory_id, features, activations, error) with the normalised squared error of rebuilding."""
    left, right = dictionary(dim)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array(batch.column("embedding").to_pylist(), dtype=np.float64)
            ids, act = encode(x, left, right)
            error = np.minimum(((x - decode(ids, act, left, right)) ** 2).sum(axis=1) / np.maximum((x * x).sum(axis=1), 1e-9), 1.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("memory_id"), pa.array(ids.tolist(), type=pa.list_(pa.int32())), pa.array(act.tolist(), type=pa.list_(pa.float64())), pa.array(error)], names=["memory_id", "features", "activations", "error"]
            )

    return rows.select("memory_id", "embedding").mapInArrow(run, "memory_id long, features array<int>, activations array<double>, error double")


def train(sample: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One pass of Hebbian updates with a complexity penalty over a bounded sample, in order."""
    left, right, half = left.copy(), right.copy(), sample.shape[1] // 2
    for x in sample:
        ids, act = (v[0] for v in encode(x[None], left, right))
        for f, a in zip(ids, act, strict=True):
            for atoms, at, part in ((left, f // ATOMS, x[:half]), (right, f % ATOMS, x[half:])):
                atoms[at] += RATE * a * ((part - a * atoms[at]) - PENALTY * atoms[at])
                atoms[at] /= max(np.linalg.norm(atoms[at]), 1e-12)
    return left, right


def exploded(codes: DataFrame) -> DataFrame:
    """Posting rows (memory_id, feature, activation)."""
    return codes.select("memory_id", F.explode(F.arrays_zip("features", "activations")).alias("z")).select("memory_id", F.col("z.features").alias("feature"), F.col("z.activations").alias("activation"))


def posting_search(codes: DataFrame, query: list[tuple[int, float]], k: int, state: DataFrame) -> DataFrame:
    """Idf-weighted overlap with the query's features, mixed with strength and arousal.

    The query's features (64 at most) are the small side of the join; scores
    are pre-aggregated per memory.
    """
    spark = codes.sparkSession
    posts = exploded(codes)
    n = codes.count()
    q = F.broadcast(spark.createDataFrame([(int(f), float(a)) for f, a in query], "feature int, q double"))
    df = posts.join(q, "feature").groupBy("feature").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((F.lit(float(n)) + 1.0) / (F.col("df") + 1.0)) + 1.0
    weights = q.join(df, "feature", "left").select("feature", "q", F.when(F.col("df").isNull(), F.log(F.lit((n + 1.0) / 2.0)) + 1.0).otherwise(idf).alias("idf"))
    norm = weights.agg(F.sum(F.col("idf") * F.col("q"))).first()[0] or 1.0
    hits = posts.join(F.broadcast(weights), "feature").groupBy("memory_id").agg((F.sum(F.col("idf") * F.least("q", "activation")) / norm).alias("sparse"))
    score = 0.65 * F.col("sparse") + 0.10 * F.coalesce("strength", F.lit(0.5)) + 0.07 * F.coalesce("arousal", F.lit(0.0))
    return hits.join(state.select("memory_id", "strength", "arousal"), "memory_id", "left").withColumn("score", score).orderBy(F.col("score").desc(), "memory_id").limit(k)


class Prototypes:
    """Adaptive resonance over codes in order of arrival: join the best prototype or found a new one.

    Order matters, so the fold is one task's work (``resonance``); its state
    ends at ``most`` prototypes.
    """

    def __init__(self, vigilance: float = VIGILANCE, most: int = MAX_PROTOTYPES):
        self.vigilance, self.most, self.counts, self.flow = vigilance, most, [], {}
        self.columns = np.zeros((ATOMS * ATOMS, 64))  # a centre per column, with room to grow

    @property
    def centres(self) -> np.ndarray:
        return self.columns[:, : len(self.counts)].T

    def add(self, on, values, count: int = 1) -> int:
        at = len(self.counts)
        if at == self.columns.shape[1]:
            self.columns = np.concatenate([self.columns, np.zeros_like(self.columns)], axis=1)
        self.columns[on, at] = values
        self.counts.append(count)
        return at

    def best(self, code: np.ndarray) -> tuple[int, float]:
        on = np.nonzero(code)[0]
        s = code[on] @ self.columns[on, : len(self.counts)]
        at = int(s.argmax())
        return at, float(s[at])

    def fit(self, codes: list[tuple[list[int], list[float]]], before: int | None = None) -> list[int]:
        """Prototypes of the codes; ``before``: that of the code before the first."""
        out = []
        for ids, act in codes:
            code = np.zeros(ATOMS * ATOMS)
            code[ids] = act
            at, s = self.best(code) if self.counts else (-1, -1.0)
            if self.counts and (s >= self.vigilance or len(self.counts) >= self.most):
                self.counts[at] += 1
                self.centres[at] += (code - self.centres[at]) / self.counts[at]
            else:
                on = np.nonzero(code)[0]
                at = self.add(on, code[on] / max(code.sum(), 1e-9))
            if before is not None and before != at:
                self.flow[before, at] = min(1.0, self.flow.get((before, at), 0.0) + 0.02)
            out.append(at)
            before = at
        return out

    def top_transitions(self, at: int, n: int) -> list[tuple[int, float]]:
        return sorted(((b, w) for (a, b), w in self.flow.items() if a == at), key=lambda x: (-x[1], x[0]))[:n]

    def settle(self, code: np.ndarray, steps: int, blend: float = 0.3) -> np.ndarray:
        """Pull a code towards its prototype and along the strongest transition."""
        for _ in range(steps):
            at, s = self.best(code)
            if s > 0.95:
                break
            code = (1 - blend) * code + blend * self.centres[at]
            for nxt, w in self.top_transitions(at, 1):
                if w > 0.1:
                    code = (1 - blend * w * 0.5) * code + blend * w * 0.5 * self.centres[nxt]
            code = code / max(code.sum(), 1e-9)
        return code


def resonance(codes: DataFrame, vigilance: float = VIGILANCE, most: int = MAX_PROTOTYPES) -> DataFrame:
    """D33 over all codes by memory_id: (memory_id, prototype), then the state as rows without memory_id.

    A state row has the prototype with its count, its centre (features, values)
    and its transitions (nexts, flows). The fold is sequential by definition:
    one task reads the codes in order.
    """

    def run(batches):
        p, before = Prototypes(vigilance, most), None
        for batch in batches:
            if not batch.num_rows:
                continue
            at = p.fit(list(zip(batch.column("features").to_pylist(), batch.column("activations").to_pylist(), strict=True)), before)
            before = at[-1]
            none = pa.nulls(len(at))
            yield pa.RecordBatch.from_arrays([batch.column("memory_id"), pa.array(at, pa.int32()), *[none.cast(t) for _, t in state]], names=["memory_id", "prototype", *[n for n, _ in state]])
        flows: dict[int, list] = {}
        for (a, b), w in p.flow.items():
            flows.setdefault(a, []).append((b, w))
        for i, n in enumerate(p.counts):
            on, to = np.nonzero(p.centres[i])[0], flows.get(i, [])
            row = [n, on.tolist(), p.centres[i][on].tolist(), [b for b, _ in to], [w for _, w in to]]
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([i], pa.int32()), *[pa.array([v], t) for v, (_, t) in zip(row, state, strict=True)]], names=["memory_id", "prototype", *[n for n, _ in state]])

    state = [("count", pa.int64()), ("features", pa.list_(pa.int32())), ("values", pa.list_(pa.float64())), ("nexts", pa.list_(pa.int32())), ("flows", pa.list_(pa.float64()))]
    ordered = codes.select("memory_id", "features", "activations").where(F.col("memory_id").isNotNull()).repartition(1).sortWithinPartitions("memory_id")
    return ordered.mapInArrow(run, "memory_id long, prototype int, count long, features array<int>, values array<double>, nexts array<int>, flows array<double>")


def restored(state: DataFrame, vigilance: float = VIGILANCE, most: int = MAX_PROTOTYPES) -> Prototypes:
    """The prototypes after ``resonance``, from its state rows (``most`` at most)."""
    p = Prototypes(vigilance, most)
    rows = state.where(F.col("memory_id").isNull()).orderBy("prototype").collect()
    for i, r in enumerate(rows):
        p.add(r["features"], r["values"], r["count"])
        p.flow |= {(i, b): w for b, w in zip(r["nexts"], r["flows"], strict=True)}
    return p


def rebuilding_error(rows: DataFrame, left: np.ndarray, right: np.ndarray) -> DataFrame:
    """(error): one row, the summed squared error of rebuilding all vectors."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column("embedding").to_pylist(), dtype=np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([float(((x - decode(*encode(x, left, right), left, right)) ** 2).sum())])], names=["error"])

    return rows.select("embedding").mapInArrow(run, "error double").agg(F.sum("error").alias("error"))


def ranked_transitions(assigned: DataFrame, n: int) -> DataFrame:
    """D35 over all rows: transition counts between prototypes of consecutive memories, top n each."""
    step = assigned.join(assigned.select((F.col("memory_id") - 1).alias("memory_id"), F.col("prototype").alias("next")), "memory_id").where("prototype <> next")
    count = step.groupBy("prototype", "next").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("prototype").orderBy(F.col("n").desc(), "next"))
    return count.withColumn("rank", rank).where(F.col("rank") <= n)
