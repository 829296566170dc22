"""Operators do their whole job: brute force where an earlier cut lost rows."""

import numpy as np
import pytest

from recollect.operators import graph as G
from recollect.operators import recall as R
from recollect.operators import sparse_codes as P
from recollect.plans import graph_queries, memory_queries, recall_queries


@pytest.mark.parametrize("block", [2048, 7])
def test_near_duplicate_losers_are_all(spark, monkeypatch, block):
    monkeypatch.setattr(R, "BAND_BLOCK", block)
    rng = np.random.default_rng(1)
    base = {r: rng.standard_normal(8) for r in ("a", "b")}
    rows = [(i, r, (base[r] + 0.12 * rng.standard_normal(8)).tolist()) for i, r in enumerate(["a"] * 60 + ["b"] * 20)] + [(900, None, base["a"].tolist())]
    x = {i: np.array(v) / np.linalg.norm(v) for i, _, v in rows}
    want = {}
    for i, r, _ in rows:
        near = [j for j, q, _ in rows if j < i and r is not None and q == r and 0.88 <= x[i] @ x[j] < 0.9999]
        if near:
            want[i] = (min(near), round(max(x[i] @ x[j] for j in near), 9))
    got = R.near_duplicate_losers(spark.createDataFrame(rows, "memory_id long, realm string, embedding array<double>")).collect()
    assert {r["loser"]: (r["keep"], round(r["similarity"], 9)) for r in got} == want
    assert len(got) == len(want) > 40


def test_conflicts_ask_with_every_memory(spark, monkeypatch):
    rows = [(1, "r1", [1.0, 0.0]), (2, "r1", [0.9, 0.1]), (3, "r2", [0.0, 1.0]), (5, "r2", [0.1, 0.9])]
    vectors = spark.createDataFrame(rows, "memory_id long, realm string, embedding array<double>")
    memory = spark.createDataFrame([(1, "term"), (2, "relay"), (3, "term"), (5, "relay")], "memory_id long, harness string")
    monkeypatch.setattr(recall_queries, "_vec", lambda s, d: vectors)
    monkeypatch.setattr(recall_queries, "_mem", lambda s, d: memory)
    assert {(r["a"], r["b"]) for r in recall_queries.e_harness_conflicts(spark, "").collect()} == {(1, 2), (3, 5)}


def test_prototypes_and_errors_are_of_all_rows(spark, monkeypatch):
    x = np.random.default_rng(2).standard_normal((620, 64))
    x[520:] += 4.0
    vectors = spark.createDataFrame([(i, "r", v.tolist()) for i, v in enumerate(x)], "memory_id long, realm string, embedding array<double>")
    monkeypatch.setattr(recall_queries, "_vec", lambda s, d: vectors)
    left, right = P.dictionary(64)
    ids, act = P.encode(x, left, right)
    p = P.Prototypes(0.008)
    want = p.fit([(list(map(int, i)), list(a)) for i, a in zip(ids, act, strict=True)])
    found = recall_queries._prototypes(spark, "")
    assert [r["prototype"] for r in found.where("memory_id IS NOT NULL").orderBy("memory_id").collect()] == want
    assert [r["prototype"] for r in recall_queries.d_prototypes(spark, "").orderBy("memory_id").collect()] == want
    q = P.restored(found, 0.008)
    assert np.allclose(q.centres, p.centres) and q.flow == p.flow and q.counts == p.counts
    row = recall_queries.d_trained_dictionary(spark, "").first()
    assert row["before"] == pytest.approx(((x - P.decode(ids, act, left, right)) ** 2).sum())


def test_pairs_of_sets_are_of_the_whole_tape(spark, monkeypatch):
    tape = [(t, t * 7 % 5, "view" if t % 2 else "click") for t in range(20)]
    monkeypatch.setattr(graph_queries, "view", lambda s, d, name: spark.createDataFrame(tape, "turn long, session_id long, tool string"))
    counts, weights = {}, {}
    for t, m, _ in tape:
        for u, o, _ in tape:
            if t // 6 == u // 6 and m < o:
                counts[m, o] = counts.get((m, o), 0) + 1
            if t // 6 == u // 6 and t < u:
                weights[m, o] = weights.get((m, o), 0.0) + 0.02
                weights[o, m] = weights.get((o, m), 0.0) + 0.006
    assert {(r["a"], r["b"]): r["n"] for r in graph_queries.g_coactivation(spark, "").collect()} == counts
    assert {(r["src"], r["dst"]): r["weight"] for r in graph_queries.g_couplings(spark, "").collect()} == {k: round(min(v, 1.0), 6) for k, v in weights.items()}


def test_ppr_keeps_seeds_and_the_nearest_and_converges(spark, monkeypatch):
    edges = [(90, 80, 0.9), (90, 70, 0.8), (90, 60, 0.1), (80, 1, 1.0), (1, 2, 1.0), (70, 90, 0.5), (80, 90, 0.5)]
    df = spark.createDataFrame([(a, b, "SameSession", w) for a, b, w in edges], "src long, dst long, type string, weight double")
    assert {r["memory_id"] for r in G.ppr_lane(df, [90], [1.0], most=3).collect()} == {80, 70}
    assert {r["memory_id"] for r in G.ppr_lane(df, [90], [1.0], most=5).collect()} == {80, 70, 60, 1}
    ring = [(1, 5, 1.0), (5, 30, 1.0), (30, 40, 1.0), (40, 1, 1.0), (40, 5, 0.5)]
    monkeypatch.setattr(graph_queries, "_edge", lambda s, d: spark.createDataFrame([(a, b, "SameSession", w) for a, b, w in ring], "src long, dst long, type string, weight double"))
    p = start = {1: 0.5, 5: 0.3, 30: 0.2, 40: 0.0}
    for _ in range(25):
        new = {n: 0.15 * start[n] for n in start}
        for a, b, w in ring:
            new[b] += 0.85 * p[a] * w / sum(x for c, _, x in ring if c == a)
        moved, p = sum(abs(new[n] - p[n]) for n in p), new
        if moved < 1e-4:
            break
    assert {r["memory_id"]: r["score"] for r in graph_queries.e_ppr(spark, "").collect()} == {40: pytest.approx(p[40], abs=1e-6)}


def test_seeds_are_of_the_whole_text(spark, monkeypatch):
    text = "plain words " * 30 + 'then @late and "a quotation" by Name'
    monkeypatch.setattr(memory_queries, "_note", lambda s, d: spark.createDataFrame([(1, text)], "memory_id long, content string"))
    assert {r["seed"] for r in memory_queries.c_seeds(spark, "").collect()} == {"late", "a quotation", "Name"}


def test_graph_lane_brings_in_what_no_lane_found(spark):
    hits = spark.createDataFrame([(1, 0.9), (2, 0.8), (3, 0.1)], "memory_id long, score double")
    edges = spark.createDataFrame([(1, 50, "SameSession", 1.0), (2, 50, "SameSession", 1.0), (1, 60, "SameSession", 0.1), (1, 3, "SameSession", 0.5)], "src long, dst long, type string, weight double")
    allowed = spark.createDataFrame([(1,), (2,), (3,), (50,)], "memory_id long")
    got = {r["memory_id"]: r["score"] for r in R.with_graph_lane(hits, edges, allowed, 10).collect()}
    assert got == {1: pytest.approx(1 / 61), 2: pytest.approx(1 / 62), 3: pytest.approx(1 / 63), 50: pytest.approx(1 / 61)}
    one = hits.where("memory_id = 1")
    assert [tuple(r) for r in R.with_graph_lane(one, edges, allowed, 10).collect()] == [(1, 0.9)]
