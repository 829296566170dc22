"""Operators that SQL cannot express, against plain loops, round trips and bounds."""

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from recollect.functions import vector as V
from recollect.operators import graph as G
from recollect.operators import recall as R
from recollect.operators import registries as J
from recollect.operators import sparse_codes as P
from recollect.operators import tape as T
from recollect.operators import vectors as W
from recollect.sources.logical import view


def rows(spark, n, dim=16, seed=0):
    x = np.random.default_rng(seed).standard_normal((n, dim))
    return x, spark.createDataFrame([(i, "r", [float(v) for v in x[i]]) for i in range(n)], "memory_id long, realm string, embedding array<float>")


def test_sparse_codes(spark):
    x, df = rows(spark, 60)
    left, right = P.dictionary(16)
    ids, act = P.encode(x, left, right)
    assert (np.diff(ids, axis=1) > 0).all() and (act >= 0).all() and act.sum(axis=1) == pytest.approx(1)
    got = {r["memory_id"]: r for r in P.encoded(df, 16).collect()}
    assert all(0 <= r["error"] <= 1 and len(r["features"]) == P.ACTIVE for r in got.values())
    best = int(np.argmax((x[0, :8] @ left.T)[ids[0] // P.ATOMS] + (x[0, 8:] @ right.T)[ids[0] % P.ATOMS]))
    assert act[0].argmax() == best
    before = ((x - P.decode(ids, act, left, right)) ** 2).sum()
    l2, r2 = P.train(x, left, right)
    assert ((x - P.decode(*P.encode(x, l2, r2), l2, r2)) ** 2).sum() < before
    assert np.linalg.norm(l2, axis=1) == pytest.approx(1)


def test_prototypes():
    a, b = ([1, 2, 3], [0.4, 0.3, 0.3]), ([100, 200, 300], [0.4, 0.3, 0.3])
    p = P.Prototypes(vigilance=0.1)
    assert p.fit([a, b, a, b, a]) == [0, 1, 0, 1, 0]
    assert p.top_transitions(0, 3)[0][0] == 1
    assert P.Prototypes(vigilance=0.1, most=1).fit([a, b, a]) == [0, 0, 0]
    code = np.zeros(P.ATOMS * P.ATOMS)
    code[[1, 2]] = 0.5
    done = p.settle(code, 5)
    assert done[3] > 0 and done.sum() == pytest.approx(1)


def test_quantisation(spark):
    x, df = rows(spark, 200)
    coarse, fine = (W.pq_encode(df, W.pq_train(x, 4, k)).agg(F.sum("error")).first()[0] for k in (2, 32))
    assert fine < coarse < (x**2).sum()
    book = W.pq_train(x, 4, 8)
    r = W.pq_encode(df, book).where("memory_id = 7").first()
    want = [int(((x[7, s * 4 : s * 4 + 4] - book[s]) ** 2).sum(axis=1).argmin()) for s in range(4)]
    assert list(r["code"]) == want


def test_relaxation_moves_towards_the_candidates(spark):
    x, df = rows(spark, 30)
    out = R.hopfield(df, x[3], 5, beta=50.0)
    assert out[0][0] == 3 and out[0][1] > 0.99 and [s for _, s in out] == sorted((s for _, s in out), reverse=True)
    assert R.hopfield(df.limit(0), x[3], 5) == []


def test_block_search_is_exact(spark, monkeypatch):
    monkeypatch.setattr(W, "QUERY_BLOCK", 7)
    x, df = rows(spark, 120)
    got = {(r["src"], r["dst"]) for r in W.block_search(df, df.where("memory_id % 5 = 0"), 4).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    assert got == {(i, int(j)) for i in range(0, 120, 5) for j in np.argsort(-s[i])[:4]}


def test_sign_codes(spark):
    x, df = rows(spark, 40, 128)
    got = {r["memory_id"]: r["c"] for r in df.select("memory_id", V.sign_bits(F.col("embedding"), 128).alias("c")).collect()}
    for i in range(40):
        bits = [(got[i][w] >> b) & 1 for w in range(2) for b in range(64)]
        assert bits == [int(v >= 0) for v in x[i].astype(np.float32)]


def test_q_values_of_one_session(spark):
    tape = spark.createDataFrame([(0, 1, "a", 0, "x"), (1, 1, "b", 1, "x"), (2, 1, "a", 0, "x")], "turn long, session_id long, tool string, outcome int, entity string")
    got = {r["sym"]: (r["q"], r["visits"]) for r in T.q_values(tape).collect()}
    a = 0.1 * 1.0
    b = 0.1 * (-1.0 + 0.9 * a)
    a = a + 0.1 * (1.0 - a)
    assert got == {"a|0|x": (pytest.approx(a), 2), "b|1|x": (pytest.approx(b), 1)}


def test_free_energy_falls_on_a_steady_tape(spark):
    tape = spark.createDataFrame([(i, 1, "a", 0, "x") for i in range(40)], "turn long, session_id long, tool string, outcome int, entity string")
    e = [r["free_energy"] for r in T.free_energy(tape).orderBy("turn").collect()]
    assert e[-1] < e[0] / 3 and all(v >= 0 for v in e)


def test_surprise_credit_gates(spark):
    df = spark.createDataFrame([(1, i, i, 1.0, 1) for i in range(3)] + [(2, 9, 9, 0.1, 1), (3, 0, 0, 1.0, 1), (3, 1, 1, 1.0, -1)], "memory_id long, id long, ts_ms long, magnitude double, dir int")
    got = sorted((r["memory_id"], r["id"], round(r["delta"], 6), round(r["credit"], 6)) for r in J.surprise_credit(df).collect())
    assert [g[:2] for g in got] == [(1, 1), (1, 2)]
    assert got[0][2:] == (0.08, round(1.85 * 0.35, 6))


def test_supersession_chain_stops_at_a_ring(spark):
    s = spark.createDataFrame([(1, 2, 0), (2, 3, 0), (3, 1, 0)], "old_id long, new_id long, at_ms long")
    assert [tuple(r) for r in G.chain(s, 1).collect()] == [(1, 2), (2, 3)]


def test_bitemporal_literals(spark):
    t = spark.createDataFrame([(1, "s", "p", "a", 1.0, 100, 0, 100), (2, "s", "p", "b", 1.0, 200, 300, 250)], "id long, subject string, predicate string, object string, weight double, valid_from_ms long, valid_to_ms long, ingested_ms long")
    sup = spark.createDataFrame([(1, 2, 200)], "old_id long, new_id long, at_ms long")
    at = lambda f, ms: {r["id"] for r in f(t, sup, ms).collect()}
    assert [at(G.as_of, m) for m in (50, 150, 250, 350)] == [set(), {1}, {2}, set()]
    assert [at(G.believed_at, m) for m in (50, 150, 220, 260)] == [set(), {1}, set(), {2}]


def test_two_means_splits(spark):
    halves = {r["half"]: r["n"] for r in J.split_large(view(spark, SF, "vectors"), "realm", 10).groupBy("half").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert set(halves) == {0, 1} and sum(halves.values()) == 500
