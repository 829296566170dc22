import tracemalloc

import numpy as np
import pytest

from recollect.operators import hnsw
from recollect.operators.hnsw import Hnsw


def data(n, dim=16, seed=0):
    x = np.random.default_rng(seed).standard_normal((n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_graph_recall():
    x = data(3000).astype(np.float32)
    g = Hnsw(x)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    true = np.argsort(-s, axis=1)[:, :5]
    found, sim = g.search(x, 6, 32, np.arange(3000))
    assert (found[:, 0] == np.arange(3000)).all() and (np.diff(sim, axis=1) <= 1e-6).all()
    assert np.mean([len(set(a) & set(b[1:])) for a, b in zip(true, found, strict=True)]) / 5 > 0.97
    q = data(200, seed=1).astype(np.float32)
    true = np.argsort(-(q @ x.T), axis=1)[:, :5]
    found, _ = g.search(q, 5, 64)
    assert np.mean([len(set(a) & set(b)) for a, b in zip(true, found, strict=True)]) / 5 > 0.95


@pytest.mark.parametrize("n", [1, 2, 3, 30])
def test_small_graphs(n):
    x = data(n).astype(np.float32)
    found, _ = Hnsw(x).search(x, 5, 8, np.arange(n))
    assert (np.sort(found, axis=1)[:, -min(n, 5) :] >= 0).all()


def test_layers_and_entries():
    g = Hnsw(data(5000).astype(np.float32))
    sizes = [int((layer.ids[:, 0] >= 0).sum()) for layer in g.layers]
    assert sizes[0] == 5000 and all(a > 4 * b for a, b in zip(sizes, sizes[1:], strict=False)) and len(g.top) <= hnsw.SCAN
    for layer in g.layers:  # every edge lies in the layer, none leads home, none is double
        rows = np.nonzero(layer.ids[:, 0] >= 0)[0]
        for r in rows[:200]:
            out = layer.ids[r][layer.ids[r] >= 0]
            assert r not in out and len(set(out)) == len(out) and (layer.ids[out, 0] >= 0).all()


def test_nothing_is_compared_with_all(monkeypatch):
    """Similarities computed while building stay far below all pairs."""
    seen = []
    real = np.einsum
    monkeypatch.setattr(np, "einsum", lambda f, a, b: (seen.append(len(a)), real(f, a, b))[1])
    n = 8000
    Hnsw(data(n).astype(np.float32))
    assert sum(seen) + n * hnsw.BATCH < n * n / 3


def plain_walk(g, q, entry, ef):
    """The walk of one query on the lowest layer, step by step: similarities of its beam, best first."""
    sim = {int(i): float(np.einsum("d,d->", g.x[i], q)) for i in entry}
    beam, seen, done = sorted(sim, key=lambda i: -sim[i])[:ef], set(sim), set()
    while step := [i for i in beam if i not in done][: hnsw.EXPAND]:
        done |= set(step)
        fresh = {int(j) for i in step for j in g.layers[0].ids[i] if j >= 0} - seen
        seen |= fresh
        sim |= {j: float(np.einsum("d,d->", g.x[j], q)) for j in fresh}
        beam = sorted(beam + list(fresh), key=lambda i: -sim[i])[:ef]
    return [sim[i] for i in beam]


def test_walk_step_by_step_and_its_work():
    """The same as a plain walk, and the beam of a query is read once a step, not once for every candidate."""
    x = data(3000).astype(np.float32)
    g = Hnsw(x)
    found, sim = g.search(x, 20, 24, np.arange(3000))
    for i in range(0, 3000, 100):
        assert np.allclose(sim[i], plain_walk(g, x[i], [i], 24)[:20], atol=1e-6)
    queries = data(1024, seed=1).astype(np.float32)
    tracemalloc.start()
    g.search(queries, 5, 512)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6  # a beam read for every candidate takes about 160 MB here
