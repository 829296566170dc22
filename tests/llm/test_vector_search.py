import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.llm import vector_search
from recollect.llm.vector_search import nearest


def data(n, dim=16, seed=0):
    x = np.random.default_rng(seed).standard_normal((n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_recall_over_shards_against_brute_force(spark):
    x = data(1500)
    rows = spark.createDataFrame([(i, [float(v) for v in x[i] * (1 + i % 7)], "e") for i in range(1500)], "id long, vec array<float>, similarity string")
    got = nearest(rows, "id", "vec", 5, dim=16, probes=4, ef=48, shard=200).collect()
    s = x @ x.T
    np.fill_diagonal(s, -2)
    true = {(i, int(j)) for i in range(1500) for j in np.argsort(-s[i])[:5]}
    assert len(true & {(r["id"], r["neighbour"]) for r in got}) >= 0.9 * len(true)
    assert {r["position"] for r in got} == {1, 2, 3, 4, 5}
    some = nearest(rows, "id", "vec", 5, dim=16, probes=4, ef=48, shard=200, queries=lambda i: i % 100 == 0)
    assert {r["id"] for r in some.select("id").distinct().collect()} == set(range(0, 1500, 100))


@pytest.mark.parametrize("visits", [10**6, 100])
def test_cells_are_parted_again_and_visitors_split(spark, monkeypatch, visits):
    """Two levels of cells, and copies of shards that many vectors visit; recall against brute force, fan-out as stated."""
    monkeypatch.setattr(vector_search, "VISITS", visits)
    r = np.random.default_rng(5)
    x = r.standard_normal((30, 16))[r.integers(0, 30, 3000)] + 0.5 * r.standard_normal((3000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(3000)], "id long, vec array<float>")
    got = nearest(rows, "id", "vec", 5, dim=16, probes=4, ef=32, shard=64, max_cells=4).collect()
    s = x @ x.T
    np.fill_diagonal(s, -2)
    true = {(i, int(j)) for i in range(3000) for j in np.argsort(-s[i])[:5]}
    assert len(true & {(r["id"], r["neighbour"]) for r in got}) >= 0.9 * len(true)
    assert len({(r["id"], r["position"]) for r in got}) == len(got) == 15_000


def test_vectors_no_centre_can_part(spark):
    """Vectors that differ in the last bits only fall into one cell on every level; it is cut by id and still searched whole."""
    base = np.zeros(16)
    base[0] = 1.0
    rows = spark.createDataFrame([(i, [float(v) for v in base + 1e-4 * (np.arange(16) == 1 + i % 15) * (1 + i / 300)]) for i in range(300)], "id long, vec array<float>")
    got = nearest(rows, "id", "vec", 3, dim=16, probes=2, ef=32, shard=8, max_cells=2).collect()
    assert len(got) == 900 and min(r["similarity"] for r in got) > 0.999


def test_copies_null_and_unusable_vectors(spark):
    x = data(40)
    v = lambda a: [float(z) for z in a]
    rows = [(i, v(x[i])) for i in range(40)] + [(100 + i, v(x[0])) for i in range(300)] + [(500, v(x[1])), (500, v(x[1]))]
    rows += [(600, None), (601, []), (602, v(x[0])[:8]), (603, [0.0] * 16), (604, [float("nan")] * 16), (605, [float("inf")] * 16), (None, v(x[3]))]
    df = spark.createDataFrame(rows, "id long, vec array<float>")
    got = nearest(df, "id", "vec", 5, dim=16, probes=2, ef=64, shard=30).collect()
    near = {}
    for r in got:
        near.setdefault(r["id"], {})[r["neighbour"]] = r["similarity"]
    assert not set(near) & {None, *range(600, 606)} and len(near) == 341
    assert set(near[100]) == {0, 101, 102, 103, 104} and set(near[399]) == {0, 100, 101, 102, 103} and set(near[0]) == {100, 101, 102, 103, 104}
    assert near[500][1] == pytest.approx(1.0) and near[1][500] == pytest.approx(1.0)
    assert all(len(n) == 5 for n in near.values())


def test_threshold_and_empty(spark):
    x = data(50)
    rows = spark.createDataFrame([(i, [float(z) for z in x[i]]) for i in range(50)] + [(60, [float(z) for z in x[0] + 0.01])], "id long, vec array<float>")
    got = nearest(rows, "id", "vec", 5, dim=16, least=0.95).collect()
    assert {(r["id"], r["neighbour"]) for r in got} == {(0, 60), (60, 0)}
    assert nearest(rows.where(F.lit(False)), "id", "vec", 5, dim=16).count() == 0
