import random
from datetime import datetime, timedelta

import pytest

from recollect.operators.components import components
from recollect.operators.hierarchy import descendants, hierarchy, levels

COLUMNS = "id bigint, parent_id bigint, recorded_at timestamp_ntz, status string"
T = datetime(2025, 1, 1)


def brute(rows):
    last = {}
    for i, p, t, _ in rows:
        if i is not None:
            key = (t, (p or 0) != 0, p or 0)
            if i not in last or key > last[i]:
                last[i] = key
    parent = {i: (k[2] if k[2] in last else None) if k[2] else None for i, k in last.items()}
    out = set()
    for i in parent:
        path, at = [i], i
        while parent[at] is not None and len(path) <= len(parent):
            at = parent[at]
            path.append(at)
        out.add((i, 0, -1, "") if len(path) > len(parent) else (i, at, len(path) - 1, "/".join(map(str, reversed(path)))))
    return out


def rows_of(df):
    return {tuple(r) for r in df.select("id", "root_id", "depth", "path").collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_forests_with_rings(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice([None, *range(1, 80)]), r.choice([None, 0, 999, *range(1, 80)]), T + timedelta(days=r.randint(0, 5)), "Active") for _ in range(160)]
    rows += [(200 + i, 199 + i if i else None, T, "Active") for i in range(25)] + [(400 + i, 200, T, "Active") for i in range(200)] + [(700, 700, T, "Active")]
    tree = hierarchy(spark.createDataFrame(rows, COLUMNS))
    assert rows_of(tree) == brute(rows)
    pairs = {tuple(p) for p in descendants(levels(spark.createDataFrame(rows, COLUMNS))).collect()}
    want = {(int(a), i, d - n) for i, _, d, path in brute(rows) if d > 0 for n, a in enumerate(path.split("/")[:-1])}
    assert pairs == want


def test_empty(spark):
    assert hierarchy(spark.createDataFrame([], COLUMNS)).count() == 0


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(40)] + [(None, 3), (5, 5)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
