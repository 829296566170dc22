import math
import random
from collections import Counter, defaultdict

import pytest
from compare import same
from conftest import SF

from recollect.llm import registered as R
from recollect.llm.fusion import best, fuse, positions
from recollect.llm.weighting import characteristic, least_weight, log_entropy


@pytest.mark.parametrize("name", sorted(R.SQL))
def test_against_sql(spark, duck, name):
    same(R.QUERIES[name](spark, SF), duck.execute(R.SQL[name]))


def brute(rows):
    hits = {}
    for q, m, *s in rows:
        if q is not None and m is not None:
            old = hits.get((q, m), [None, None])
            s = [None if x is None or math.isnan(x) else x for x in s]
            hits[q, m] = [max((x for x in (a, b) if x is not None), default=None) for a, b in zip(old, s, strict=True)]
    by = defaultdict(dict)
    for (q, m), s in hits.items():
        by[q][m] = s
    low = -math.inf
    rank = lambda all_, i, v: 1 + sum((x[i] if x[i] is not None else low) > (v if v is not None else low) for x in all_)
    return {(q, m): sum(1 / (60 + rank(ms.values(), i, s[i])) for i in range(2)) for q, ms in by.items() for m, s in ms.items()}


@pytest.mark.parametrize("hot_rows,splits", [(10**6, 8), (20, 4), (20, 64)])
def test_fusion_with_hot_queries_ties_and_gaps(spark, hot_rows, splits):
    r = random.Random(5)
    score = lambda: r.choice([None, float("nan"), 1.0, 1.0, r.random(), r.random() * 1e9, -r.random()])
    rows = [(r.choice([1, 1, 1, 2, None]), r.choice([None, *range(150)]), score(), score()) for _ in range(400)]
    df = spark.createDataFrame([(*x, "a") for x in rows], "q long, m long, a double, b double, a_rank string")
    fused = fuse(df, "q", "m", ["a", "b"], hot_rows=hot_rows, splits=splits)
    want = brute(rows)
    assert {(x["q"], x["m"]): pytest.approx(x["rrf"]) for x in fused.collect()} == want
    place = {(x["q"], x["m"]): x["position"] for x in positions(fused, "q", "m", hot_rows).collect()}
    for q in {q for q, _ in want}:
        got = [want[k] for k in sorted((k for k in want if k[0] == q), key=place.get)]
        assert got == pytest.approx(sorted(got, reverse=True)) and sorted(place[k] for k in want if k[0] == q) == list(range(1, len(got) + 1))
    first = {q: min((-v, m) for (p, m), v in want.items() if p == q)[1] for q, _ in want}
    got = {x["q"]: x["m"] for x in best(fused, "q", "m").collect()}
    assert all(want[q, got[q]] == pytest.approx(want[q, first[q]]) for q in first) and got.keys() == first.keys()


def test_fusion_ignores_ranges(spark):
    rows = [(1, 1, 0.9, 10.0), (1, 2, 0.8, 1e12), (1, 3, 0.1, 11.0)]
    a = best(fuse(spark.createDataFrame(rows, "q long, m long, a double, b double"), "q", "m", ["a", "b"]), "q", "m").first()["m"]
    b = best(fuse(spark.createDataFrame([(q, m, x * 1e6, y / 1e12) for q, m, x, y in rows], "q long, m long, a double, b double"), "q", "m", ["a", "b"]), "q", "m").first()["m"]
    assert a == b == 2


def test_weights(spark):
    texts = {1: "Red red red fox", 2: "red dog", 3: "x a", 4: None, 5: "", 6: "fox fox und Ünder"}
    df = spark.createDataFrame([(k, v, 1) for k, v in texts.items()] + [(1, "", 2), (1, None, 3), (None, "red", 4)], "memory_id long, content string, tf long")
    got = {(r["memory_id"], r["term"]): (r["tf"], r["df"], r["weight"]) for r in log_entropy(df).collect()}
    docs = {1: Counter(red=3, fox=1), 2: Counter(red=1, dog=1), 6: Counter(fox=2, und=1, ünder=1)}
    for d, c in docs.items():
        for t, tf in c.items():
            spread = [x[t] for x in docs.values() if x[t]]
            p = [x / sum(spread) for x in spread]
            h = -sum(x * math.log(x) for x in p)
            assert got[d, t] == (tf, len(spread), pytest.approx(math.log1p(tf) * (1 - h / math.log(3))))
    assert len(got) == sum(map(len, docs.values()))


def test_the_weight_selects_and_loses_nothing(spark):
    r = random.Random(4)
    texts = [(i, " ".join(r.choice([f"t{r.randrange(60)}"] * 2 + ["all"]) for _ in range(r.randint(0, 90)))) for i in range(40)]
    df = spark.createDataFrame(texts, "memory_id long, content string")
    every = log_entropy(df).collect()
    want = {(x["memory_id"], x["term"]) for x in every if x["tf"] >= 3 and x["df"] <= 20}
    least = least_weight(3, 20, len({x["memory_id"] for x in every}))
    assert {(x["memory_id"], x["term"]) for x in characteristic(df, 3, 20).collect()} == want and want
    assert all(x["weight"] >= least - 1e-9 for x in every if (x["memory_id"], x["term"]) in want)
    assert any(x["weight"] < least for x in every)


def test_positions_split_ties(spark):
    rows = spark.range(3000).selectExpr("CAST(1 AS BIGINT) AS q", "id AS m", "0.5D AS rrf")
    got = positions(rows, "q", "m", hot_rows=100).collect()
    assert all(x["position"] == x["m"] + 1 for x in got) and len(got) == 3000


def test_empty(spark):
    assert log_entropy(spark.createDataFrame([], "memory_id long, content string")).count() == 0
    assert fuse(spark.createDataFrame([], "q long, m long, a double"), "q", "m", ["a"]).count() == 0
