import random
import time
from collections import Counter

import numpy as np
import pytest
from conftest import SF

from recollect.llm import registered as R
from recollect.llm.packing import CLASSES, kept_short, nnls, pack, patterns, plan_patterns, plan_rest
from recollect.llm.tokenize import _tokenizer, decode, encode, vocabulary

ODD = [
    "a  b", "  x", "  y z\u0085q", "I'll don't 'S 'LL we've", "éx", "<|endoftext|> hi", "\n\n x\t\ty   ", "Ᲊ \U0001fae8 ok", "x" * 5000, " ", "᠎ a",
    "　　b", "½¾ 12३१", "\x1c\x1d \x00z", "\U0001f469‍\U0001f680 ok", None, "", "the the the", "a b  c", "__init__ --x==y", "  \n", "１２３ abc١",
]


def texts(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, ids string")


@pytest.mark.parametrize("frequent", [1, 65_536])
def test_same_as_the_tokenizer(spark, frequent):
    rows = [(i, x, "clash") for i, x in enumerate(ODD)] + [(100, "the the the", ""), (100, "other text", "")]
    got = sorted((r["doc_id"], list(r["ids"])) for r in encode(texts(spark, rows), frequent=frequent).collect())
    t = _tokenizer(vocabulary())
    assert got == sorted((i, t.encode(x or "", add_special_tokens=False).ids) for i, x, _ in rows)


def test_round_trip(spark):
    rows = [(i, x, "") for i, x in enumerate(ODD)]
    back = {r["doc_id"]: r["text"] for r in decode(encode(texts(spark, rows))).collect()}
    assert back == {i: x or "" for i, x, _ in rows}


def test_corpus(spark):
    t = _tokenizer(vocabulary())
    want = {r["doc_id"]: t.encode(r["text"] or "", add_special_tokens=False).ids for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r["doc_id"]: list(r["ids"]) for r in R.p8_ids(spark, SF).collect()} == want


def test_empty_table(spark):
    assert encode(texts(spark, [])).count() == 0


def test_nnls():
    rng = np.random.default_rng(1)
    a = rng.random((20, 40))
    b = rng.random(20)
    x = nnls(a, b)
    gain = a.T @ (b - a @ x)
    assert (x >= 0).all() and (gain < 1e-6).all() and abs(gain[x > 1e-9]).max() < 1e-6


def test_repeated_rows_share_their_rare_words(spark):
    text = " ".join(f"word{i}x{i * i}" for i in range(40))
    rows = [(1, text, "")] * 3000 + [(2, text + " else", "")]
    out = encode(texts(spark, rows), frequent=1)
    t = _tokenizer(vocabulary())
    want = {1: t.encode(text, add_special_tokens=False).ids, 2: t.encode(text + " else", add_special_tokens=False).ids}
    got = out.groupBy("doc_id", "ids").count().collect()
    assert {r["doc_id"]: list(r["ids"]) for r in got} == want and {r["doc_id"]: r["count"] for r in got} == {1: 3000, 2: 1}


@pytest.mark.parametrize("classes,parts", [(16, 3), (37, 3), (16, 2), (1, 1)])
def test_patterns_fill_exactly(classes, parts):
    found = patterns(classes, parts, np.ones(classes + 1, dtype=bool))
    assert all(sum(c * n for c, n in p) == classes and len(p) <= parts for p in found) and len(found) == len(set(found))
    assert all([c for c, _ in p] == sorted({c for c, _ in p}, reverse=True) for p in found)
    pairs = {((a, i), (b, j)) for a in range(1, classes) for b in range(1, a) for i in range(1, classes) for j in range(1, classes) if a * i + b * j == classes}
    assert parts < 2 or pairs <= set(found)


@pytest.mark.parametrize("capacity,share", [(1000, 0.5), (2000, 0.5), (2048, 0.5), (37, 0.5), (131_072, 0.0)])
def test_plans_of_any_capacity(capacity, share):
    """On lengths like those of texts: most items by patterns, near the least number of containers, soon done."""
    r = np.random.default_rng(capacity)
    sizes = np.minimum(np.maximum(r.lognormal(np.log(min(capacity, 2048) / 14), 0.9, 20_000).astype(int), 1), capacity)
    classes, begun = min(CLASSES, capacity), time.monotonic()
    cls = (sizes * classes + capacity - 1) // capacity
    count, total = np.bincount(cls, minlength=classes + 1).astype(float), np.bincount(cls, sizes, minlength=classes + 1)
    plan = plan_patterns(np.where(kept_short(count, total, capacity), 0, count))
    stock = {c: sizes[cls == c].tolist() for c in range(classes + 1)}
    free, placed = Counter(), 0
    for pattern, n in plan:
        for _ in range(n):
            taken = [stock[c].pop() for c, times in pattern for _ in range(times)]
            assert sum(taken) <= capacity
            placed += len(taken)
            free[capacity - sum(taken)] += 1
    rest = Counter(x for left in stock.values() for x in left)
    _, fresh = plan_rest(dict(rest), dict(free), capacity)
    assert time.monotonic() - begun < 10
    assert sum(n for _, n in plan) + fresh <= 1.01 * -(-sizes.sum() // capacity) + 1
    assert placed >= share * len(sizes)


def best_fit(sizes, capacity):
    """Containers of plain best fit, longest first: many items exceed half, so the volume is no reachable bound."""
    free = []
    for n in sorted(sizes, reverse=True):
        at = min((i for i, f in enumerate(free) if f >= n), key=lambda i: free[i], default=None)
        if at is None:
            free.append(capacity - n)
        else:
            free[at] -= n
    return len(free)


@pytest.mark.parametrize("seed,most", [(1, 300), (2, 90), (3, 64)])
def test_packing_is_whole_and_tight(spark, seed, most):
    r = random.Random(seed)
    sizes = {i: r.choice([0, None, 40, r.randint(1, most), r.randint(1, 20)]) for i in range(1500)}
    out = pack(spark.createDataFrame([*sizes.items(), (None, 5)], "doc_id long, n_tokens int"), 64, classes=32).collect()
    fill, parts = {}, {}
    for x in sorted(out, key=lambda x: (x["container_id"], x["start"])):
        assert x["start"] == fill.get(x["container_id"], 0)
        fill[x["container_id"]] = x["start"] + x["n_tokens"]
        parts.setdefault(x["doc_id"], []).append((x["part"], x["n_tokens"]))
    assert max(fill.values()) <= 64
    assert {i: sum(n for _, n in p) for i, p in parts.items()} == {i: n for i, n in sizes.items() if n}
    for i, p in parts.items():
        p = sorted(p)
        assert [k for k, _ in p] == list(range(-(-sizes[i] // 64))) and all(n == 64 for _, n in p[:-1])
    assert len(fill) <= 1.01 * best_fit([n for p in parts.values() for _, n in p], 64)
    assert sorted(fill) == list(range(len(fill)))


def test_one_hot_length(spark):
    out = pack(spark.range(1000).selectExpr("id AS doc_id", "20 AS n_tokens"), 64, classes=32)
    assert out.select("container_id").distinct().count() == 334


def test_nothing_to_pack(spark):
    assert pack(spark.createDataFrame([(1, 0), (2, None)], "doc_id long, n_tokens int"), 64, classes=32).count() == 0
    fill = R.p9_fill(spark, SF).first()
    assert fill["filled"] > 0.9 and 0 <= fill["by_pattern"] <= 1
