import random
import re

import pytest

from recollect.llm.near_duplicates import NearDuplicates, least_matches

COLUMNS = "memory_id long, content string, realm string, terms string"


def corpus(seed, n=120):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out = []
    for i in range(n):
        base = r.sample(words, 30)
        out.append((1000 + 10 * i, " ".join(base), r.choice(["a", "a", "b", None])))
        if i % 3 == 0:
            for j in range(1, r.randint(2, 4)):
                edited = base[:]
                for _ in range(r.randint(0, 4)):
                    edited[r.randrange(30)] = r.choice(words)
                r.shuffle(edited)
                out.append((1000 + 10 * i + j, " ".join(edited).upper(), out[-1][2]))
    out += [(5000 + i, "same words here " + ("again " * (i + 1)), "a") for i in range(5)]
    return out + [(9000, "", "a"), (9001, None, "a"), (None, "w1 w2", "a"), (9002, "  . ,", "a"), (1000, "", "a"), (1000, None, None)]


def brute(rows, t):
    once = {}
    for m, c, realm in rows:
        if m is not None:
            a, b = once.get(m, ("", None))
            once[m] = (max(a, c or ""), max((x for x in (b, realm) if x is not None), default=None))
    sets = {m: (set(re.findall(r"[^\W_]{2,}", c.lower())), r) for m, (c, r) in once.items()}
    ids = sorted(m for m, (s, r) in sets.items() if s and r is not None)
    return {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a][1] == sets[b][1] and len(sets[a][0] & sets[b][0]) >= t * len(sets[a][0] | sets[b][0]) - 1e-12}


@pytest.mark.parametrize("run", [2000, 3])
def test_against_brute_force(spark, run):
    rows = corpus(1)
    near = NearDuplicates(spark.createDataFrame([(*r, "x") for r in rows], COLUMNS), 0.6, run)
    got = {tuple(r) for r in near.pairs().collect()}
    want = brute(rows, 0.6)
    assert got <= want and len(got) >= 0.98 * len(want) and want


def test_large_classes_become_stars(spark):
    rows = [(i, "one and the same text", "a", "") for i in range(30)] + [(100, "one and the same text indeed", "a", "")]
    near = NearDuplicates(spark.createDataFrame(rows, COLUMNS))
    got = {tuple(r) for r in near.pairs(expand=10).collect()}
    assert got == {(0, i) for i in range(1, 30)} | {(0, 100)}
    assert len(near.pairs(expand=64).collect()) == 31 * 30 // 2


def test_thresholds_rise_and_spare_similar_pairs():
    need = least_matches(0.6)
    assert need == sorted(need) and need[-1] >= 8
    assert need[0] <= 2


def test_empty(spark):
    assert NearDuplicates(spark.createDataFrame([], COLUMNS)).pairs().count() == 0


def test_very_long_text(spark):
    text = " ".join(f"t{i}" for i in range(30_000))
    rows = [(1, text, "a", ""), (2, text + " more", "a", ""), (3, "short text", "a", "")]
    assert {tuple(r) for r in NearDuplicates(spark.createDataFrame(rows, COLUMNS)).pairs().collect()} == {(1, 2)}


@pytest.mark.parametrize("run", [2000, 16])
def test_large_classes_of_different_texts_are_whole(spark, run):
    words = [f"w{i}" for i in range(12)]
    r = random.Random(3)
    rows = [(i, " ".join(r.sample(words, 12)), "a", "") for i in range(70)]
    rows += [(100 + i, " ".join(r.sample(words, 12)) + " more", "a", "") for i in range(66)] + [(300, " ".join(words + ["else"]), "a", "")]
    got = [tuple(p) for p in NearDuplicates(spark.createDataFrame(rows, COLUMNS), 0.6, run).pairs().collect()]
    assert len(got) == len(set(got)) == 137 * 136 // 2


def test_hot_bands_are_refined_and_lose_nothing(spark):
    """Far more rows in a band than runs: boilerplate texts of one realm, among them true duplicates."""
    r = random.Random(8)
    base = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(160):
        kept = base[:]
        for _ in range(r.randint(2, 14)):
            kept[r.randrange(40)] = f"x{r.randrange(300)}"
        rows.append((i, " ".join(kept), "a"))
    near = NearDuplicates(spark.createDataFrame([(*x, "x") for x in rows], COLUMNS), 0.6, 2)
    got, want = {tuple(x) for x in near.pairs().collect()}, brute(rows, 0.6)
    assert got <= want and len(got) >= 0.995 * len(want) and len(want) > 500
