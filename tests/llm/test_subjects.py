import random
import time
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from recollect.llm.subjects import LIFT, RAISE, _least_confidence, classify, fit, mine, pooled, prepared, segments

AREAS = {
    "sea": ["harbour", "sailor", "anchor", "tide", "vessel", "mast"],
    "hill": ["summit", "ridge", "climber", "slope", "cairn", "valley"],
    "city": ["tram", "market", "pavement", "tower", "square", "traffic"],
}
TALK = ["the note recalls the thread", "each session keeps its own trace", "later the digest mentions the note"]


def sentence(r, area):
    a, b, c = r.sample(AREAS[area], 3)
    return r.choice([f"the {a} and the {b} belong with the {c}", f"remember that a {a} near the {b} takes the {c}"])


def document(r, areas, talk):
    parts = [sentence(r, a) for a in areas] + [r.choice(TALK) for _ in range(talk)]
    r.shuffle(parts)
    return r.choice([". ", "\n", "; "]).join(parts)


def corpus(seed, n):
    r, docs, truth = random.Random(seed), [], {}
    for i in range(n):
        main = r.choice(list(AREAS))
        more = [r.choice([a for a in AREAS if a != main])] if r.random() < 0.3 else []
        docs.append((i, document(r, [main] * 5 + more * 4, r.randint(0, 4)), "en", i))
        truth[i] = {main, *more}
    return docs, truth


def test_held_out_accuracy_and_odd_texts(spark):
    docs, truth = corpus(1, 500)
    odd = [(9001, None, None, 0), (9002, "", "en", 0), (9003, "   ", "en", 0), (9004, " ".join(["the note recalls the thread."] * 3000), None, 0)]
    df = spark.createDataFrame(docs + odd, "doc_id long, text string, lang string, area long")
    r = random.Random(2)
    labels = [(i, r.choice(sorted(truth[i])) if len(truth[i]) == 1 and r.random() > 0.03 else r.choice(list(AREAS))) for i in range(250) if len(truth[i]) == 1]
    labels += labels[:20] + [(None, "sea"), (7, None), (424242, "sea")]
    ready = prepared(df, spark.createDataFrame(labels, "doc_id long, area string"))
    got = {}
    for x in classify(ready, fit(ready)).collect():
        got.setdefault(x["doc_id"], set()).add(x["area"])
    right = sum(got.get(i, set()) == truth[i] for i in range(250, 500))
    assert right >= 0.95 * 250
    assert not {9001, 9002, 9003, 9004} & set(got)


def test_without_labels(spark):
    docs, _ = corpus(1, 5)
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, area long")
    for rows, labels in ((df, []), (df.where("doc_id < 0"), [(1, "sea")])):
        ready = prepared(rows, spark.createDataFrame(labels, "doc_id long, area string"))
        assert classify(ready, fit(ready)).count() == 0


def test_shared_phrases_do_not_multiply(spark):
    """Sixty terms that occur together in every document of an area: patterns are pairs, not 2^60 sets."""
    phrase = {a: " ".join(f"{a}{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)) for a in AREAS}
    docs = [(i, phrase[a] + ". " + TALK[0], "en") for i, a in enumerate(list(AREAS) * 5)]
    begun = time.monotonic()
    ready = prepared(spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame([(i, a) for i, a in enumerate(list(AREAS) * 5)], "doc_id long, area string"))
    got = {x["doc_id"]: x["area"] for x in classify(ready, fit(ready)).collect()}
    assert time.monotonic() - begun < 30 and got == {i: a for i, a in enumerate(list(AREAS) * 5)}


def longer_rules(rules):
    """{(terms, area): weight} of the rules of two terms and more."""
    out, names = {}, [(i,) for i in range(len(rules.terms))]
    for keys, weights in rules.longer:
        names = [(*names[k // len(rules.terms)], int(k % len(rules.terms))) for k in keys.tolist()]
        out |= {(tuple(rules.terms[i] for i in t), rules.areas[a]): w[a] for t, w in zip(names, weights, strict=True) for a in np.nonzero(w)[0]}
    return out


def test_growth_gives_the_rules_of_every_length(spark):
    """Against counting every set of terms: each term says little, and more of them say more."""
    r, known = random.Random(4), []
    terms = ["ash", "birch", "cedar", "elder", "fir", "gorse", "hazel", "ivy"]
    likely = {"sea": 0.5, "hill": 0.3} | dict.fromkeys(["city", "moor", "lake", "farm", "mine", "wood"], 0.12)
    for i in range(4000):
        area = list(likely)[i % len(likely)]
        some = [t for t in terms if r.random() < likely[area]]
        known.append(("en", area, [r.sample(some, len(some)), ["plain", r.choice(terms)]]))
    rules = mine(spark.createDataFrame(known, "lang string, area string, segments array<array<string>>").repartition(5))
    counts: dict = {}
    for _, area, parts in known:
        seen = set()
        for part in parts:
            fresh = sorted(set(part) - seen)
            seen |= set(part)
            for size in range(1, len(fresh) + 1):
                for t in combinations(fresh, size):
                    counts.setdefault(t, {}).setdefault(area, 0)
                    counts[t][area] += 1
    n_of = {a: 1 + sum(k[1] == a for k in known) for a in rules.areas}
    least, want, conf = max(3, int(len(known) / 2000)), {}, {}
    drawn = {t for t, c in counts.items() if len(t) == 1 for a, n in c.items() if _least_confidence(n, sum(c.values())) / (n_of[a] / sum(n_of.values())) >= LIFT}
    for t in sorted(counts, key=len):
        if not all((x,) in drawn for x in t):
            continue
        for a, n in counts[t].items():
            p, c = n_of[a] / sum(n_of.values()), _least_confidence(n, sum(counts[t].values()))
            parts = [conf.get((x, a), p if len(t) == 2 else np.inf) for x in combinations(t, len(t) - 1) if x]
            if n >= least and c / p >= LIFT and (len(t) == 1 or c > RAISE * max(p, *parts)):
                conf[t, a] = c
                if len(t) > 1:
                    want[t, a] = np.log(c / max(p, *parts))
    got = longer_rules(rules)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert {len(t) for t, _ in want} >= {2, 3, 4}
    segment = sorted(max(want, key=lambda k: len(k[0]))[0])
    e = rules.evidence(pa.array([[*segment, "plain"], ["plain"], segment[::-1]], type=pa.list_(pa.string())))
    single = dict(zip(rules.terms, rules.weights, strict=True))
    total = [sum(single[t][i] for t in segment) + sum(w for (t, x), w in want.items() if x == a and set(t) <= set(segment)) for i, a in enumerate(rules.areas)]
    assert np.allclose(e, [total, [0] * len(likely), total])


def test_phrases_in_many_variants_do_not_multiply(spark):
    """Forty terms that documents of two areas share, each document without some of them."""
    r = random.Random(5)
    phrase = [f"term{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(40)]
    known = [("en", a, [[t for t in phrase if r.random() < 0.9]] if a in ("sea", "hill") else [["other", "words"]]) for a in ["sea", "hill", "city", "moor", "lake", "farm", "mine", "wood"] * 250]
    begun = time.monotonic()
    rules = mine(spark.createDataFrame(known, "lang string, area string, segments array<array<string>>"))
    assert time.monotonic() - begun < 60 and {"termaa", "termbn"} <= set(rules.terms)


def test_segments(spark):
    text = "One two; three! Four\u3002Five six\nab cd. " + "word " * 150
    got = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(segments(F.col("t")).alias("s")).collect()
    assert [len(x) for x in got[0]["s"]] == [2, 1, 1, 2, 64, 64, 22] and got[1]["s"] == got[2]["s"] == []


def test_pooling():
    p = pooled(np.array([0, 3, 1, 0, 9.0]), np.array([10, 4, 4, 0, 10.0]))
    assert p.tolist() == [0.0, 0.5, 0.5, 0.5, 0.9]
