import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest

from recollect import storage
from recollect.operators.history import FACT, HistoryTable, build_chains

COLUMNS = "id bigint, subject string, predicate string, object string, valid_from_ms bigint, valid_to_ms bigint, recorded_at timestamp_ntz, extra string"
T = datetime(2025, 1, 1)


def brute(rows):
    """Moment by moment: at every boundary look up the deciding fact."""
    last = {}
    for i, s, p, o, a, b, t, _ in rows:
        if i is None:
            continue
        key = (t, a is not None, a or 0, (b or 0) != 0, b or 0, s is not None, (s or "").strip().lower(), (p or "").strip().lower(), o is not None, o or "")
        if i not in last or key > last[i][0]:
            last[i] = (key, (s, p, o, a, b))
    groups = defaultdict(list)
    for i, (_, (s, p, o, a, b)) in last.items():
        if s is None or p is None or o is None or not s.strip() or not p.strip() or not o.strip() or a is None:
            continue
        if b and b <= a:
            continue
        groups[s.strip().lower(), p.strip().lower()].append((a, i, o, b or None))
    out = set()
    for (s, p), facts in groups.items():
        points = sorted({f[0] for f in facts} | {f[3] for f in facts if f[3]})
        runs = []
        for n, t in enumerate(points):
            stop = points[n + 1] if n + 1 < len(points) else None
            a, _, o, b = max((f for f in facts if f[0] <= t), key=lambda f: (f[0], f[1]), default=(None, None, None, None))
            held = o if o is not None and (b is None or b > t) else None
            if held is None:
                continue
            if runs and runs[-1][0] == held and runs[-1][2] == t:
                runs[-1][2] = stop
            else:
                runs.append([held, t, stop])
        out |= {(s, p, o, a, b or 0) for o, a, b in runs}
    return out


def facts(seed, n=300):
    r = random.Random(seed)
    rows = []
    for _ in range(n):
        a = r.randint(1, 60)
        subject = r.choice(["a", " A", "b", "hot", "hot", "hot", "", None])
        rows.append((r.choice([None, *range(1, n // 2)]), subject, r.choice(["p", "P ", None]), r.choice(["x", "y", "z", "", None]), r.choice([a, a, a, None]), r.choice([0, None, a, a + r.randint(-3, 20)]), T + timedelta(days=r.randint(0, 90)), "e"))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_in_any_order_give_the_same_history(spark, seed):
    rows = facts(seed)
    table = HistoryTable(spark, storage.new_path(spark, "t"), buckets=3)
    random.Random(seed).shuffle(rows)
    for part in (rows[:120], rows[120:125], rows[125:], rows[:50]):
        table.apply(spark.createDataFrame(part, COLUMNS))
    assert {tuple(r) for r in table.versions().select("subject", "predicate", "object", "valid_from_ms", "valid_to_ms").collect()} == brute(rows)
    assert table.store.version == 4


@pytest.mark.parametrize("hot_rows", [5, 10**6])
def test_hot_entities_are_cut_without_changing_the_result(spark, hot_rows):
    rows = [(i, "hot", "p", f"o{i % 3}", i // 2 + 1, (i // 2 + 1) + i % 7 if i % 7 else 0, T, None) for i in range(400)] + [(1000 + i, f"s{i}", "p", "x", 5, 0, T, None) for i in range(5)]
    df = spark.createDataFrame(rows, COLUMNS).select(*[c.split()[0] for c in FACT.split(", ")])
    assert {tuple(r) for r in build_chains(df, hot_rows).collect()} == brute(rows)


def test_empty(spark):
    table = HistoryTable(spark, storage.new_path(spark, "t"), buckets=3)
    table.apply(spark.createDataFrame([], COLUMNS))
    assert table.versions().count() == 0


def test_a_correction_moves_a_fact_between_entities(spark):
    table = HistoryTable(spark, storage.new_path(spark, "t"), buckets=4)
    table.apply(spark.createDataFrame([(1, "a", "p", "x", 5, 0, T, None), (2, "b", "p", "y", 5, 0, T, None)], COLUMNS))
    table.apply(spark.createDataFrame([(1, "c", "p", "x", 5, 0, T + timedelta(days=1), None)], COLUMNS))
    assert {r["subject"] for r in table.versions().collect()} == {"b", "c"}
