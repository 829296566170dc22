import random

import pytest

from recollect import storage
from recollect.operators import bucket_store, changefeed
from recollect.operators.changefeed import CLOCK_BLOCK, ChangedTable

COLUMNS = "instance_id bigint, seqno bigint, op_type string, memory_id bigint, content string, op_ts_ms bigint, other string"


def brute(rows):
    ops = {}
    for w, n, kind, m, content, clock, _ in rows:
        if w is None or n is None or m is None:
            continue
        o = ops.setdefault((w, n), {"kind": kind, "m": m, "content": None, "clock": None})
        if content is not None:
            o["content"] = max(content, o["content"]) if o["content"] is not None else content
        if clock and clock > 0:
            o["clock"] = max(clock, o["clock"] or 0)
    last, order = {}, []
    for (w, n), o in sorted(ops.items()):
        if o["clock"]:
            last[w] = o["clock"]
        order.append((last.get(w, 0), w, n, o))
    state = {}
    for _, w, n, o in sorted(order, key=lambda x: x[:3]):
        if o["kind"] == "PutPayload":
            state[o["m"]] = (w, n, o["content"])
        elif o["kind"] == "DeleteMemory":
            state.pop(o["m"], None)
        elif o["m"] in state and o["content"] is not None:
            state[o["m"]] = (w, n, o["content"])
    return {(m, *v) for m, v in state.items()}


def feed(seed, n=400, step=1):
    r = random.Random(seed)
    out = []
    for w in range(3):
        for i in range(1, n // 3):
            m = r.choice([7, 7, 7, *range(20)])
            kind = r.choice(["PutPayload", "UpdateMemoryContent", "UpdateMemoryContent", "DeleteMemory"])
            content = None if kind == "DeleteMemory" else r.choice(["", None, f"c{w}.{i}"])
            clock = r.choice([0, None, r.randint(1, 50), r.randint(1, 50)])
            out += [(w, i * step, kind, m, content, r.choice([clock, clock, None]) if c else clock, "x") for c in range(r.choice([1, 1, 2]))]
    return out + [(None, 1, "PutPayload", 1, "a", 1, "x"), (1, None, "PutPayload", 1, "a", 1, "x"), (5, 1, "PutPayload", None, "a", 1, "x")]


@pytest.mark.parametrize("seed,step", [(1, 1), (2, 1), (3, CLOCK_BLOCK // 3)])
def test_any_delivery_gives_the_same_state(spark, seed, step):
    rows = feed(seed, step=step)
    random.Random(seed).shuffle(rows)
    table = ChangedTable(spark, storage.new_path(spark, "t"), buckets=3)
    for part in (rows[:200], rows[200:230], rows[230:], rows[:40]):
        table.apply(spark.createDataFrame(part, COLUMNS))
    assert {tuple(r) for r in table.state().select("memory_id", "instance_id", "seqno", "content").collect()} == brute(rows)


def test_only_touched_buckets_are_rewritten(spark):
    table = ChangedTable(spark, storage.new_path(spark, "t"), buckets=8)
    table.apply(spark.createDataFrame([(1, i, "PutPayload", i, "a", i, "") for i in range(1, 60)], COLUMNS))
    before = table.store.files("state")
    table.apply(spark.createDataFrame([(2, 1, "UpdateMemoryContent", 5, "b", 99, "")], COLUMNS))
    after = table.store.files("state")
    assert sum(before[b] != after[b] for b in before) == 1


def test_empty(spark):
    table = ChangedTable(spark, storage.new_path(spark, "t"), buckets=3)
    table.apply(spark.createDataFrame([], COLUMNS))
    assert table.state().count() == 0


def test_small_batches_touch_little(spark, monkeypatch):
    """Thirty blocks of clocks, many buckets: a batch of few rows reads and replaces few files; late clocks reach the blocks that wait for them."""
    CLOCK_BLOCK = 64
    monkeypatch.setattr(changefeed, "CLOCK_BLOCK", CLOCK_BLOCK)
    n = 30 * CLOCK_BLOCK
    rows = spark.range(n).selectExpr("1L AS instance_id", "id AS seqno", "'PutPayload' AS op_type", "id % 500 AS memory_id", "CAST(id AS STRING) AS content", f"CASE WHEN id % {CLOCK_BLOCK} < {CLOCK_BLOCK - 1} OR id < {CLOCK_BLOCK} THEN 0L ELSE id END AS op_ts_ms")
    table = ChangedTable(spark, storage.new_path(spark, "t"), buckets=32)
    table.apply(rows)
    before = {t: table.store.files(t) for t in table.store.schemas}
    late = spark.createDataFrame([(1, 5 * CLOCK_BLOCK - 1, "PutPayload", 7, "late", 10**9)], "instance_id bigint, seqno bigint, op_type string, memory_id bigint, content string, op_ts_ms bigint")
    table.apply(late)
    changed = {t: sum(before[t].get(b) != p for b, p in table.store.files(t).items()) for t in before}
    assert changed["clocks"] <= 2 and changed["ends"] == 1  # its own block, and the next, which begins without a clock
    moved = {r["memory_id"] for r in table.store.read("ops").where("eff = 1000000000").collect()}
    assert 319 in moved and table.store.read("ops").where("eff = 1000000000").count() == CLOCK_BLOCK
    assert table.store.vacuum(1) > 0 and table.state().count() == 500


def test_bucketed_anew(spark, monkeypatch):
    monkeypatch.setattr(bucket_store, "BUCKET_ROWS", 20)
    table = ChangedTable(spark, storage.new_path(spark, "t"), buckets=1)
    rows = feed(3)
    df = lambda part: spark.createDataFrame(part, COLUMNS)
    for part in (rows[:30], rows[30:60], rows[60:]):
        table.apply(df(part))
    assert table.store.buckets >= 8
    assert {tuple(r) for r in table.state().collect()} == brute(rows)
