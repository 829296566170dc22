from datetime import datetime, timezone

"""Literal cases: scoring, folds, routing, time windows, storage, streams."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect import storage
from recollect.functions import scoring as S
from recollect.functions.stats import wilson
from recollect.operators import hypervectors as H
from recollect.operators import registries as J
from recollect.operators import tape as T
from recollect.operators.bucket_store import BucketStore, ConcurrentCommit
from recollect.operators.fold import fold_deltas
from recollect.operators.ordering import ordered, with_block
from recollect.plans.router import Request, route, time_window
from recollect.sources.logical import NOW, view
from conftest import SF


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("count,want", [(0, 1.0), (1, 1.0), (2, 1.10), (3, 1.15), (100, 1.15)])
def test_replication(spark, count, want):
    assert value(spark, S.replication(F.lit(count), 1.15)) == pytest.approx(want)
    assert value(spark, S.replication(F.lit(count), 0.0)) == 1.0


def test_kinds_are_ordered():
    assert S.KIND["correction"] > S.KIND["wisdom"] > S.KIND["insight"] > 1 > S.KIND["operational"] > S.KIND["episode"]


def test_status_vetoes(spark):
    m = view(spark, SF, "memory").withColumn("relevance_score", F.lit(0.5))
    kept = {r["status"] for r in S.decompose(m, S.Context(NOW)).select("status").distinct().collect()}
    assert kept <= set(S.STATUS) and "Archived" not in kept


def test_factor_registry_is_open(spark):
    m = view(spark, SF, "memory").withColumn("relevance_score", F.lit(0.5))
    out = S.decompose(m, S.Context(NOW), {"mine": lambda c: F.lit(0.5)}).first()
    assert out["score"] == pytest.approx(out["relevance"] * 0.85)


@pytest.mark.parametrize("w,want", [(0.0, 0.0), (-1.0, 0.0), (7.0, 5.0), (2.0, 2.0), (float("nan"), 0.0)])
def test_outcome_weights(spark, w, want):
    assert value(spark, S.capped_weight(F.lit(w))) == want


def test_wilson(spark):
    low, high = wilson(F.lit(8), F.lit(10), 1.96)
    assert (value(spark, low), value(spark, high)) == (pytest.approx(0.4902, abs=1e-4), pytest.approx(0.9433, abs=1e-4))


@pytest.mark.parametrize("hot_rows", [10, 10**6])
def test_fold_against_a_loop(spark, hot_rows):
    r = random.Random(3)
    rows = [(r.randint(0, 9), r.randint(0, 3), n, r.choice([None, 0, r.randint(1, 60)]), r.uniform(-0.4, 0.4)) for n in range(400)]
    once, last, eff = {}, {}, []
    for m, w, n, t, d in rows:
        once[w, n] = (m, t, d)
    for (w, n), (m, t, d) in sorted(once.items()):
        if t:
            last[w] = t
        eff.append((last.get(w, 0), w, n, m, d))
    state = {}
    for t, _, _, m, d in sorted(eff):
        s, seen, k = state.get(m, (0.5, -1, 0))
        if not (t > 0 and t <= seen):
            state[m] = (min(max(s + d, 0.0), 1.0), max(seen, t), k + 1)
    df = spark.createDataFrame([(m, w, n, t, d) for m, w, n, t, d in rows], "memory_id long, instance_id long, seqno long, op_ts_ms long, strength_delta double")
    got = {x["memory_id"]: (x["strength"], x["applied"]) for x in fold_deltas(df.withColumn("op_ts_ms", F.nullif("op_ts_ms", F.lit(0))), hot_rows=hot_rows).collect()}
    assert got == {m: (pytest.approx(s), k) for m, (s, _, k) in state.items()}


def test_blocks_are_monotone_and_cut_only_hot_keys(spark):
    df = spark.createDataFrame([("hot", float(i % 97)) for i in range(2000)] + [("cold", 1.0)], "k string, v double")
    rows = with_block(df, ["k"], "v", hot_rows=100, splits=8).collect()
    assert {r["_blk"] for r in rows if r["k"] == "cold"} == {0}
    hot = sorted((r["v"], r["_blk"]) for r in rows if r["k"] == "hot")
    assert len({b for _, b in hot}) > 4 and [b for _, b in hot] == sorted(b for _, b in hot)


@pytest.mark.parametrize("hot_rows", [20, 10**6])
def test_order_within_hot_keys(spark, hot_rows):
    r = random.Random(6)
    rows = [("hot", r.randint(0, 40), i) for i in range(300)] + [("cold", 5 - i, i) for i in range(5)]
    df = spark.createDataFrame(rows, "k string, t long, id long")
    out = ordered(df, ["k"], ["t", "id"], lag={"p": "id"}, lead={"n": "id"}, running_max={"m": F.when(F.col("id") % 7 == 0, F.col("t"))}, number="no", hot_rows=hot_rows, splits=8)
    got = {(x["k"], x["id"]): (x["p"], x["n"], x["m"], x["no"]) for x in out.collect()}
    for k in ("hot", "cold"):
        own, m = sorted((t, i) for q, t, i in rows if q == k), None
        for no, (t, i) in enumerate(own):
            m = t if i % 7 == 0 and (m is None or t > m) else m
            assert got[k, i] == (own[no - 1][1] if no else None, own[no + 1][1] if no + 1 < len(own) else None, m, no + 1)


def test_session_gaps_with_a_hot_session(spark):
    r = random.Random(7)
    rows = [(1, r.randint(0, 3000)) for _ in range(200)] + [(2, 5), (2, 5), (2, 100)]
    df = spark.createDataFrame(rows, "session_id long, ts_ms long")
    plain, cut = ({tuple(x) for x in J.session_gaps(df, 20, h).select("session_id", "part", "start_ms", "end_ms", "beats").collect()} for h in (10**6, 30))
    assert plain == cut and {x for x in plain if x[0] == 2} == {(2, 1, 5, 5, 2), (2, 2, 100, 100, 1)}


def test_previous_values_across_blocks(spark):
    df = spark.range(300).select(F.col("id").alias("turn"))
    rows = T.with_previous(df, {"t": "turn"}, 3, block=16).collect()
    assert len(rows) == 300
    assert all(r[f"t_{i}"] == (r["turn"] - i if r["turn"] >= i else None) for r in rows for i in (1, 2, 3))


def test_hypervectors():
    a, b = H.word("alpha"), H.word("beta")
    assert H.word("alpha") == a != b
    assert H.bind(H.bind(a, b), b) == a
    assert H.bundle([]) == bytes(1024) and H.bundle([a]) == a and H.bundle([a, b]) == (np.frombuffer(a, np.uint64) & np.frombuffer(b, np.uint64)).tobytes()
    near = int(H.bits(H.bind(H.bundle([a, b, H.word("c")]), a)).sum())
    assert near < 3000 < int(H.bits(H.bind(a, b)).sum())


def test_episode_algebra(spark):
    e = H.episode("edit", "parser", 0)
    left = H.bind(H.bind(e, H.bind(H.word("ROLE:TOOL"), H.word("edit"))), H.bind(H.word("ROLE:OUTCOME"), H.word("success")))
    assert left == H.bind(H.word("ROLE:ENTITY"), H.encode("parser"))
    tape = spark.createDataFrame([(i, "edit", "parser", 0) for i in range(9)] + [(9, "read", "lexer", 0)], "turn long, tool string, entity string, outcome int")
    assert {v for v, _ in H.unbind(tape, "edit", "entity", 5).collect()} == {"parser", "lexer"}


def test_unbind_of_episodes_seen_more_than_255_times(spark):
    """Beside the bundle of all episodes, taken one by one."""
    seen = [("edit", "parser", 0)] * 601 + [("edit", "lexer", 1)] * 256 + [("edit", "reader", 0)] * 255 + [("edit", "writer", 2)] + [("read", "lexer", 0)] * 300
    tape = spark.createDataFrame([(i, *e) for i, e in enumerate(seen)], "turn long, tool string, entity string, outcome int")
    probe = H.bind(H.bundle([H.episode(*e) for e in seen if e[0] == "edit"]), H.bind(H.bind(H.word("ROLE:TOOL"), H.word("edit")), H.word("ROLE:ENTITY")))
    want = {v: 1.0 - int(H.bits(H.bind(probe, H.encode(v))).sum()) / H.BITS for v in ("parser", "lexer", "reader", "writer")}
    got = H.unbind(tape, "edit", "entity", 5).collect()
    assert [tuple(r) for r in got] == sorted(want.items(), key=lambda r: (-r[1], r[0]))


@pytest.mark.parametrize(
    "request_,want",
    [
        (Request(), "unbound:query_target"),
        (Request(causal_tool="t"), "unbound:causal_entity"),
        (Request(causal_tool="t", causal_entity="e"), "causal"),
        (Request(subject="s"), "exact"),
        (Request(freetext="f"), "fuzzy"),
        (Request(subject="s", freetext="f"), "hybrid"),
        (Request(time_from_ms=1), "temporal"),
        (Request(time_from_ms=1, freetext="f"), "hybrid"),
    ],
)
def test_routes(request_, want):
    assert route(request_) == want


N = 1_783_346_400_000  # 2026-07-06 14:00 UTC, a Monday
DAY = 86_400_000


@pytest.mark.parametrize(
    "text,want",
    [
        ("notes from yesterday", (1_783_209_600_000, 1_783_296_000_000, "notes from")),
        ("last 3 days of work", (N - 3 * DAY, N, "of work")),
        ("this week", (1_783_296_000_000, N, "")),
        ("last week", (1_783_296_000_000 - 7 * DAY, 1_783_296_000_000, "")),
        ("since 2026-07-01 all", (1_782_864_000_000, N, "all")),
        ("before 2026-07-01", (0, 1_782_864_000_000, "")),
        ("in may", (1_777_593_600_000, 1_780_272_000_000, "")),
        ("in december", (1_764_547_200_000, 1_767_225_600_000, "")),
        ("nothing timely", None),
    ],
)
def test_time_windows(text, want):
    assert time_window(text, N) == want


def test_window_offset():
    a, b = time_window("yesterday", N), time_window("yesterday", N, 120)
    assert b[0] == a[0] - 2 * 3_600_000


def test_time_grammar():
    now, tz = 1783353600000, 120  # 2026-07-06 16:00 UTC, a Monday
    day = lambda y, m, d: int(datetime(y, m, d, tzinfo=timezone.utc).timestamp() * 1000) - tz * 60_000
    win = lambda q: time_window(q, now, tz)
    assert [win(q) for q in ("how does the span lane dedup work", "the last word on this", "in 45 minutes", "in 0045")] == [None] * 4
    assert win("what did we do last week on the span lane") == (day(2026, 6, 29), day(2026, 7, 6), "what did we do on the span lane")
    assert win("failures in the last 3 days") == (now - 3 * 86_400_000, now, "failures in the")
    assert win("past week")[:2] == (now - 7 * 86_400_000, now)
    assert win("yesterday")[:2] == (day(2026, 7, 5), day(2026, 7, 6)) and win("today?")[:2] == (day(2026, 7, 6), now)
    assert win("what changed with the reranker in June") == (day(2026, 6, 1), day(2026, 7, 1), "what changed with the reranker")
    assert win("in december")[0] == day(2025, 12, 1) and win("in December 2024")[1] == day(2025, 1, 1)
    assert win("since 2026-05-15")[:2] == win("after 2026-05-15")[:2] == (day(2026, 5, 15), now)
    assert win("before 2026-03")[:2] == (-tz * 60_000, day(2026, 3, 1))
    assert win("between 2026-04 and 2026-06")[:2] == (day(2026, 4, 1), day(2026, 7, 1))
    assert win("on 2026-06-15")[:2] == (day(2026, 6, 15), day(2026, 6, 16)) and win("on 2026-06-31") is None
    assert win("in 2026")[:2] == (day(2026, 1, 1), day(2027, 1, 1)) and win("in 2026-06")[:2] == (day(2026, 6, 1), day(2026, 7, 1))
    assert win("since yesterday")[0] == day(2026, 7, 5) and win("last 400 years") is None and win("") is None


def test_manifest_conflict(spark):
    schema = spark.createDataFrame([], "k long").schema
    root = storage.new_path(spark, "store")
    a, b = (BucketStore(spark, root, 2, {"t": schema}) for _ in range(2))
    a.commit({})
    real = b._versions
    b._versions = lambda: []
    with pytest.raises(ConcurrentCommit):
        b.commit({})
    b._versions = real
    assert b.version == 1


def test_rings_and_caps(spark):
    up = J.tension(spark.createDataFrame([("a", 0.7), ("a", 0.7), ("b", 0.1)], "trigger string, amount double"), 0.8)
    assert {r["trigger"]: (r["tension"], r["fired"]) for r in up.collect()} == {"a": (1.0, True), "b": (pytest.approx(0.1), False)}


def test_stream_equals_batch(spark):
    from recollect.plans.registry_queries import i_surprise_credit
    from recollect.plans.source_queries import i_stream_credit

    assert {tuple(r) for r in i_stream_credit(spark, SF).collect()} == {tuple(r) for r in i_surprise_credit(spark, SF).collect()}


def test_foreach_batch_applies_once(spark):
    from recollect.operators.changefeed import ChangedTable
    from recollect.sources.tables import table
    from recollect.streaming import logs

    cols = ["instance_id", "seqno", "op_type", "memory_id", "content", "op_ts_ms"]
    folder = storage.new_path(spark, "feed-files")
    feed = table(spark, SF, "content_op", *cols)
    feed.repartition(3).write.parquet(folder)
    streamed = ChangedTable(spark, storage.new_path(spark, "t"), 4)
    schema = "instance_id bigint, seqno bigint, op_type string, memory_id bigint, content string, op_ts_ms bigint"
    logs.apply_batches(logs.tail(spark, folder, schema, 1), streamed.apply, storage.new_path(spark, "cp")).awaitTermination()
    once = ChangedTable(spark, storage.new_path(spark, "t"), 4)
    once.apply(feed)
    assert {tuple(r) for r in streamed.state().collect()} == {tuple(r) for r in once.state().collect()}
    assert streamed.store.version == 3
