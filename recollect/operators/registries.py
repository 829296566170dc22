"""Registries, statistics and learners."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions import vector as V
from recollect.operators.ordering import HOT_ROWS, ordered
from recollect.operators.vectors import centroid


def select(rows: DataFrame, order: list[Column], limit: int | None = None, **fixed) -> DataFrame:
    """Rows with the given values, ordered, limited.

    A value of None leaves the column free; filters reach the scan.
    """
    out = reduce(lambda d, kv: d if kv[1] is None else d.where(F.col(kv[0]) == kv[1]), fixed.items(), rows).orderBy(*order)
    return out if limit is None else out.limit(limit)


def latest(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row per key, as one pre-aggregated maximum."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")
    return rows.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def geometry(vectors: DataFrame, *keys: str) -> DataFrame:
    """Per group the participation ratio of the per-dimension variances, isotropy, mean pair cosine, and what is odd.

    The mean cosine over all pairs follows from the norm of the sum of the unit
    vectors, so no pairs are formed.
    """
    unit = vectors.withColumn("_u", F.transform(V.as_double(F.col("embedding")), lambda x: x / V.norm(F.col("embedding"))))
    flat = unit.select(*keys, F.posexplode("_u").alias("pos", "x")).groupBy(*keys, "pos").agg(F.var_pop("x").alias("v"), F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"))
    g = flat.groupBy(*keys).agg(F.max("n").alias("n"), (F.pow(F.sum("v"), F.lit(2.0)) / F.sum(F.col("v") * F.col("v"))).alias("effective_dim"), F.count(F.lit(1)).alias("_dim"), F.sum(F.col("s") * F.col("s")).alias("_ss"))
    g = g.where("n >= 2").withColumns({"isotropy": F.col("effective_dim") / F.col("_dim"), "mean_cosine": (F.col("_ss") - F.col("n")) / (F.col("n") * (F.col("n") - 1.0))})
    issue = F.when((F.col("mean_cosine") > 0.95) & (F.col("n") >= 5), "high_similarity").when((F.col("isotropy") < 0.3) & (F.col("n") >= 5), "collapsed_embeddings")
    return g.withColumn("issue", issue).drop("_dim", "_ss")


def drift(now: DataFrame, before: DataFrame, key: str, value: str, least: float = 0.005) -> DataFrame:
    """Groups whose value moved by more than a bound since the last snapshot."""
    both = now.select(key, F.col(value).alias("now")).join(before.select(key, F.col(value).alias("before")), key)
    return both.withColumn("delta", F.col("now") - F.col("before")).where(F.abs("delta") > least)


def themes(vectors: DataFrame, theme: str = "realm") -> DataFrame:
    """Size and coherence (mean cosine to the centroid) of each theme; the centroids are the small side."""
    c = centroid(vectors, theme)
    joined = vectors.join(F.broadcast(c), theme)  # one row a theme
    return joined.groupBy(theme).agg(F.count(F.lit(1)).alias("members"), F.avg(V.cosine(F.col("embedding"), F.col("mean"))).alias("coherence"))


def theme_stats(members: DataFrame, memory: DataFrame) -> DataFrame:
    """Themes, memberships, memories without one, members a theme."""
    orphans = memory.join(members.select("memory_id").distinct(), "memory_id", "left_anti").count()
    t = members.agg(F.count_distinct("theme").alias("themes"), F.count(F.lit(1)).alias("memberships"))
    return t.select("themes", "memberships", F.lit(orphans).cast("long").alias("orphans"), (F.col("memberships") / F.col("themes")).alias("avg_members"))


def assign_orphans(orphans: DataFrame, centres: DataFrame, least: float, theme: str = "realm") -> DataFrame:
    """Best theme of each orphan at or above a cosine; null where a new theme would be founded. Themes are few and bound as constants."""
    known = centres.orderBy(theme).collect()
    scored = F.array(*[F.struct(V.cosine(F.col("embedding"), V.literal(c["mean"])).alias("s"), F.lit(c[theme]).alias("t")) for c in known])
    best = F.array_max(scored)
    return orphans.select("memory_id", F.when(best["s"] >= least, best["t"]).alias("theme"), best["s"].alias("similarity"))


def split_large(vectors: DataFrame, theme: str, most: int, rounds: int = 5, sample: int = 2000) -> DataFrame:
    """Two-means halves of themes above ``most`` members: centres from a bounded sample, every member assigned in the scan."""
    big = [r[0] for r in vectors.groupBy(theme).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).orderBy(theme).collect()]  # themes are few
    parts = []
    for name in big:
        rows = vectors.where(F.col(theme) == name)
        x = np.array([r["embedding"] for r in rows.orderBy(F.xxhash64("memory_id"), "memory_id").limit(sample).collect()], dtype=np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        c = x[[0, int((x @ x[0]).argmin())]].copy()
        for _ in range(rounds):
            near = (x @ c.T).argmax(axis=1)
            c = np.stack([x[near == j].mean(axis=0) if (near == j).any() else c[j] for j in (0, 1)])
        half = (V.dot(F.col("embedding"), V.literal(c[1])) > V.dot(F.col("embedding"), V.literal(c[0]))).cast("int")
        parts.append(rows.select("memory_id", F.lit(name).alias(theme), half.alias("half")))
    return reduce(DataFrame.unionByName, parts) if parts else vectors.select("memory_id", theme, F.lit(0).alias("half")).limit(0)


def mergeable(centres: DataFrame, least: float = 0.9, theme: str = "realm") -> DataFrame:
    """Pairs of themes with nearly equal centroids; the centroids are a bounded table."""
    rows = centres.collect()
    out = []
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            x, y = np.array(a["mean"]), np.array(b["mean"])
            cos = float(x @ y / (np.linalg.norm(x) * np.linalg.norm(y)))
            if cos >= least:
                out.append((*sorted((a[theme], b[theme])), cos))
    return centres.sparkSession.createDataFrame(out, "a string, b string, similarity double")


def surprise_query(surprise: DataFrame, limit: int, domain: str | None = None, realm: str | None = None, least: float | None = None, since: int | None = None) -> DataFrame:
    """Newest first."""
    out = surprise if least is None else surprise.where(F.col("magnitude") >= least)
    out = out if since is None else out.where(F.col("ts_ms") >= since)
    return select(out, [F.col("ts_ms").desc(), F.col("id").desc()], limit, domain=domain, realm=realm)


def blind_spots(surprise: DataFrame, limit: int) -> DataFrame:
    """(domain, action) by number times mean magnitude, with the first five ids."""
    rank = F.row_number().over(Window.partitionBy("domain", "action").orderBy("ts_ms", "id"))
    five = surprise.withColumn("_r", rank).where(F.col("_r") <= 5).groupBy("domain", "action").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "id"))), lambda x: x["id"].cast("string")), ",").alias("examples"))
    g = surprise.groupBy("domain", "action").agg(F.count(F.lit(1)).alias("n"), F.avg("magnitude").alias("avg_magnitude"))
    return g.join(five, ["domain", "action"]).withColumn("score", F.col("n") * F.col("avg_magnitude")).orderBy(F.col("score").desc(), "domain", "action").limit(limit)


def surprise_stats(surprise: DataFrame) -> DataFrame:
    """Number and mean magnitude by domain and in all (domain null)."""
    return surprise.rollup("domain").agg(F.count(F.lit(1)).alias("n"), F.avg("magnitude").alias("avg_magnitude"))


def fragile(debt: DataFrame, threshold: float, limit: int) -> DataFrame:
    """Open decisions at or above a fragility, most fragile first."""
    return debt.where((F.col("status") == "Open") & (F.col("fragility") >= threshold)).orderBy(F.col("fragility").desc(), "id").limit(limit)


def resolvable(debt: DataFrame, evidence: DataFrame, threshold: float) -> DataFrame:
    """Open debts whose summed evidence reaches a threshold; sums are taken before the join."""
    total = evidence.groupBy(F.col("debt_id").alias("id")).agg(F.sum("confidence").alias("total")).where(F.col("total") >= threshold)
    return debt.where(F.col("status") == "Open").join(total, "id").select("id", "total")


def debt_stats(debt: DataFrame) -> DataFrame:
    """Numbers by status and the mean fragility of the open ones."""
    c = lambda s: F.count_if(F.col("status") == s)
    return debt.agg(F.count(F.lit(1)).alias("n"), c("Open").alias("open"), c("Resolved").alias("resolved"), c("Abandoned").alias("abandoned"), F.avg(F.when(F.col("status") == "Open", F.col("fragility"))).alias("avg_open_fragility"))


def source_weights(feedback: DataFrame) -> DataFrame:
    """Per source and domain the success rate, and twice that as weight, within 0 and 2."""
    g = feedback.groupBy("source", "domain").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("useful").cast("double")).alias("rate"))
    return g.withColumn("weight", F.least(F.greatest(2.0 * F.col("rate"), F.lit(0.0)), F.lit(2.0)))


def wisdom(candidates: DataFrame, least: float) -> DataFrame:
    """Candidates with support of four, two sessions, no contradiction and a sufficient score are promotable."""
    ok = (F.col("support") >= 4) & (F.col("sessions") >= 2) & (F.col("contradictions") == 0) & (F.col("score") >= least)
    return candidates.withColumn("lifecycle", F.when(ok, "promotable").when(F.col("contradictions") > 0, "contested").otherwise("candidate"))


def lineage_state(state: Column, support: Column, contradiction: Column, staleness: Column) -> Column:
    """Trusted may become Watch or Inflamed, Watch may become Inflamed."""
    ratio = contradiction / (support + 0.01)
    hot, warm = (ratio > 0.60) | (staleness > 0.70), (ratio > 0.30) | (staleness > 0.40)
    return F.when(state.isin("Trusted", "Watch") & hot, "Inflamed").when((state == "Trusted") & warm, "Watch").otherwise(state)


def adjudicated(events: DataFrame) -> DataFrame:
    """Masses and state of each lineage after its ordered events (support, contradiction, staleness), each clamped as it comes."""
    ops = events.groupBy("lineage").agg(F.array_sort(F.collect_list(F.struct("at_ms", "id", "support", "contradiction", "staleness"))).alias("ops"))
    zero = F.struct(F.lit(1.0).alias("s"), F.lit(0.0).alias("c"), F.lit(0.0).alias("t"), F.lit("Trusted").alias("state"))

    def step(a, e):
        s = F.when(e["support"] > 0, F.least(a["s"] + e["support"], F.lit(10.0))).otherwise(a["s"])
        c = F.when(e["contradiction"] > 0, F.least(a["c"] + e["contradiction"], F.lit(10.0))).otherwise(a["c"])
        t = F.when(e["support"] > 0, F.greatest(a["t"] - 0.10, F.lit(0.0))).otherwise(a["t"])
        t = F.when(e["staleness"] > 0, F.least(t + e["staleness"], F.lit(1.0))).otherwise(t)
        return F.struct(s.alias("s"), c.alias("c"), t.alias("t"), lineage_state(a["state"], s, c, t).alias("state"))

    r = ops.select("lineage", F.aggregate("ops", zero, step).alias("r"))
    return r.select("lineage", F.col("r.s").alias("support"), F.col("r.c").alias("contradiction"), F.col("r.t").alias("staleness"), F.col("r.state").alias("state"))


def staleness_tick(lineages: DataFrame, now_ms: int) -> DataFrame:
    """Trusted or watched lineages without support for three days grow staler by 0.05; with the state that follows."""
    due = F.col("state").isin("Trusted", "Watch") & (F.lit(now_ms) - F.col("last_supported_ms") > 259_200_000)
    t = F.when(due, F.least(F.col("staleness") + 0.05, F.lit(1.0))).otherwise(F.col("staleness"))
    return lineages.withColumns({"new_staleness": t, "new_state": F.when(due, lineage_state(F.col("state"), F.col("support"), F.col("contradiction"), t)).otherwise(F.col("state"))})


def expired(rows: DataFrame, at: str, ttl_ms: int, now_ms: int, state: str | None = None) -> DataFrame:
    """Rows (in a state) that opened longer ago than a time to live."""
    out = rows.where(F.lit(now_ms) - F.col(at) > ttl_ms)
    return out if state is None else out.where(F.col("state") == state)


def envelope_matches(lineages: DataFrame, domain: str, action: str, least: float = 0.5) -> DataFrame:
    """Lineages not demoted whose envelope overlaps: half for the domain, half for the action."""
    overlap = 0.5 * (F.col("domain") == domain).cast("double") + F.when(F.array_contains("actions", action), 0.5).otherwise(0.0)
    return lineages.where((F.col("state") != "Demoted") & (overlap > least))


def lineage_stats(lineages: DataFrame) -> DataFrame:
    """Per state the number and the summed masses."""
    return lineages.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.sum("support").alias("support"), F.sum("contradiction").alias("contradiction"))


def tasks(task: DataFrame, limit: int, realm: str | None = None, status: str | None = None, priority: int | None = None) -> DataFrame:
    """Active first, then by priority and creation, newest first."""
    order = [F.when(F.col("status") == "Open", 0).otherwise(1), F.col("priority").desc(), F.col("created_ms").desc(), F.col("id")]
    return select(task, order, limit, realm=realm, status=status, priority=priority)


def task_view(task: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """Each task with the sorted list of each kind of its parts (task_id, no, ...), aggregated before the join."""
    for name, rows in parts.items():
        nested = rows.groupBy(F.col("task_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct(*[c for c in rows.columns if c != "task_id"]))).alias(name))
        task = task.join(nested, "id", "left")
    return task


def all_criteria_met(criteria: DataFrame) -> DataFrame:
    """Tasks with at least one criterion, all of them met."""
    return criteria.groupBy("task_id").agg(F.bool_and("is_met").alias("ok"), F.count(F.lit(1)).alias("n")).where("ok AND n > 0").select("task_id", "n")


def status_counts(rows: DataFrame, column: str, values: list[str]) -> DataFrame:
    """One row with a number per value of a column."""
    return rows.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(column) == v).alias(v.lower()) for v in values])


def unified(facts: DataFrame, subject: str | None = None, predicate: str | None = None, object: str | None = None, scope: str | None = None) -> DataFrame:
    """Active facts that match a pattern, None being a wildcard."""
    return select(facts.where("active"), [F.col("id")], None, subject=subject, predicate=predicate, object=object, scope=scope)


def fact_chain(facts: DataFrame, start: str, predicates: list[str]) -> DataFrame:
    """Ids along a path of predicates from a subject, one join a step, from the bound side."""
    t = facts.select("subject", "predicate", "object", "id")
    out = t.where((F.col("subject") == start) & (F.col("predicate") == predicates[0])).select(F.col("object").alias("at"), F.col("id").alias("id_0"))
    for i, p in enumerate(predicates[1:], 1):
        nxt = t.where(F.col("predicate") == p).select(F.col("subject").alias("at"), F.col("object").alias("next"), F.col("id").alias(f"id_{i}"))
        out = out.join(nxt, "at").drop("at").withColumnRenamed("next", "at")
    return out


def conflicts(facts: DataFrame) -> DataFrame:
    """Per (subject, predicate, scope) with several objects: the first fact of each object against the first of all.

    Linear in the group: rivals are linked with the earliest, not with each other.
    """
    firsts = facts.where("active").groupBy("subject", "predicate", "scope", "object").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("support"))
    w = Window.partitionBy("subject", "predicate", "scope")
    return firsts.withColumn("rival", F.min("id").over(w)).where("rival <> id").select("subject", "predicate", "scope", "object", "id", "rival", "support")


def resolve_branches(branches: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Winners are merged, losers abandoned, others stay."""
    v = verdicts.select(F.col("winner").alias("id"), F.lit("Merged").alias("new")).unionByName(verdicts.select(F.col("loser").alias("id"), F.lit("Abandoned").alias("new")))
    return branches.join(v.groupBy("id").agg(F.max("new").alias("new")), "id", "left").select("id", F.coalesce("new", "status").alias("status"))


def compiled(overrides: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Versions of each memory's text from override events: number, validity, what each supersedes."""
    rows = overrides.select("memory_id", "id", F.col("new_text").alias("object"), "at_ms")
    rows = ordered(rows, ["memory_id"], ["at_ms", "id"], lag={"supersedes": "id"}, lead={"valid_to_ms": "at_ms"}, number="version", hot_rows=hot_rows)
    return rows.withColumn("status", F.when(F.col("valid_to_ms").isNull(), "Active").otherwise("Superseded")).withColumnRenamed("at_ms", "valid_from_ms")


def contested(assertions: DataFrame) -> DataFrame:
    """(subject, predicate) with more than one active assertion."""
    return assertions.where(F.col("status") == "Active").groupBy("subject", "predicate").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def epistemic_status(probes: DataFrame) -> DataFrame:
    """Asserted without tests, else Tested, Failed or Mixed by what they gave."""
    g = probes.groupBy("memory_id").agg(F.max((F.col("passed")).cast("int")).alias("p"), F.max((~F.col("passed")).cast("int")).alias("f"))
    s = F.when((F.col("p") == 1) & (F.col("f") == 1), "Mixed").when(F.col("p") == 1, "Tested").when(F.col("f") == 1, "Failed").otherwise("Asserted")
    return g.select("memory_id", s.alias("status"))


def symbol_search(symbols: DataFrame, query: str, limit: int, path: str | None = None) -> DataFrame:
    """Exact names before prefixes, one row per (name, kind, file), the newest."""
    hit = symbols.where(F.startswith(F.lower("name"), F.lit(query.lower())))
    if path is not None:
        hit = hit.where(F.startswith("file_path", F.lit(path)))
    one = hit.groupBy("name", "kind", "file_path").agg(F.max("symbol_id").alias("symbol_id"))
    return one.withColumn("exact", F.lower("name") == query.lower()).orderBy(F.col("exact").desc(), "name", "file_path", "symbol_id").limit(limit)


def gc_candidates(symbols: DataFrame, excluded: list[str], alive: DataFrame) -> DataFrame:
    """Symbols to drop: below an excluded path, of a dead file, or repeats, in that order of reasons."""
    low = reduce(lambda c, p: c | F.startswith("file_path", F.lit(p)), excluded, F.lit(False))
    rank = F.row_number().over(Window.partitionBy("name", "kind", "file_path").orderBy(F.col("symbol_id").desc()))
    rows = symbols.withColumn("_r", rank).join(alive.select("file_path", F.lit(True).alias("_alive")).distinct(), "file_path", "left")
    reason = F.when(low, "excluded").when(F.col("_alive").isNull(), "dead").when(F.col("_r") > 1, "duplicate")
    return rows.withColumn("reason", reason).where(F.col("reason").isNotNull()).select("symbol_id", "reason", F.regexp_extract("file_path", "^(.*)/", 1).alias("dir"))


def calls_of(calls: DataFrame, symbol: int) -> DataFrame:
    """Callees and callers of a symbol."""
    out = calls.where(F.col("caller") == symbol).select(F.col("callee").alias("symbol_id"), F.lit("callee").alias("role"))
    return out.unionByName(calls.where(F.col("callee") == symbol).select(F.col("caller").alias("symbol_id"), F.lit("caller").alias("role"))).distinct()


def contains_search(rows: DataFrame, column: str, query: str, limit: int, *order: str) -> DataFrame:
    """Rows whose text contains a string, without regard to case."""
    return rows.where(F.contains(F.lower(column), F.lit(query.lower()))).orderBy(*order).limit(limit)


def beta_posterior(rows: DataFrame, *keys: str) -> DataFrame:
    """alpha = 1 + sum of rewards, beta = 1 + sum of their complements, per arm."""
    g = rows.groupBy(*keys).agg((1.0 + F.sum("reward")).alias("alpha"), (1.0 + F.sum(1.0 - F.col("reward"))).alias("beta"))
    return g.withColumn("mean", F.col("alpha") / (F.col("alpha") + F.col("beta")))


def thompson(alpha: float, beta: float, seed: int) -> float:
    """Normal approximation of a Beta draw, from a fixed seed, within [0, 1]."""
    mean = alpha / (alpha + beta)
    sd = (mean * (1 - mean) / (alpha + beta + 1)) ** 0.5
    return float(np.clip(mean + sd * np.random.default_rng(seed).standard_normal(), 0.0, 1.0))


def select_route(posterior: DataFrame, intent: str, seed: int) -> str:
    """The arm with the greatest draw; arms are a handful."""
    rows = posterior.where(F.col("intent") == intent).orderBy("route").collect()
    return max(rows, key=lambda r: thompson(r["alpha"], r["beta"], seed + rows.index(r)))["route"]


def best_route(posterior: DataFrame) -> DataFrame:
    """Per intent the arm with the greatest mean, ties by name."""
    return posterior.groupBy("intent").agg(F.min_by("route", F.struct((-F.col("mean")).alias("m"), "route")).alias("route"))


def recommended_window(outcomes: DataFrame, start: float = 10.0) -> DataFrame:
    """Window per session type after an ordered running mean of outcome-weighted sizes, rounded, within 3 and 50."""
    ops = outcomes.groupBy("session_type").agg(F.array_sort(F.collect_list(F.struct("at_ms", "size", "outcome"))).alias("ops"))
    zero = F.struct(F.lit(start).alias("m"), F.lit(1.0).alias("n"))

    def step(a, o):
        x = o["size"] * o["outcome"] + F.least(F.greatest(F.round(a["m"]), F.lit(3.0)), F.lit(50.0)) * (1.0 - o["outcome"])
        return F.struct((a["m"] + (x - a["m"]) / (a["n"] + 1.0)).alias("m"), (a["n"] + 1.0).alias("n"))

    m = F.aggregate("ops", zero, step)["m"]
    return ops.select("session_type", F.least(F.greatest(F.round(m), F.lit(3.0)), F.lit(50.0)).cast("long").alias("window"))


def archive(candidates: DataFrame) -> DataFrame:
    """The fittest of every descriptor cell, ties to the smaller id."""
    return candidates.groupBy("cell").agg(F.max_by("memory_id", F.struct("fitness", -F.col("memory_id"))).alias("memory_id"), F.max("fitness").alias("fitness"))


def decay_recommendation(accesses: DataFrame, surprise: float = 0.5, alpha: float = 0.3) -> DataFrame:
    """Decay rate from the moving average of access intervals, folded in order from one day."""
    ops = accesses.groupBy("memory_id").agg(F.array_sort(F.collect_list("at_ms")).alias("t"))
    gaps = F.zip_with(F.slice("t", F.lit(2), F.greatest(F.size("t") - 1, F.lit(0))), F.slice("t", F.lit(1), F.greatest(F.size("t") - 1, F.lit(0))), lambda b, a: F.greatest(b - a, F.lit(1)).cast("double"))
    ewma = F.aggregate(gaps, F.lit(86_400_000.0), lambda e, g: alpha * g + (1 - alpha) * e)
    rate = 0.0001 * F.sqrt(ewma / 86_400_000.0) * (1.0 - 0.5 * surprise)
    return ops.select("memory_id", (ewma / 86_400_000.0).alias("days"), F.least(F.greatest(rate, F.lit(0.0001)), F.lit(0.01)).alias("rate"))


def session_gaps(beats: DataFrame, ttl_ms: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """I4: sessions cut where a heartbeat is later than the time to live: (session_id, part, start, end, beats).

    Equal heartbeats of a session are counted first, so the order within it is strict.
    """
    once = beats.groupBy("session_id", "ts_ms").agg(F.count(F.lit(1)).alias("n"))
    rows = ordered(once, ["session_id"], ["ts_ms"], lag={"before": "ts_ms"}, hot_rows=hot_rows)
    fresh = F.when(F.col("before").isNull() | (F.col("ts_ms") - F.col("before") > ttl_ms), F.col("ts_ms"))
    rows = ordered(rows, ["session_id"], ["ts_ms"], running_max={"start_ms": fresh}, hot_rows=hot_rows)
    parts = rows.groupBy("session_id", "start_ms").agg(F.max("ts_ms").alias("end_ms"), F.sum("n").alias("beats"))
    return ordered(parts, ["session_id"], ["start_ms"], number="part", hot_rows=hot_rows)


def live_sessions(events: DataFrame) -> DataFrame:
    """Last register or heartbeat of sessions whose last event is not their deregistration."""
    last = latest(events, ["session_id"], "ts_ms", "kind")
    return last.where(F.col("kind") != "deregister")


def triggers(armed: DataFrame, now_ms: int) -> DataFrame:
    """What fires: a passed time or deadline, or tension at its threshold."""
    why = F.when(F.col("time_after_ms") <= now_ms, "time").when(F.col("deadline_ms") <= now_ms, "deadline").when(F.col("tension") >= F.col("threshold"), "tension")
    return armed.withColumn("fired", why).where(F.col("fired").isNotNull())


def tension(amounts: DataFrame, threshold: float) -> DataFrame:
    """Capped running sum per trigger and whether it reached the threshold. Amounts are not negative, so the cap commutes with the sum."""
    return amounts.groupBy("trigger").agg(F.least(F.sum("amount"), F.lit(1.0)).alias("tension")).withColumn("fired", F.col("tension") >= threshold)


#: Fixed values of surprise learning: ignore, gate, streak, decay, bleed, most.
IGNORE, GATE, STREAK, CREDIT_DECAY, BLEED, MOST = 0.20, 0.75, 2, 0.85, 0.35, 0.08


def surprise_credit(surprise: DataFrame) -> DataFrame:
    """Strength changes that pass the gate, by an ordered fold per memory: (memory_id, id, delta, credit)."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        credit, last, streak, out = 0.0, 0, 0, []
        for i, m, d in pdf.sort_values(["ts_ms", "id"])[["id", "magnitude", "dir"]].itertuples(index=False):
            if m <= IGNORE:
                continue
            credit = CREDIT_DECAY * credit + d * ((m - IGNORE) / (1 - IGNORE)) ** 2
            streak = min(streak + 1, 8) if d == last else 1
            last = d
            if abs(credit) >= GATE and streak >= STREAK:
                delta = min(MOST, 0.02 + 0.06 * min(abs(credit) - GATE, 1.0))
                delta = delta if credit > 0 else -delta
                credit *= BLEED
                out.append((i, delta, credit))
        return pd.DataFrame([(pdf["memory_id"].iloc[0], *o) for o in out], columns=["memory_id", "id", "delta", "credit"])

    return surprise.groupBy("memory_id").applyInPandas(fold, "memory_id long, id long, delta double, credit double")


def failure_window(failures: DataFrame, last: int = 8) -> DataFrame:
    """At each failure of a (domain, source), how many of its last eight lie within."""
    w = Window.partitionBy("domain", "source").orderBy("ts_ms", "id")
    return failures.withColumn("recent", F.count(F.lit(1)).over(w.rowsBetween(-(last - 1), 0))).withColumn("oldest_id", F.first("id").over(w.rowsBetween(-(last - 1), 0)))


def recall_effects(hits: DataFrame, floor: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """Touches of the first 16 hits of each recall; pairs of the first five strengthened by 0.05, kept from a floor.

    Sets are cut to their first hits before pairs are formed, so pairs stay bounded.
    """
    touches = hits.where(F.col("pos") <= 16).groupBy("memory_id").agg(F.count(F.lit(1)).alias("touches"))
    five = hits.where(F.col("pos") <= 5).select("set_id", "memory_id").distinct()
    pairs = five.join(five.select("set_id", F.col("memory_id").alias("other")), "set_id").where("memory_id < other")
    strong = pairs.groupBy(F.col("memory_id").alias("a"), F.col("other").alias("b")).agg((0.05 * F.count(F.lit(1))).alias("weight")).where(F.col("weight") >= floor)
    return touches, strong


def retrieval_signature(contexts: DataFrame, last: int = 8) -> DataFrame:
    """I16: positional mean of the last eight context vectors of each memory."""
    w = Window.partitionBy("memory_id").orderBy(F.col("ts_ms").desc(), F.col("id").desc())
    return V.mean_vector(contexts.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= last), "context", "memory_id")
