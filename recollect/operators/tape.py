"""Sequence mining over the event tape.

The tape is one long ordered sequence. A window over all of it would be one task,
so turns are cut into blocks of ``BLOCK`` and the last turns of each block are
copied to the next as a halo: looking back up to ``HALO`` turns stays exact, in
one shuffle, whatever the length of the tape.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions.stats import wilson
from recollect.storage import materialize

BLOCK, HALO = 65_536, 16
Z90, Z95 = 1.645, 1.96


def symbol(tool: str = "tool", outcome: str = "outcome", entity: str = "entity") -> Column:
    """What happened, as one comparable value."""
    return F.concat_ws("|", F.col(tool), F.col(outcome).cast("string"), F.col(entity))


def vocabulary(tape: DataFrame, column: str) -> DataFrame:
    """H2: (name, id) in order of first occurrence.

    First turns are cut into ranges of ``BLOCK`` turns; names are numbered within a
    range and ranges by the names before them, so no task sorts all names.
    """
    first = materialize(tape.groupBy(column).agg(F.min("turn").alias("first")).withColumn("_r", F.floor(F.col("first") / BLOCK)), "vocabulary")
    counts = first.groupBy("_r").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a range
    inside = F.row_number().over(Window.partitionBy("_r").orderBy("first", column)) - 1
    return first.withColumn("_i", inside).join(counts.select("_r", before.alias("_b")), "_r").select(column, (F.col("_b") + F.col("_i")).alias("id"))


def packed(tape: DataFrame) -> DataFrame:
    """H1: (turn, packed) with the tool in bits 40 up, the outcome in 32-39 and the entity below.

    Names are joined, small vocabularies by broadcast as adaptive execution sees their size.
    """
    t = vocabulary(tape, "tool").withColumnRenamed("id", "tid")
    e = vocabulary(tape, "entity").withColumnRenamed("id", "eid")
    rows = tape.join(t, "tool").join(e, "entity")
    long = lambda c: F.col(c).cast("long")
    return rows.select("turn", F.shiftleft(long("tid"), 40).bitwiseOR(F.shiftleft(long("outcome"), 32)).bitwiseOR(long("eid")).alias("packed"))


def with_previous(tape: DataFrame, columns: dict[str, Column | str], back: int, block: int = BLOCK) -> DataFrame:
    """Add ``<name>_<i>`` = value i turns back, for i = 1..back; null before the beginning.

    ``turn`` must be dense for blocks of equal size; gaps only make them uneven.
    """
    rows = tape.withColumns({f"_v_{n}": F.col(c) if isinstance(c, str) else c for n, c in columns.items()})
    home = F.floor(F.col("turn") / block)
    again = (F.col("turn") % block) >= block - back
    both = rows.withColumn("_blk", F.explode(F.when(again, F.array(home, home + 1)).otherwise(F.array(home)))).withColumn("_halo", F.col("_blk") != home)
    w = Window.partitionBy("_blk").orderBy("turn")
    out = both.withColumns({f"{n}_{i}": F.lag(f"_v_{n}", i).over(w) for n in columns for i in range(1, back + 1)})
    return out.where(~F.col("_halo")).drop("_blk", "_halo", *[f"_v_{n}" for n in columns])


def bigrams(tape: DataFrame) -> DataFrame:
    """(turn, a, b): each symbol with the one before it."""
    return with_previous(tape.select("turn", "ts_ms", "session_id", "tool", "outcome", "entity"), {"sym": symbol()}, 1).select("turn", "ts_ms", F.col("sym_1").alias("a"), symbol().alias("b"), "outcome").where(F.col("a").isNotNull())


def occurrences(tape: DataFrame, pattern: list[str], back: int | None = None) -> DataFrame:
    """H3, H4: turns at which a sequence of symbols ends."""
    n = len(pattern)
    rows = with_previous(tape, {"sym": symbol()}, max(n - 1, 1))
    hit = symbol() == pattern[-1]
    for i in range(1, n):
        hit = hit & (F.col(f"sym_{i}") == pattern[-1 - i])
    return rows.where(hit).select("turn")


def last_occurrence(tape: DataFrame, pattern: list[str]) -> DataFrame:
    """H5: the latest of them."""
    return occurrences(tape, pattern).agg(F.max("turn").alias("turn"))


def antecedents(tape: DataFrame, sym: str, k: int) -> DataFrame:
    """Symbols before ``sym`` by pointwise mutual information, ties by symbol."""
    pairs = bigrams(tape).where(F.col("b") == sym).groupBy(F.col("a").alias("sym")).agg(F.count(F.lit(1)).alias("n"))
    single = tape.groupBy(symbol().alias("sym")).agg(F.count(F.lit(1)).alias("nx"))
    total = tape.agg(F.count(F.lit(1)).alias("total"), F.count_if(symbol() == sym).alias("ny"))
    total = total.first()  # two numbers
    pmi = F.log(F.col("n") * float(total["total"]) / (F.col("nx") * float(max(total["ny"], 1))))
    return pairs.join(single, "sym").select("sym", "n", pmi.alias("pmi")).orderBy(F.col("pmi").desc(), "sym").limit(k)


def failure_patterns(tape: DataFrame, least: int, k: int) -> DataFrame:
    """Symbols followed by at least ``least`` failures, by share times number."""
    g = bigrams(tape).groupBy(F.col("a").alias("sym")).agg(F.count_if(F.col("outcome") > 0).alias("fails"), F.count(F.lit(1)).alias("n"))
    g = g.where(F.col("fails") >= least).withColumn("ratio", F.col("fails") / F.col("n"))
    return g.orderBy((F.col("ratio") * F.col("fails")).desc(), "sym").limit(k)


def continuations(tape: DataFrame) -> DataFrame:
    """H8: (a, b, p): symbols seen after each symbol, uniform, and weighted by frequency."""
    c = bigrams(tape).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    t = c.groupBy("a").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("total"))
    return c.join(t, "a").select("a", "b", (1.0 / F.col("kinds")).alias("p"), (F.col("n") / F.col("total")).alias("weighted"))


def surprisal(tape: DataFrame) -> DataFrame:
    """H9: (turn, surprisal) in nats of each event after its predecessor."""
    return bigrams(tape).join(continuations(tape), ["a", "b"]).select("turn", (-F.log("p")).alias("surprisal"))


def td_credit(tape: DataFrame, gamma: float, back: int = 8) -> DataFrame:
    """Credit of a symbol: gamma to the lag of each failure it precedes within ``back`` turns, negative, or success, positive."""
    rows = with_previous(tape, {"sym": symbol()}, back)
    delta = F.when(F.col("outcome") > 0, -1.0).otherwise(1.0)
    lags = F.array(*[F.struct(F.col(f"sym_{i}").alias("sym"), (delta * gamma**i).alias("credit")) for i in range(1, back + 1)])
    return rows.select(F.explode(lags).alias("l")).where(F.col("l.sym").isNotNull()).groupBy(F.col("l.sym").alias("sym")).agg(F.sum("l.credit").alias("credit"))


def counterfactuals(tape: DataFrame, context: str, taken: str, least: int, k: int) -> DataFrame:
    """What else followed a context, and how much less often it then failed."""
    rows = with_previous(tape, {"sym": symbol(), "fail": (F.col("outcome") > 0).cast("int")}, 2)
    nxt = rows.where(F.col("sym_2") == context).groupBy(F.col("sym_1").alias("sym")).agg(F.count(F.lit(1)).alias("support"), F.avg((F.col("outcome") > 0).cast("double")).alias("fail_ratio"))
    base = F.coalesce(F.max(F.when(F.col("sym") == taken, F.col("fail_ratio"))).over(Window.partitionBy()), F.lit(0.5))
    out = nxt.withColumn("delta", base - F.col("fail_ratio")).where((F.col("sym") != taken) & (F.col("support") >= least))
    low = wilson(F.col("fail_ratio") * F.col("support"), F.col("support"), Z90)[0]
    return out.withColumn("wilson_lower", low).orderBy(F.col("delta").desc(), "wilson_lower", "sym").limit(k)


def q_values(tape: DataFrame, alpha: float = 0.1, gamma: float = 0.9) -> DataFrame:
    """Value of each symbol within its session, by one temporal-difference pass in order.

    A session is folded as a whole; sessions run in parallel, and the values of a
    symbol are then averaged by the number of its visits.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("turn")
        q: dict[str, float] = {}
        seen: dict[str, int] = {}
        syms, reward = pdf["sym"].tolist(), pdf["reward"].tolist()
        for i, s in enumerate(syms):
            ahead = q.get(syms[i + 1], 0.0) if i + 1 < len(syms) else 0.0
            q[s] = q.get(s, 0.0) + alpha * (reward[i] + gamma * ahead - q.get(s, 0.0))
            seen[s] = seen.get(s, 0) + 1
        return pd.DataFrame({"sym": list(q), "q": list(q.values()), "visits": [seen[s] for s in q]})

    rows = tape.select("session_id", "turn", symbol().alias("sym"), F.when(F.col("outcome") > 0, -1.0).otherwise(1.0).alias("reward"))
    per = rows.groupBy("session_id").applyInPandas(fold, "sym string, q double, visits long")
    return per.groupBy("sym").agg((F.sum(F.col("q") * F.col("visits")) / F.sum("visits")).alias("q"), F.sum("visits").alias("visits"))


def causal(tape: DataFrame, tool: str, entity: str, k: int, any_outcome: bool = False) -> DataFrame:
    """Latest events of a tool on an entity; successful ones unless told otherwise."""
    hit = (F.col("tool") == tool) & (F.col("entity") == entity)
    return tape.where(hit if any_outcome else hit & (F.col("outcome") == 0)).orderBy(F.col("turn").desc()).limit(k)


def rejected(decisions: DataFrame, sym: str, k: int) -> DataFrame:
    """Decisions in which an action was among the rejected, latest first."""
    return decisions.where(F.array_contains("rejected", sym)).orderBy(F.col("turn").desc()).limit(k)


def decisions(tape: DataFrame) -> DataFrame:
    """Decision points: each event with the two symbols before it as rejected alternatives."""
    rows = with_previous(tape, {"sym": symbol()}, 2)
    return rows.select("turn", symbol().alias("chosen"), F.array_compact(F.array("sym_1", "sym_2")).alias("rejected"))


def active_entities(tape: DataFrame, start_ms: int, end_ms: int, most: int = 32) -> DataFrame:
    """Entities active in a window, busiest first, 32 at most."""
    return tape.where(F.col("ts_ms").between(start_ms, end_ms)).groupBy("entity").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "entity").limit(most)


def rules(tape: DataFrame, least: int) -> DataFrame:
    """Bigrams with support, outcome of the second symbol, first and last turn; numbered by support and symbols."""
    r = bigrams(tape).groupBy("a", "b").agg(F.count(F.lit(1)).alias("support"), F.max(F.least("outcome", F.lit(1))).cast("double").alias("avg_outcome"), (F.min("turn") - 1).alias("first"), (F.max("turn") - 1).alias("last"))
    return r.where(F.col("support") >= least)


def verbalised(rule: DataFrame) -> DataFrame:
    """A sentence for each rule."""
    text = F.format_string("after %s comes %s (%d times, turns %d to %d)", F.col("a"), F.col("b"), F.col("support"), F.col("first"), F.col("last"))
    return rule.select("a", "b", text.alias("text"))


def refutations(tape: DataFrame, least: int) -> DataFrame:
    """Per rule how often its antecedent was followed by the consequent or by another symbol.

    Status under the hysteresis of 0.4 and 0.2 depends on order only through the
    crossing, so the batch gives it from the final ratio.
    """
    pairs = bigrams(tape)
    total = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.max("ts_ms").alias("last_ts"))
    out = rules(tape, least).join(total, "a").withColumn("contradict", F.col("n") - F.col("support"))
    return out.select("a", "b", "support", "contradict", (F.col("contradict") / F.col("n")).alias("ratio"), F.when(F.col("contradict") / F.col("n") > 0.4, "refuted").otherwise("live").alias("status"), "last_ts")


def market(refuted: DataFrame) -> DataFrame:
    """Share, Wilson interval, entropy and probe value of every rule seen three times."""
    n = F.col("support") + F.col("contradict")
    p = F.col("support") / n
    low, high = wilson(F.col("support"), n, Z95)
    gain = F.when((p > 0) & (p < 1), -(p * F.log2(p) + (1 - p) * F.log2(1 - p))).otherwise(0.0)
    return refuted.where(n >= 3).select("a", "b", p.alias("p_hat"), F.greatest(low, F.lit(0.0)).alias("wilson_lower"), F.least(high, F.lit(1.0)).alias("wilson_upper"), gain.alias("info_gain"), (gain * (1 - F.abs(p - 0.5) * 2)).alias("probe_value"), "ratio")


def experiments(hypotheses: DataFrame, k: int) -> DataFrame:
    """Worth probing and not refuted."""
    return hypotheses.where((F.col("probe_value") > 0.4) & (F.col("ratio") < 0.3)).orderBy(F.col("probe_value").desc(), "a", "b").limit(k)


def compressed(tape: DataFrame, threshold: float) -> DataFrame:
    """The tape without predictable successes; failures and the ends of sessions stay.

    Confidence is 2^-s of the surprisal s in nats, as the reference computes it.
    """
    rows = with_previous(tape, {"session": "session_id", "sym": symbol()}, 1)
    ahead = with_previous(tape.select((-F.col("turn")).alias("turn"), "session_id"), {"session": "session_id"}, 1).select((-F.col("turn")).alias("turn"), F.col("session_1").alias("next_session"))
    p = continuations(tape)
    joined = rows.join(ahead, "turn", "left").join(p, (rows["sym_1"] == p["a"]) & (symbol() == p["b"]), "left")
    bound = F.col("session_1").isNull() | (F.col("session_1") != F.col("session_id")) | F.col("next_session").isNull() | (F.col("next_session") != F.col("session_id"))
    sure = F.pow(F.lit(2.0), F.log("p")) > threshold
    return joined.where(~((F.col("outcome") == 0) & ~bound & F.coalesce(sure, F.lit(False)))).select(*tape.columns)


def tape_stats(tape: DataFrame) -> DataFrame:
    """Events, failures, sessions."""
    return tape.agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("outcome") > 0).alias("failures"), F.count_distinct("session_id").alias("sessions"))


def free_energy(tape: DataFrame, alpha_prior: float = 0.5, ewma: float = 0.1) -> DataFrame:
    """Per session, in order: negative log likelihood of (tool, outcome) under its suffix states, divergence, moving averages.

    States are the last symbols, of lengths 0 to 2; each keeps decayed counts.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("turn")
        counts: dict[tuple, dict] = {}
        drift = shock = 0.0
        out, past = [], []
        for turn, sym, emit in zip(pdf["turn"], pdf["sym"], pdf["emit"], strict=True):
            states = [tuple(past[len(past) - n :]) for n in range(min(len(past), 2) + 1)]
            nll = np.array([-np.log((counts.get(s, {}).get(emit, 0.0) + alpha_prior) / (sum(counts.get(s, {}).values()) + alpha_prior * 10)) for s in states])
            w = np.exp(-(nll - nll.min()))
            q = w / w.sum()
            kl = float((q * np.log(np.maximum(q * len(states), 1e-30))).sum())
            value = float((q * nll).sum())
            hit = value > 2.5 and kl < 0.3
            drift, shock = ewma * kl + (1 - ewma) * drift, ewma * float(hit) + (1 - ewma) * shock
            for s, x in zip(states, q, strict=True):
                c = counts.setdefault(s, {})
                for key in c:
                    c[key] *= 0.99**x
                c[emit] = c.get(emit, 0.0) + x
            past = (past + [sym])[-2:]
            out.append((turn, value, kl, value + kl, hit, drift, shock))
        return pd.DataFrame(out, columns=["turn", "nll", "kl", "free_energy", "emission_shock", "drift", "shock"])

    rows = tape.select("session_id", "turn", symbol().alias("sym"), F.concat_ws("|", "tool", F.col("outcome").cast("string")).alias("emit"))
    return rows.groupBy("session_id").applyInPandas(fold, "turn long, nll double, kl double, free_energy double, emission_shock boolean, drift double, shock double")


def health(samples: DataFrame) -> DataFrame:
    """Label of each sample from its ratios and the change since the one before."""
    w = Window.orderBy("sample")
    d = lambda c: F.coalesce(F.col(c) - F.lag(c).over(w), F.lit(0))
    rows = samples.withColumns({"delta_states": d("states"), "delta_events": d("events")})
    label = (
        F.when((F.col("refuted") > 0) & (F.col("refuted") * 2 >= F.col("rules")), "refutation_flood")
        .when((F.col("delta_states") == 0) & (F.col("delta_events") > 20), "stale")
        .when((F.col("q_variance") < 0.005) & (F.col("states") > 50), "q_collapse")
        .when((F.col("mean_probe") > 0.65) & (F.col("hypotheses") >= 5), "high_uncertainty")
        .when(F.col("drift") > 0.5, "fep_context_drift")
        .when(F.col("shock") > 0.3, "fep_emission_shock")
        .otherwise("healthy")
    )
    return rows.withColumn("diagnosis", label)


def consolidation(tape: DataFrame, least: int, threshold: float) -> DataFrame:
    """One row of what a consolidation pass finds: rules, refuted, hypotheses, events kept, symbols, variance of values."""
    ref = materialize(refutations(tape, least), "refutations")
    m = market(ref)
    kept = compressed(tape, threshold).count()
    q = q_values(tape).agg(F.count(F.lit(1)).alias("states"), F.var_pop("q").alias("q_variance")).first()
    r = ref.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "refuted").alias("bad")).first()
    h = m.agg(F.count(F.lit(1)).alias("n"), F.avg("probe_value").alias("probe")).first()
    row = (r["n"], r["bad"], h["n"], h["probe"], kept, q["states"], q["q_variance"])
    return tape.sparkSession.createDataFrame([row], "rules long, refuted long, hypotheses long, mean_probe double, kept long, states long, q_variance double")


def promotable_policies(trials: DataFrame) -> DataFrame:
    """Promoted with 20 shadow runs and a lift above 0.15; demoted when more than 0.3 of the outcomes are bad."""
    return trials.withColumn("decision", F.when(F.col("bad_ratio") > 0.3, "demote").when((F.col("shadow") >= 20) & (F.col("lift") > 0.15), "promote").otherwise("keep"))


def transitions(accesses: DataFrame, most: int = 32, least: float = 0.01) -> DataFrame:
    """(src, dst, p): first-order access model, rare targets dropped, 32 at most, renormalised."""
    rows = with_previous(accesses, {"m": "memory_id"}, 1).where(F.col("m_1").isNotNull() & (F.col("m_1") != F.col("memory_id")))
    c = rows.groupBy(F.col("m_1").alias("src"), F.col("memory_id").alias("dst")).agg(F.count(F.lit(1)).alias("n"))
    total = c.groupBy("src").agg(F.sum("n").alias("total"))
    p = c.join(total, "src").withColumn("p", F.col("n") / F.col("total")).where(F.col("p") >= least)
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.col("p").desc(), "dst"))
    return p.withColumn("rank", rank).where(F.col("rank") <= most).select("src", "dst", "p")


def costed(tape: DataFrame, token_cost: Column, latency_ms: Column, retries: Column) -> DataFrame:
    """Utility of each event: plus or minus one, less its costs."""
    u = F.when(F.col("outcome") == 0, 1.0).otherwise(-1.0) - token_cost / 10_000.0 - latency_ms / 60_000.0 - 0.1 * retries
    return tape.withColumn("utility", u)
