"""The scoring factors (F1-F29) as columns, and the pipeline that combines them.

Each factor is a function of a row's columns; the registry holds them by name,
so a caller can add or replace one. ``score`` multiplies relevance with a
bounded share of the product of all others; a null factor vetoes the row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY_MS = 86_400_000.0

#: Multipliers by label.
STATUS = {"Verified": 1.15, "Active": 1.0, "Observed": 0.85, "Proposed": 0.65}
EPISTEMIC = {0: 1.0, 1: 0.95, 2: 0.85, 3: 0.75}
KIND = {"correction": 1.3, "wisdom": 1.1, "insight": 1.05, "episode": 0.7, "operational": 0.8}


@dataclass(frozen=True)
class Context:
    """What a query brings to scoring; ``now_ms`` is given, never read from a clock."""

    now_ms: int
    mode: str = "semantic"
    valence: float | None = None
    arousal: float | None = None
    max_query_idf: float = 0.0
    replication_max: float = 0.0
    disabled: frozenset[str] = frozenset()


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def lookup(column: Column, table: dict, default: float | None = None) -> Column:
    out = F.lit(default).cast("double")
    for key, value in table.items():
        out = F.when(column == F.lit(key), F.lit(value)).otherwise(out)
    return out


def age_days(at: Column, now_ms: int) -> Column:
    return F.greatest(F.lit(now_ms) - at, F.lit(0)) / F.lit(DAY_MS)


def effective_strength(now_ms: int, strength: str = "strength", rate: str = "decay_rate", since: str = "last_strengthened_ms") -> Column:
    """Strength after exponential decay since it was last strengthened."""
    return clamp(F.col(strength) * F.exp(-F.col(rate) * age_days(F.col(since), now_ms)))


def activation(now_ms: int, times: str = "access_ts", count: str = "access_count", created: str = "created_ms") -> Column:
    """Base-level activation (F25): power-law sum over known accesses, a uniform estimate for the others, a sigmoid."""
    days = lambda at: F.greatest(F.lit(now_ms) - at, F.lit(60_000)) / F.lit(DAY_MS)
    known = F.aggregate(F.coalesce(times, F.array().cast("array<long>")), F.lit(0.0), lambda s, t: s + F.pow(days(t), F.lit(-0.5)))
    missing = F.greatest(F.col(count) - F.coalesce(F.size(times), F.lit(0)), F.lit(0))
    life = F.pow(days(F.col(created)), F.lit(-0.5))
    total = known + missing * life / 0.5
    total = F.when(total > 0, total).otherwise(life)
    return 1.0 / (1.0 + F.exp(-(F.log(total) + 1.0) / 1.5))


def spacing_quality(times: str = "access_ts") -> Column:
    """Regularity of the access intervals, 1/(1 + cv); 0 with fewer than three accesses."""
    t = F.col(times)
    gaps = F.zip_with(F.slice(t, F.lit(2), F.greatest(F.size(t) - 1, F.lit(0))), F.slice(t, F.lit(1), F.greatest(F.size(t) - 1, F.lit(0))), lambda b, a: F.greatest(b - a, F.lit(1)).cast("double"))
    n = F.size(gaps).cast("double")
    mean = F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x) / n
    var = F.aggregate(gaps, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / n
    return F.when(F.size(t) >= 3, 1.0 / (1.0 + F.sqrt(var) / mean)).otherwise(0.0)


def relevance(mode: str = "semantic", similarity: str = "relevance_score") -> Column:
    """Calibrated sigmoid of a cosine, or the raw lexical score (F2)."""
    s = F.col(similarity)
    return 1.0 / (1.0 + F.exp(-(3.27 * s - 0.85))) if mode == "semantic" else s


def replication(count: Column, most: float) -> Column:
    """Boost by distinct sessions, saturating at three; 1 unless ``most`` exceeds 1."""
    if not most > 1.0 or most == float("inf"):
        return F.lit(1.0)
    n = F.least(F.greatest(count, F.lit(1)), F.lit(3)) - 1
    return F.lit(1.0) + F.lit(most - 1.0) * n * (5 - n) / 6.0


def reliability(mean: Column) -> Column:
    """Bounded reliability of a realm from its posterior mean, 0.85 where unknown."""
    return clamp(0.5 + 0.5 * F.coalesce(mean, F.lit(0.85)), 0.5, 1.0)


def learned_weight(baseline: Column, delta: Column, low: float, high: float) -> Column:
    """Baseline plus learned delta, clamped."""
    return clamp(baseline + F.coalesce(delta, F.lit(0.0)), low, high)


def _mood(ctx: Context) -> Column:
    if ctx.valence is None or ctx.arousal is None or ctx.arousal <= 0.1:
        return F.lit(1.0)
    match = F.greatest(1.0 - F.abs(F.lit(ctx.valence) - F.col("valence")), F.lit(0.0))
    return 1.0 + 0.2 * match * F.greatest(F.lit(ctx.arousal), F.col("arousal"))


def _frustration(ctx: Context) -> Column:
    v, a = ctx.valence, ctx.arousal
    if v is None or a is None or v >= -0.3 or a <= 0.4:
        return F.lit(1.0)
    f = min(-v - 0.3, 0.7) * min(a - 0.4, 0.6)
    return F.when(F.col("kind") == "correction", 1.0 + 1.5 * f).when(F.col("kind") == "preference", 1.0 + 1.0 * f).otherwise(1.0)


def _surprise_domain(ctx: Context) -> Column:
    m = F.col("surprise_magnitude")
    return F.when(F.col("surprise_role") == "actual", 1.0 + 0.15 * m).when(F.col("surprise_role") == "expected", F.greatest(1.0 - 0.1 * m, F.lit(0.1))).otherwise(1.0)


def _ack(ctx: Context) -> Column:
    a = F.coalesce("ack", F.lit(0))
    return F.when(a >= 3, 1.2).when(a >= 1, 1.1).when(a <= -3, 0.8).when(a <= -1, 0.9).otherwise(1.0)


#: Factors by name, relevance apart. Columns a factor needs beyond the state are listed in OPTIONAL.
FACTORS: dict[str, Callable[[Context], Column]] = {
    "actr": lambda c: 0.3 + 0.7 * activation(c.now_ms),
    "confidence": lambda c: F.col("confidence"),
    "replication": lambda c: replication(F.col("replication_count"), c.replication_max),
    "surprise": lambda c: 1.0 + 0.25 * F.col("surprise"),
    "arousal": lambda c: 1.0 + 0.15 * F.col("arousal"),
    "mood": _mood,
    "frustration": _frustration,
    "status": lambda c: lookup(F.col("status"), STATUS),
    "epistemic": lambda c: lookup(F.col("epistemic"), EPISTEMIC),
    "kind": lambda c: lookup(F.col("kind"), KIND, 1.0),
    "strength": lambda c: 0.5 + 0.5 * effective_strength(c.now_ms),
    "interference": lambda c: F.pow(1.0 - clamp(F.col("competitive_weight")), F.lit(0.3)),
    "spacing": lambda c: F.when(F.col("access_count") < 2, 1.0).otherwise(0.85 + 0.15 * F.col("spacing_quality")),
    "realm_reliability": lambda c: reliability(F.col("realm_mean")),
    "prediction": lambda c: F.when(F.col("prediction_prob") > 0, 1.0 + 0.3 * F.col("prediction_prob")).otherwise(1.0),
    "surprise_domain": _surprise_domain,
    "epistemic_debt": lambda c: F.when(F.coalesce("has_open_debt", F.lit(False)), 1.1).otherwise(1.0),
    "ack": _ack,
    "integration": lambda c: F.coalesce("source_weight", F.lit(1.0)),
    "rare_entity": lambda c: F.lit(1.0 + 0.15 * min(c.max_query_idf / 10.0, 1.0) if c.max_query_idf > 0 else 1.0),
    "staged": lambda c: F.when(F.col("staged"), 0.8).otherwise(1.0),
}
#: Columns that default to null where the input has none.
OPTIONAL = {
    "access_ts": "array<bigint>",
    "replication_count": "bigint",
    "realm_mean": "double",
    "prediction_prob": "double",
    "surprise_role": "string",
    "surprise_magnitude": "double",
    "has_open_debt": "boolean",
    "ack": "bigint",
    "source_weight": "double",
}


def decompose(rows: DataFrame, ctx: Context, factors: dict[str, Callable[[Context], Column]] | None = None) -> DataFrame:
    """Add ``f_<name>`` per factor, ``relevance``, ``secondary`` and ``score`` (F1); rows with a null factor go."""
    factors = FACTORS if factors is None else factors
    for name, kind in OPTIONAL.items():
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    parts = {f"f_{n}": f(ctx).cast("double") for n, f in factors.items() if n not in ctx.disabled} | {"relevance": relevance(ctx.mode)}
    # One condition per factor, before the projection: the optimizer derives constraints from
    # conditions, and one over the whole product would multiply by every factor's name.
    for p in parts.values():
        rows = rows.where(p.isNotNull())
    rows = rows.withColumns(parts)
    product: Column = F.lit(1.0)
    for n in parts:
        if n != "relevance":
            product = product * F.col(n)
    rows = rows.withColumn("secondary", product)
    return rows.withColumn("score", F.col("relevance") * (0.7 + 0.3 * F.col("secondary")))


def utility(successes: Column, failures: Column) -> Column:
    """Posterior mean of the outcome weights, each capped at 5 and positive."""
    return (1.0 + successes) / (2.0 + successes + failures)


def capped_weight(weight: Column) -> Column:
    """Weight an outcome adds to the posterior: 0 unless positive, 5 at most."""
    return F.when(F.isnan(weight) | ~(weight > 0), 0.0).otherwise(F.least(weight, F.lit(5.0)))
