"""Statistics as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wilson(successes: Column, n: Column, z: float = 1.645) -> tuple[Column, Column]:
    """Lower and upper bound of the Wilson interval of a proportion; null where n is 0."""
    n = n.cast("double")
    p = successes / F.nullif(n, F.lit(0.0))
    centre, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (centre - half) / (1 + z * z / n), (centre + half) / (1 + z * z / n)
