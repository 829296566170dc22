"""Ordered work within keys of which one may hold a third of all rows.

A window over one key runs in one task. Keys above ``hot_rows`` are therefore
cut into value ranges ("blocks"); a window then runs inside a block and what
crosses blocks is carried by a table of one row per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.storage import materialize

HOT_ROWS = 500_000
SPLITS = 128


def hot_bounds(df: DataFrame, keys: list[str], order: str, hot_rows: int = HOT_ROWS, splits: int = SPLITS) -> DataFrame | None:
    """Range bounds of ``order`` for each key with more than ``hot_rows`` rows; None if there is no such key.

    At most rows/hot_rows keys can be hot, so the result holds at most
    ``splits * rows / hot_rows`` numbers and is safe to broadcast. Null keys are
    never hot: callers drop them first. Counting is pre-aggregated map-side.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows).select(*keys)
    hot = counts.collect()  # at most rows / hot_rows of them
    if not hot:
        return None
    hot = df.sparkSession.createDataFrame(hot, counts.schema)
    fractions = [i / splits for i in range(1, splits)]
    bounds = df.join(F.broadcast(hot), keys, "left_semi").groupBy(*keys).agg(F.percentile_approx(order, fractions, 20 * splits).alias("_bounds"))
    return materialize(bounds, "hot-bounds")  # an approximation: every use must see the same one


def block_of(value: Column, bounds: Column) -> Column:
    """Number of bounds below ``value``: 0 where the key is not hot; monotone in ``value``."""
    return F.coalesce(F.size(F.filter(bounds, lambda b: b < value)), F.lit(0))


def with_block(df: DataFrame, keys: list[str], order: str, hot_rows: int = HOT_ROWS, splits: int = SPLITS, name: str = "_blk") -> DataFrame:
    """Add the block number ``name`` of each row, 0 for all rows of keys that are not hot."""
    bounds = hot_bounds(df, keys, order, hot_rows, splits)
    if bounds is None:
        return df.withColumn(name, F.lit(0))
    return df.join(F.broadcast(bounds), keys, "left").withColumn(name, block_of(F.col(order), F.col("_bounds"))).drop("_bounds")


def order_bounds(df: DataFrame, keys: list[str], order: list[str], hot_rows: int = HOT_ROWS, splits: int = SPLITS) -> DataFrame | None:
    """Range bounds of the whole ``order`` for each key with more than ``hot_rows`` rows; None if there is no such key.

    As :func:`hot_bounds`, but bounds are structs of all order columns, so rows
    that tie on the first are parted by the next. They come from a hash sample of
    about 64 rows a range, of hot keys only: a bounded list per key.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows)
    hot = counts.collect()  # at most rows / hot_rows of them
    if not hot:
        return None
    hot = df.sparkSession.createDataFrame(hot, counts.schema)
    part = F.pmod(F.xxhash64(*keys, *order), F.lit(1_000_000)) < F.ceil(F.lit(64_000_000.0 * splits) / F.col("_n"))
    sample = df.select(*keys, *order).join(F.broadcast(hot), keys).where(part).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order))).alias("_s"))
    at = lambda i: F.get("_s", F.floor(F.size("_s") * F.lit(i / splits)).cast("int"))
    bounds = sample.select(*keys, F.array_distinct(F.array(*[at(i) for i in range(1, splits)])).alias("_bounds"))
    return materialize(bounds, "hot-bounds")


def ordered(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    lag: dict[str, str] | None = None,
    lead: dict[str, str] | None = None,
    running_max: dict[str, Column] | None = None,
    number: str | None = None,
    hot_rows: int = HOT_ROWS,
    splits: int = SPLITS,
) -> DataFrame:
    """Previous and next values, running maxima and row numbers within keys, whatever a key's size.

    ``lag`` and ``lead`` map new names to columns; ``order`` is unique within a
    key. Keys above ``hot_rows`` are cut into ranges of the whole order, ties of its
    first column included; first row, last row, maximum and count of each range are
    carried on by a window over one row per range.
    """
    lag, lead, running_max = lag or {}, lead or {}, running_max or {}
    bounds = order_bounds(df, keys, order, hot_rows, splits)
    if bounds is not None:
        df = df.join(F.broadcast(bounds), keys, "left").withColumn("_blk", block_of(F.struct(*order), F.col("_bounds"))).drop("_bounds")
    df = df.withColumns({f"_rm_{n}": c for n, c in running_max.items()})
    within = keys if bounds is None else [*keys, "_blk"]
    w = Window.partitionBy(*within).orderBy(*order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    made = {n: F.lag(c).over(w) for n, c in lag.items()} | {n: F.lead(c).over(w) for n, c in lead.items()} | {n: F.max(f"_rm_{n}").over(so_far) for n in running_max}
    if number:
        made[number] = F.row_number().over(w)
    if bounds is None:
        return df.withColumns(made).drop(*[f"_rm_{n}" for n in running_max])
    values = [F.col(c).alias(f"v_{n}") for n, c in (lag | lead).items()] or [F.lit(0).alias("v")]
    at = F.struct(*order)
    ends = df.groupBy(*within).agg(F.min_by(F.struct(*values), at).alias("_first"), F.max_by(F.struct(*values), at).alias("_last"), F.count(F.lit(1)).alias("_n"), *[F.max(f"_rm_{n}").alias(f"_m_{n}") for n in running_max])
    over = Window.partitionBy(*keys).orderBy("_blk")
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*within, F.lag("_last").over(over).alias("_cl"), F.lead("_first").over(over).alias("_cf"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_cn"), *[F.max(f"_m_{n}").over(before).alias(f"_cm_{n}") for n in running_max])
    rows = df.withColumns({f"_w_{n}": c for n, c in made.items()}).withColumns({"_top": F.row_number().over(w) == 1, "_end": F.row_number().over(Window.partitionBy(*within).orderBy(*[F.col(o).desc() for o in order])) == 1})
    rows = rows.join(carry, within)
    out = {n: F.when(F.col("_top"), F.col(f"_cl.v_{n}")).otherwise(F.col(f"_w_{n}")) for n in lag}
    out |= {n: F.when(F.col("_end"), F.col(f"_cf.v_{n}")).otherwise(F.col(f"_w_{n}")) for n in lead}
    out |= {n: F.greatest(f"_w_{n}", f"_cm_{n}") for n in running_max}
    if number:
        out[number] = (F.col(f"_w_{number}") + F.col("_cn")).cast("int")
    rows = rows.withColumns(out)
    return rows.drop("_blk", "_top", "_end", "_cl", "_cf", "_cn", *[f"_w_{n}" for n in made], *[f"_cm_{n}" for n in running_max], *[f"_rm_{n}" for n in running_max])
