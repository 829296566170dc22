"""Filling containers of fixed capacity with items that are not split (problem 9).

All decisions are taken on histograms of lengths, whose size depends on the
capacity and never on the number of items:

1. The capacity is cut into ``CLASSES`` classes of equal width (for any capacity;
   widths need not be whole numbers), and a length counts as the upper end of its
   class. Patterns of up to ``PARTS`` different classes, each used once or several
   times, that add up to the capacity are enumerated, and non-negative least
   squares fits how often each is used. Rounded down to what is there, this
   places most items.
2. Rounding lengths up leaves a little room in every container. The shortest
   items, as many as it takes to fill that room, are therefore kept out of step 1.
   They and what the fit left over go, longest first, into the fullest container
   they fit, or a new one, on exact lengths.

Items and containers of one length or free space are alike, so a plan row names
ranges of them by number. Numbers come from windows over (length, salt) plus a
table of counts, so a length that a third of all items share is no burden, and a
recomputed task numbers alike.

Defined results: an item longer than the capacity is cut into full containers and
a rest; items of length 0 or null take no space and have no row; ids must be
unique and not null (other rows are ignored); an empty table gives no rows; ties
go by id.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.storage import materialize

CLASSES, PARTS = 128, 3
SALTS = 64
#: How many times the room left by rounding the items kept for it should amount to.
RESERVE = 2.0
#: Smallest part of a repeat that is rounded up while its items last.
LEAST_PART = 0.5


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """Non-negative x that minimises |a x - b|, by the active-set method of Lawson and Hanson."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, dtype=bool)
    tol = 1e-9 * max(1.0, np.abs(a.T @ b).max(initial=0.0))
    for _ in range(rounds):
        gain = a.T @ (b - a @ x)
        gain[passive] = -np.inf
        j = int(gain.argmax()) if n else 0
        if not n or gain[j] <= tol:
            break
        passive[j] = True
        while True:
            on = np.nonzero(passive)[0]
            z = np.zeros(n)
            z[on] = np.linalg.lstsq(a[:, on], b, rcond=None)[0]
            low = on[z[on] <= 1e-12]
            if not len(low):
                break
            step = min(1.0, float((x[low] / np.maximum(x[low] - z[low], 1e-300)).min()))
            x = x + step * (z - x)
            passive &= x > 1e-12
            x[~passive] = 0.0
            if not passive.any():
                break
        x = np.where(passive, z, 0.0)
    return x


def patterns(classes: int, parts: int, present: np.ndarray) -> list[tuple[tuple[int, int], ...]]:
    """((class, times), ...) of up to ``parts`` different present classes that add up to ``classes``, greater classes first.

    A class of a pattern of three or more fills at least a third of what the
    greater ones leave, or else patterns would be as many as partitions.
    """
    out: list[tuple[tuple[int, int], ...]] = []
    known = [c for c in range(len(present) - 1, 0, -1) if present[c]]

    def grow(head: tuple[tuple[int, int], ...], rest: int, at: int) -> None:
        last = len(head) == parts - 1
        for i in range(at, len(known)):
            c = known[i]
            if c > rest or (last and rest % c):
                continue
            for times in [rest // c] if last else range(rest // c, 0, -1):
                left = rest - c * times
                if left == 0:
                    out.append((*head, (c, times)))
                elif parts < 3 or not head or 3 * c * times >= rest:
                    grow((*head, (c, times)), left, i + 1)

    if parts > 0:
        grow((), classes, 0)
    return out


def kept_short(count: np.ndarray, total: np.ndarray, capacity: int) -> np.ndarray:
    """Which classes stay out of the patterns: the shortest, until they can fill the room that rounding leaves in the others."""
    classes = len(count) - 1
    top = np.arange(classes + 1) * capacity / classes
    room = np.maximum(count * top - total, 0.0)
    kept = np.zeros(classes + 1, dtype=bool)
    for c in range(1, classes + 1):
        if total[kept].sum() >= RESERVE * room[~kept].sum():
            break
        kept[c] = True
    return kept


def plan_patterns(histogram: np.ndarray, parts: int = PARTS) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """(pattern, number of containers); no class is used more often than it occurs."""
    classes = len(histogram) - 1
    found = patterns(classes, parts, histogram > 0)
    if not found:
        return []
    need = np.zeros((classes + 1, len(found)))
    for j, p in enumerate(found):
        for c, times in p:
            need[c, j] = times
    # long items weigh more: what remains of the short ones is easy to place
    weight = (np.arange(1, classes + 1) / classes) ** 2
    scale = max(1.0, float(histogram.max()))
    x = nnls(need[1:] * weight[:, None], histogram[1:] / scale * weight) * scale
    left, plan = histogram.astype(np.int64).copy(), []
    for fraction in (False, True):  # whole repeats first, then one more where items are left
        for j in np.argsort(-x, kind="stable"):
            use = need[:, j] > 0
            most = int((left[use] // need[use, j]).min())
            n = min(int(x[j]) if not fraction else int(x[j] % 1 >= LEAST_PART), most)
            if n:
                left -= n * need[:, j].astype(np.int64)
                plan.append((found[j], n))
    return _give_back(plan, left, classes)


def _give_back(plan: list, left: np.ndarray, classes: int) -> list:
    """Take back containers of short items only, until they can fill the room next to long items that found no pattern.

    Each item left over that exceeds half a container opens one of its own.
    """
    half = classes // 2 + 1
    room = float((left[half:] * (classes - np.arange(half, classes + 1))).sum()) - float((left[:half] * np.arange(half)).sum())
    out = []
    for pattern, n in sorted(plan, key=lambda p: p[0][0][0]):
        back = min(n, max(0, int(-(-room // classes)))) if pattern[0][0] < half else 0
        room -= back * classes
        if n > back:
            out.append((pattern, n - back))
    return out


def plan_rest(items: dict[int, int], free: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best fit on counts: rows (length, first item, number, free space of old containers or -1, first container).

    ``items`` and ``free`` map length and free space to counts; also returns the
    number of new containers. Ranges of alike containers move together, and the
    free spaces in use are kept sorted, so a step costs a binary search.
    """
    room: dict[int, list[tuple[int, int, int]]] = {}  # free now -> (kind, first, number)
    spaces: list[int] = []

    def add(space: int, part: tuple[int, int, int]) -> None:
        if space not in room:
            room[space] = []
            insort(spaces, space)
        room[space].append(part)

    for f, n in sorted(free.items()):
        if f > 0 and n:
            add(f, (f, 0, n))
    rows, fresh = [], 0
    for length in sorted(items, reverse=True):
        at, end = 0, items[length]
        while at < end:
            place = bisect_left(spaces, length)
            if place == len(spaces):
                opened = -(-(end - at) // (capacity // length))
                add(capacity, (-1, fresh, opened))
                fresh += opened
            fits = spaces[place]
            kind, first, n = room[fits].pop()
            use = min(n, end - at)
            rows.append((length, at, use, kind, first))
            if use < n:
                room[fits].append((kind, first + use, n - use))
            elif not room[fits]:
                del room[fits]
                del spaces[place]
            if fits > length:
                add(fits - length, (kind, first, use))
            at += use
    return rows, fresh


def _numbered(rows: DataFrame, key: str, *ids: str) -> DataFrame:
    """Add ``number``, 0.. within each value of ``key``; the key's values are few, its rows may be many."""
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64(*ids), F.lit(SALTS)))
    counts = rows.groupBy(key, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(key).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(key, "_salt", F.coalesce(before, F.lit(0)).alias("_off"))  # at most values x SALTS rows
    inside = F.row_number().over(Window.partitionBy(key, "_salt").orderBy(*ids))
    return rows.withColumn("_rn", inside).join(F.broadcast(offsets), [key, "_salt"]).withColumn("number", F.col("_rn") + F.col("_off") - 1).drop("_salt", "_rn", "_off")


def pack(lengths: DataFrame, capacity: int, item: str = "doc_id", length: str = "n_tokens", classes: int = CLASSES, parts: int = PARTS) -> DataFrame:
    """(item, part, n_tokens, container_id, start, by_pattern) of every piece; pieces of a container follow one another."""
    spark, classes = lengths.sparkSession, min(classes, capacity)
    size = F.col(length).cast("long")
    whole = lengths.where(F.col(item).isNotNull() & (size > 0)).select(F.col(item).alias("id"), size.alias("n"))
    cut = F.expr(f"sequence(0L, (n - 1) div {capacity})")
    items = whole.select("id", F.explode(cut).alias("part"), "n").select("id", "part", F.least(F.lit(capacity), F.col("n") - F.col("part") * capacity).cast("int").alias("length"))
    class_ = F.expr(f"CAST((length * {classes}L + {capacity - 1}L) div {capacity} AS INT)")
    items = materialize(items.withColumn("class", class_), "items")

    count, total = np.zeros(classes + 1), np.zeros(classes + 1)
    for r in items.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("s")).collect():  # one row a class
        count[r["class"]], total[r["class"]] = r["n"], r["s"]
    histogram = np.where(kept_short(count, total, capacity), 0, count)
    used, base, ranges = np.zeros(classes + 1, dtype=np.int64), 0, []
    for pattern, n in plan_patterns(histogram, parts):
        for c, times in pattern:
            for _ in range(times):
                ranges.append((int(c), int(used[c]), int(used[c] + n), int(base)))
                used[c] += n
        base += n
    plan = spark.createDataFrame(ranges, "class int, lo long, hi long, base long")
    number = F.col("number")
    hit = _numbered(items, "class", "id", "part").alias("i").join(F.broadcast(plan.alias("p")), (F.col("i.class") == F.col("p.class")) & (number >= F.col("p.lo")) & (number < F.col("p.hi")), "left")
    placed = materialize(hit.select("id", "part", "length", (F.col("base") + number - F.col("lo")).alias("container")), "placed")

    room = placed.where(F.col("container").isNotNull()).groupBy("container").agg((F.lit(capacity) - F.sum("length")).alias("free")).where(F.col("free") > 0)
    room = materialize(room, "room")
    rest = placed.where(F.col("container").isNull()).drop("container")
    count = lambda df, key: {r[0]: r[1] for r in df.groupBy(key).agg(F.count(F.lit(1))).collect()}  # noqa: E731 - at most capacity rows
    rows, _ = plan_rest(count(rest, "length"), count(room, "free"), capacity)
    fill = spark.createDataFrame(rows or [(0, 0, 0, 0, 0)], "length int, lo long, n long, kind long, first long")
    moved = _numbered(rest, "length", "id", "part").alias("i").join(F.broadcast(fill.alias("p")), (F.col("i.length") == F.col("p.length")) & (number >= F.col("p.lo")) & (number < F.col("p.lo") + F.col("p.n")))
    moved = moved.select("id", "part", F.col("i.length").alias("length"), F.col("kind"), (F.col("first") + number - F.col("lo")).alias("slot"))
    slots = _numbered(room, "free", "container").select(F.col("free").alias("kind"), F.col("number").alias("slot"), "container")
    old = moved.where(F.col("kind") >= 0).join(slots, ["kind", "slot"]).select("id", "part", "length", "container")
    new = moved.where(F.col("kind") < 0).select("id", "part", "length", (F.lit(base) + F.col("slot")).alias("container"))
    late = old.unionByName(new).withColumn("by_pattern", F.lit(False))
    every = placed.where(F.col("container").isNotNull()).withColumn("by_pattern", F.lit(True)).unionByName(late)
    start = F.sum("length").over(Window.partitionBy("container").orderBy("id", "part").rowsBetween(Window.unboundedPreceding, -1))
    return every.select(F.col("id").alias(item), "part", F.col("length").cast("long").alias(length), F.col("container").alias("container_id"), F.coalesce(start, F.lit(0)).cast("long").alias("start"), "by_pattern")
