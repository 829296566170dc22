"""From a request to a plan: routing, intents, time windows in words."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import UTC, date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.operators import graph, lexical, tape

HOUR, DAY = 3_600_000, 86_400_000


@dataclass(frozen=True)
class Request:
    subject: str | None = None
    predicate: str | None = None
    freetext: str | None = None
    time_from_ms: int | None = None
    time_to_ms: int | None = None
    causal_tool: str | None = None
    causal_entity: str | None = None


def route(r: Request) -> str:
    """Causal, exact, temporal, hybrid or fuzzy; ``unbound:<slot>`` where something is missing."""
    if r.causal_tool is not None:
        return "causal" if r.causal_entity is not None else "unbound:causal_entity"
    exact = r.subject is not None or r.predicate is not None
    timed = r.time_from_ms is not None or r.time_to_ms is not None
    if r.freetext is not None:
        return "hybrid" if exact or timed else "fuzzy"
    return "exact" if exact else "temporal" if timed else "unbound:query_target"


def execute(r: Request, memory: DataFrame, triplets: DataFrame, events: DataFrame, now_ms: int, k: int) -> DataFrame:
    """(lane, id, score) of the lanes a request asks for; exact answers come before fuzzy ones, k in all."""
    way, lanes = route(r), []
    if way == "causal":
        hit = tape.causal(events, r.causal_tool, r.causal_entity, k)
        lanes.append(hit.select(F.lit(0).alias("lane"), F.col("turn").alias("id"), F.lit(1.0).alias("score")))
    if way in ("exact", "hybrid") and (r.subject is not None or r.predicate is not None):
        fixed = {n: v for n, v in (("subject", r.subject), ("predicate", r.predicate)) if v is not None}
        lanes.append(graph.lookup(triplets, now_ms, **fixed).select(F.lit(0).alias("lane"), "id", F.col("weight").alias("score")))
    low, high = r.time_from_ms or 0, r.time_to_ms if r.time_to_ms is not None else now_ms
    timed = memory.where(F.col("created_ms").between(low, high))
    if way == "temporal":
        lanes.append(timed.select(F.lit(1).alias("lane"), F.col("memory_id").alias("id"), (F.col("created_ms") / float(DAY)).alias("score")))
    if way in ("fuzzy", "hybrid"):
        lanes.append(lexical.bm25(timed, r.freetext, k).select(F.lit(2).alias("lane"), F.col("memory_id").alias("id"), F.col("bm25").alias("score")))
    if not lanes:
        raise ValueError(f"request is {way}")
    every = lanes[0]
    for lane in lanes[1:]:
        every = every.unionByName(lane)
    return every.orderBy("lane", F.col("score").desc(), "id").limit(k)


#: Words that show an intent, in order of precedence.
INTENTS = {"temporal": ["yesterday", "last week", "ago", "when"], "file_ref": [".cpp", ".rs", ".py", "fn ", "impl "], "correction": ["wrong", "correct", "actually", "mistake"], "code": ["rust", "function", "struct", "code"]}


def intent(text: Column) -> Column:
    """Intent of a text by the first list of which it holds a word."""
    low, out = F.lower(text), F.lit("general")
    for name, words in reversed(INTENTS.items()):
        hit = F.contains(low, F.lit(words[0]))
        for w in words[1:]:
            hit = hit | F.contains(low, F.lit(w))
        out = F.when(hit, name).otherwise(out)
    return out


MONTHS = "january february march april may june july august september october november december".split()
#: Lengths of rolling periods.
LENGTH = {"hour": HOUR, "day": DAY, "week": 7 * DAY, "month": 30 * DAY, "year": 365 * DAY}
YEARS = range(1970, 2200)


def _month(year: int, month: int) -> tuple[date, date]:
    return date(year, month, 1), date(year + month // 12, month % 12 + 1, 1)


def _span(words: list[str], at: int, today: date) -> tuple[date, date, int] | None:
    """Days a date phrase stands for, the end excluded, and the number of its words; None where none begins."""
    word = words[at] if at < len(words) else ""
    if word in ("today", "yesterday"):
        day = today - timedelta(days=word == "yesterday")
        return day, day + timedelta(days=1), 1
    if word in MONTHS:
        month, following = MONTHS.index(word) + 1, words[at + 1] if at + 1 < len(words) else ""
        if len(following) == 4 and following.isdigit() and int(following) in YEARS:
            return *_month(int(following), month), 2
        return *_month(today.year - (month > today.month), month), 1
    numbers = word.split("-")
    if [len(n) for n in numbers] not in ([4], [4, 2], [4, 2, 2]) or not all(n.isdigit() for n in numbers) or int(numbers[0]) not in YEARS:
        return None
    try:
        first = date(*map(int, [*numbers, "1", "1"][:3]))
    except ValueError:
        return None
    if len(numbers) == 1:
        return first, date(first.year + 1, 1, 1), 1
    return (*_month(first.year, first.month), 1) if len(numbers) == 2 else (first, first + timedelta(days=1), 1)


def _calendar(unit: str, today: date) -> tuple[date, date]:
    """First days of the last and of the present week (from Monday), month or year."""
    if unit == "week":
        start = today - timedelta(days=today.weekday())
        return start - timedelta(days=7), start
    start = today.replace(day=1) if unit == "month" else date(today.year, 1, 1)
    return ((start - timedelta(days=1)).replace(day=1) if unit == "month" else date(today.year - 1, 1, 1)), start


def time_window(query: str, now_ms: int, tz_offset_min: int = 0) -> tuple[int, int, str] | None:
    """(from, to, rest of the query) in UTC milliseconds for the first time phrase found, else None.

    Read word by word: "between D and D", "since D", "after D", "before D", "on D",
    "last/past N hours|days|weeks|months", "past week|month|year" (rolling),
    "this/last week|month|year" (calendar, weeks from Monday), "yesterday", "today",
    "in D"; D is a day, YYYY-MM, a year, or a month with or without year (then the
    latest that began). Forms are tried in this order. "Last N months" are 30 days each.
    """
    shift = tz_offset_min * 60_000
    now = now_ms + shift
    today = datetime.fromtimestamp(now / 1000, UTC).date()
    ms = lambda d: int(datetime(d.year, d.month, d.day, tzinfo=UTC).timestamp() * 1000)
    found = list(re.finditer(r"[^\s,.;:!?()\"']+", query))
    words = [m[0].lower() for m in found]

    def between(i):
        a = _span(words, i + 1, today)
        j = i + 1 + a[2] if a else 0
        b = _span(words, j + 1, today) if a and words[j : j + 1] == ["and"] else None
        return b and (min(ms(a[0]), ms(b[0])), max(ms(a[1]), ms(b[1])), 2 + a[2] + b[2])

    def dated(i, window):
        a = _span(words, i + 1, today)
        return a and (*window(ms(a[0]), ms(a[1])), 1 + a[2])

    def counted(i):
        n, unit = (words[i + 1 : i + 3] + ["", ""])[:2]
        unit = unit.removesuffix("s")
        return (now - int(n) * LENGTH[unit], now, 3) if n.isdigit() and len(n) <= 3 and unit in LENGTH and unit != "year" else None

    def period(i):
        unit = words[i + 1] if i + 1 < len(words) else ""
        if unit not in ("week", "month", "year"):
            return None
        if words[i] == "past":
            return now - LENGTH[unit], now, 2
        before, start = _calendar(unit, today)
        return (ms(start), now, 2) if words[i] == "this" else (ms(before), ms(start), 2)

    whole = lambda a, b: (a, b)
    forms = [
        (("between",), between),
        (("since", "after"), lambda i: dated(i, lambda a, b: (a, now))),
        (("before",), lambda i: dated(i, lambda a, b: (0, a))),
        (("on",), lambda i: dated(i, whole) if re.fullmatch(r"\d{4}-\d\d-\d\d", "".join(words[i + 1 : i + 2])) else None),
        (("last", "past"), counted),
        (("past", "this", "last"), period),
        (("yesterday",), lambda i: (ms(today - timedelta(days=1)), ms(today), 1)),
        (("today",), lambda i: (ms(today), now, 1)),
        (("in",), lambda i: dated(i, whole)),
    ]
    for heads, read in forms:
        for i, word in enumerate(words):
            hit = read(i) if word in heads else None
            if hit:
                rest = query[: found[i].start()] + " " + query[found[i + hit[2] - 1].end() :]
                return hit[0] - shift, hit[1] - shift, " ".join(rest.split())
    return None
