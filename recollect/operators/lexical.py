"""Lexical retrieval: postings, BM25, span search (C1-C19), and parsing of keyed records."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K1, B, MAX_TERMS, COMMON = 1.2, 0.75, 4, 0.20
#: The stop words of the index.
STOP = "the a an is are was be to of and in it for on with as at by or not this that from have has had but its my your we i he she they do did will can would could should".split()


def tokenize(text: Column) -> Column:
    """Runs of letters and digits in lower case, two bytes at least, without stop words."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.coalesce(F.filter(words, lambda w: (F.octet_length(w) >= 2) & ~w.isin(STOP)), F.array().cast("array<string>"))


def query_tokens(query: str) -> list[str]:
    """Tokens of a query, first occurrences in order."""
    words = [w for w in re.split(r"[^\w]|_", query.lower()) if len(w.encode()) >= 2 and w not in STOP]
    return list(dict.fromkeys(words))


def postings(memory: DataFrame) -> DataFrame:
    """(memory_id, term, tf, length) of every live document; length counts repeats."""
    tokens = memory.select("memory_id", tokenize(F.col("content")).alias("t")).where(F.size("t") > 0)
    return tokens.select("memory_id", F.size("t").alias("length"), F.explode("t").alias("term")).groupBy("memory_id", "term", "length").agg(F.count(F.lit(1)).alias("tf"))


def remove(posts: DataFrame, deleted: DataFrame) -> DataFrame:
    """Postings without those of deleted documents."""
    return posts.join(deleted.select("memory_id"), "memory_id", "left_anti")


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1.0)


def term_stats(memory: DataFrame, terms: list[str]) -> DataFrame:
    """(term, df, n, avg_length, idf) of the given terms in one pass over the documents."""
    docs = memory.select(tokenize(F.col("content")).alias("t"))  # no filter on t: pushed down, it would tokenize twice
    hits = [F.count_if(F.array_contains("t", w)).alias(f"_{i}") for i, w in enumerate(terms)]
    row = docs.agg(F.count_if(F.size("t") > 0).alias("n"), F.avg(F.nullif(F.size("t"), F.lit(0))).alias("avg_length"), *hits)
    pairs = F.explode(F.array(*[F.struct(F.lit(w).alias("term"), F.coalesce(F.col(f"_{i}"), F.lit(0)).alias("df")) for i, w in enumerate(terms)])).alias("p")
    out = row.select("n", "avg_length", pairs).select("p.term", "p.df", "n", "avg_length")
    return out.where(F.col("df") > 0).withColumn("idf", idf(F.col("n"), F.col("df")))


def select_terms(stats: DataFrame) -> DataFrame:
    """C4: rarest terms first; common ones go unless nothing is rarer; four at most (ties by term)."""
    rare = F.min("df").over(Window.partitionBy())
    kept = stats.withColumn("_min", rare).where((F.col("_min") >= F.col("n")) | (F.col("df") == F.col("_min")) | (F.col("df") / F.col("n") <= COMMON))
    return kept.orderBy("df", "term").limit(MAX_TERMS).drop("_min")


def max_query_idf(stats: DataFrame) -> DataFrame:
    """Greatest idf of the query's terms, 0 if none occurs."""
    return stats.agg(F.coalesce(F.max("idf"), F.lit(0.0)).alias("max_idf"))


def _count(tokens: str, term: str) -> Column:
    return F.size(F.filter(tokens, lambda w: w == F.lit(term)))


def _labelled(text: Column, label: str, pattern: str, kind: str, value: str) -> Column:
    """All matches of a pattern as structs of a label and the match."""
    return F.transform(F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.array().cast("array<string>")), lambda t: F.struct(F.lit(label).alias(kind), F.trim(t).alias(value)))


def bm25(memory: DataFrame, query: str, k: int | None) -> DataFrame:
    """(memory_id, bm25), best first, ties to the smaller id.

    The query's few terms are bound into the scan as an expression: one pass for
    their statistics, one for the scores, in which only texts that hold a term
    are tokenized; no posting list and no shuffle but the final top-k.
    """
    chosen = select_terms(term_stats(memory, query_tokens(query))).collect() if query_tokens(query) else []  # four rows at most
    low, holds = F.lower("content"), F.lit(False)
    for r in chosen:
        holds = holds | F.contains(low, F.lit(r["term"]))
    tokens = memory.where(holds).select("memory_id", tokenize(F.col("content")).alias("t"))
    score: Column = F.lit(0.0)
    for r in chosen:
        tf = _count("t", r["term"]).cast("double")
        score = score + F.when(tf > 0, F.lit(float(r["idf"])) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.size("t") / F.lit(float(r["avg_length"]))))).otherwise(0.0)
    hits = tokens.select("memory_id", score.alias("bm25"))
    best = hits if k is None else hits.orderBy(F.col("bm25").desc(), "memory_id").limit(k)
    return best.where(F.col("bm25") > 0)


#: Prefixes that mark a signature line.
SIGNATURES = ["pub fn", "fn ", "pub struct", "struct ", "pub enum", "enum ", "impl ", "trait ", "pub trait", "class ", "def ", "async def", "function ", "export ", "interface ", "type ", "const ", "static ", "mod "]


def signature_text(content: Column, level: str = "signatures") -> Column:
    """The part of a text that is indexed: all of it, or only its signature lines."""
    if level == "none":
        return content
    lines = F.split(content, "\n")
    head = F.lit(r"^\s*(" + "|".join(re.escape(s) for s in SIGNATURES) + ")")
    return F.array_join(F.filter(lines, lambda line: F.rlike(line, head)), "\n")


PATHS = r"(?:^|[\s(\"'=])((?:/|[A-Za-z0-9_.-]+/)[A-Za-z0-9_./-]*\.[A-Za-z0-9]{1,8})"


def identity_atoms(text: Column) -> Column:
    """File paths named in a text, distinct and sorted."""
    return F.array_sort(F.array_distinct(F.coalesce(F.regexp_extract_all(text, F.lit(PATHS), F.lit(1)), F.array().cast("array<string>"))))


def spans(memory: DataFrame) -> DataFrame:
    """(class, text) spans with counts, first and last time, and the number of memories and realms."""
    kinds = {"path": PATHS, "name": r"\b([a-z]+_[a-z0-9_]+)\b", "hex": r"\b(0x[0-9a-f]{4,})\b"}
    found = F.flatten(F.array(*[_labelled(F.col("content"), c, p, "class", "text") for c, p in kinds.items()]))
    rows = memory.select("memory_id", "realm", "created_ms", F.explode(found).alias("s")).select("memory_id", "realm", "created_ms", "s.class", "s.text")
    return rows.groupBy("class", "text").agg(
        F.count(F.lit(1)).alias("n"), F.min("created_ms").alias("first_ms"), F.max("created_ms").alias("last_ms"), F.approx_count_distinct("memory_id").alias("memories"), F.array_sort(F.collect_set("realm")).alias("realms")
    )


def span_refs(memory: DataFrame) -> DataFrame:
    """(memory_id, path) for every path named in a memory."""
    return memory.select("memory_id", F.explode(identity_atoms(F.col("content"))).alias("text"))


def span_unlink(refs: DataFrame, deleted: DataFrame) -> DataFrame:
    """C17: references left, and with them only spans still referred to."""
    return refs.join(deleted.select("memory_id"), "memory_id", "left_anti")


def span_histogram(span: DataFrame) -> DataFrame:
    """Per class rows, singletons and bytes."""
    return span.groupBy("class").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("n") == 1).alias("singletons"), F.sum(F.octet_length("text")).alias("bytes"))


def span_query(span: DataFrame, query: str, now_ms: int, k: int, realm: str | None = None) -> DataFrame:
    """Spans that hold words of the query, by match, frequency, recency and realm.

    The words are constants of the scan, so no index of trigrams is needed.
    """
    words = [w for w in re.split(r"\s+", query.lower()) if w]
    low = F.lower("text")
    part: Column = F.lit(0.0)
    for w in words:
        part = part + F.when(F.contains(low, F.lit(w)), F.lit(1.0)).otherwise(0.0)
    cover = part / max(len(words), 1)
    exact = F.when(low == query.lower(), 2.0).otherwise(1.0)
    freq = 1.0 + F.log1p("n") / 10.0
    age = F.greatest(F.lit(now_ms) - F.col("last_ms"), F.lit(0)) / 86_400_000.0
    recent = 1.0 / (1.0 + age / 365.0)
    home = F.when(F.array_contains("realms", realm), 1.1).otherwise(1.0) if realm else F.lit(1.0)
    return span.where(part > 0).withColumn("score", cover * exact * freq * (0.5 + 0.5 * recent) * home).orderBy(F.col("score").desc(), "class", "text").limit(k)


def provenance_keys(content: Column) -> Column:
    """``sha:`` and ``input:`` keys of a ``[done]`` record, in lower case."""
    found = F.regexp_extract_all(F.lower(content), F.lit(r"(?:^|\s)((?:sha|input):[^\s;,]+)"), F.lit(1))
    return F.when(F.startswith(F.lower(F.ltrim(content)), F.lit("[done]")), found).otherwise(F.array().cast("array<string>"))


def provenance_lookup(memory: DataFrame) -> DataFrame:
    """Per key the earliest live record."""
    keys = memory.select("memory_id", "created_ms", F.explode(provenance_keys(F.col("content"))).alias("key"))
    return keys.groupBy("key").agg(F.min_by("memory_id", F.struct("created_ms", "memory_id")).alias("memory_id"), F.count(F.lit(1)).alias("n"))


def correction_keys(content: Column) -> Column:
    """Bigrams of what a correction says is wrong: the part after NOT: or WRONG:, else its body."""
    low = F.lower(content)
    wrong = F.regexp_extract(low, r"(?:not|wrong):\s*([^\n]*)", 1)
    body = F.when(wrong != "", wrong).otherwise(F.regexp_replace(low, r"^\s*\[correction\]", ""))
    w = F.filter(F.split(body, r"[^\p{L}\p{N}]+"), lambda t: t != "")
    pairs = F.zip_with(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(F.startswith(F.ltrim(low), F.lit("[correction]")), F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def correction_check(memory: DataFrame, text: str, least: int = 2, newest: int = 3) -> DataFrame:
    """Corrections of which at least two bigrams recur in a text, newest first."""
    words = [w for w in re.split(r"[^\w]|_", text.lower()) if w]
    given = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
    hits = F.size(F.array_intersect(correction_keys(F.col("content")), F.lit(given) if given else F.array().cast("array<string>")))
    return memory.withColumn("hits", hits).where(F.col("hits") >= least).orderBy(F.col("created_ms").desc(), F.col("memory_id").desc()).limit(newest).select("memory_id", "hits")


def task_key(content: Column) -> Column:
    """Slug of a ``[task]`` record, null for others; other signs than letters and digits become dashes."""
    slug = F.regexp_extract(F.lower(content), r"^\s*\[task\].*?(?:id|task):([^\s]+)", 1)
    return F.nullif(F.regexp_replace(F.regexp_replace(slug, r"[^\p{L}\p{N}]+", "-"), r"^-+|-+$", ""), F.lit(""))


def task_state(memory: DataFrame) -> DataFrame:
    """Latest live record per slug."""
    rows = memory.withColumn("slug", task_key(F.col("content"))).where(F.col("slug").isNotNull())
    return rows.groupBy("slug").agg(F.max_by("memory_id", F.struct("created_ms", "memory_id")).alias("memory_id"), F.count(F.lit(1)).alias("n"))


#: First-person patterns and the predicate they state.
FIRST_PERSON = {"prefers": r"\bi (?:prefer|like) ([^.,;\n]+)", "uses": r"\bi (?:use|am using) ([^.,;\n]+)", "works_on": r"\bi(?:'m| am) working on ([^.,;\n]+)", "lives_in": r"\bi live in ([^.,;\n]+)", "dislikes": r"\bi (?:hate|dislike|don't like) ([^.,;\n]+)", "asked": r"\buser asked ([^.,;\n]+)"}


def first_person(memory: DataFrame) -> DataFrame:
    """C20: (memory_id, predicate, object, negative) stated in a text, patterns evaluated in the scan."""
    low = F.lower("content")
    found = F.flatten(F.array(*[_labelled(low, n, p, "predicate", "object") for n, p in FIRST_PERSON.items()]))
    rows = memory.select("memory_id", F.explode(found).alias("f")).select("memory_id", "f.predicate", "f.object")
    return rows.withColumn("negative", F.col("predicate") == "dislikes")


def seeds(query: Column) -> Column:
    """@tags, quoted strings and capitalised words after the first, distinct in that order."""
    tags = F.regexp_extract_all(query, F.lit(r"@([\p{L}\p{N}_-]+)"), F.lit(1))
    quoted = F.regexp_extract_all(query, F.lit(r'"([^"]+)"'), F.lit(1))
    caps = F.regexp_extract_all(query, F.lit(r"\s(\p{Lu}[\p{L}\p{N}]+)"), F.lit(1))
    return F.array_distinct(F.concat(tags, quoted, caps))


def claims(memory: DataFrame) -> DataFrame:
    """(memory_id, type, domain, subject, predicate, object) of lines ``[TYPE] [domain] a->b->c``."""
    line = F.explode(F.split("content", "\n")).alias("line")
    pattern = r"^\[([^\]]+)\] \[([^\]]+)\] (.*?)(?:->(.*?))?(?:->(.*?))?(?: F:[A-Z]+)?$"
    rows = memory.select("memory_id", line).where(F.rlike("line", F.lit(r"^\[[^\]]+\] \[[^\]]+\] ")))
    part = lambda i: F.trim(F.regexp_extract("line", pattern, i))
    return rows.select("memory_id", part(1).alias("type"), part(2).alias("domain"), part(3).alias("subject"), part(4).alias("predicate"), part(5).alias("object"))


def lite_train(examples: DataFrame, least: int = 2) -> DataFrame:
    """(term, feature, weight, idf) learned from (example, text, feature, activation) rows.

    Two aggregations: document frequencies, and mean activation per (term, feature).
    """
    words = examples.select("example", "feature", "activation", F.explode(F.array_distinct(tokenize(F.col("text")))).alias("term"))
    n = examples.select("example").distinct().count()
    df = words.groupBy("term").agg(F.count_distinct("example").alias("df")).where(F.col("df") >= least)
    weight = words.groupBy("term", "feature").agg(F.sum("activation").alias("s"))
    return weight.join(df, "term").select("term", "feature", (F.col("s") / F.col("df")).alias("weight"), F.log(F.lit(float(n)) / F.col("df")).alias("idf"))


def lite_encode(texts: DataFrame, model: DataFrame, top: int = 8) -> DataFrame:
    """(id, feature, value) of the ``top`` features of each text by summed tf-idf weight."""
    tf = texts.select("id", F.explode(tokenize(F.col("text"))).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
    value = tf.join(model, "term").groupBy("id", "feature").agg(F.sum(F.col("tf") * F.col("idf") * F.col("weight")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.col("value").desc(), "feature"))
    return value.withColumn("rank", rank).where(F.col("rank") <= top)
