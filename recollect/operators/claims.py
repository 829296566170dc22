"""Contradictions between claims and between notes with one beginning.

Claims that say the same (one key, subject, predicate, object and standing) form a
class; what is scored and given are pairs of classes, and membership says which
memories make a claim. So a claim that a third of all memories repeat is one row
of a pair, and no link between different claims is lost. A class of several
members that contradicts itself (two corrections of one subject) is a pair too.

Defined results: claims without memory, realm or subject say nothing; a missing
domain is a domain of its own; repeated rows count once; an empty table gives no
rows; extra columns are dropped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.operators.graph import kind_class

#: Classes of a key met in one run; larger keys are cut into blocks that meet pairwise.
RUN = 2_000
LEAST, DISCOUNT, SOFT = 0.65, 0.85, 0.75
FIRST = 50

#: Words that oppose each other.
ANTONYMS = [
    ("ssh", "slurm"), ("ssh", "sbatch"), ("ssh", "srun"), ("direct", "queue"), ("yes", "no"), ("enable", "disable"), ("true", "false"),
    ("use", "avoid"), ("always", "never"), ("on", "off"), ("include", "exclude"), ("add", "remove"), ("allow", "deny"), ("local", "remote"),
]
#: Abbreviations written out in keys; the first two also where a term begins, the first where it ends.
SHORT = {"db": "database", "cfg": "config", "env": "environment", "dir": "directory", "auth": "authentication", "repo": "repository", "pkg": "package", "msg": "message", "err": "error", "idx": "index"}
#: Signs of a negative claim, and of what it demands, first match first.
NEGATIVE = ["not-", "avoid-", "never-", "!use"]
MODALITY = [("must", ["must-", "always-", "-only"]), ("should", ["should-"]), ("preference", ["prefer"]), ("cannot", ["cannot-", "never-"])]


def canonical(text: Column) -> Column:
    """Lower case, underscores as hyphens, letters, digits and ``-!>|`` only; '' for null."""
    kept = F.regexp_replace(F.replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), F.lit("_"), F.lit("-")), r"[^\p{L}\p{N}\-!>|]", "")
    return F.regexp_replace(kept, r"^-+|-+$", "")


def root(term: Column) -> Column:
    """A term without its negation or restriction: what opposed claims have in common."""
    return F.when(F.contains(term, F.lit("-not-")), F.regexp_extract(term, r"^(.*?)-not-", 1)).otherwise(F.regexp_replace(term, r"-only.*$", ""))


def spelled_out(term: Column) -> Column:
    """Words of a term parted by one blank, known abbreviations in full."""
    out = F.trim(F.regexp_replace(F.lower(term), r"[-_./\s]+", " "))
    for short, full in SHORT.items():
        out = F.replace(out, F.lit(f" {short} "), F.lit(f" {full} "))
    out = F.regexp_replace(F.regexp_replace(out, "^db ", "database "), "^cfg ", "config ")
    return F.regexp_replace(out, " db$", " database")


def _any(text: Column, signs: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(s)) for s in signs])


def _words(term: Column, side: int) -> Column:
    """Bit i: the term holds the word on this side of antonym pair i."""
    parts = F.split(term, r"[^\p{L}\p{N}]+")
    return reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.array_contains(parts, pair[side]), F.lit(1 << i)).otherwise(F.lit(0)) for i, pair in enumerate(ANTONYMS)])


def atoms(claims: DataFrame) -> DataFrame:
    """(memory_id, realm, domain, correction, subject, predicate, object, key, claim) of claims (.., type, ..)."""
    rows = claims.select("memory_id", "realm", F.lower(F.trim("domain")).alias("domain"), F.coalesce(F.col("type") == "CORRECTION", F.lit(False)).alias("correction"), *[canonical(F.col(c)).alias(c) for c in ("subject", "predicate", "object")])
    rows = rows.where(F.col("memory_id").isNotNull() & F.col("realm").isNotNull() & (F.col("subject") != ""))
    key = F.concat_ws(":", "realm", F.coalesce("domain", F.lit("")), spelled_out(root(F.col("subject"))), spelled_out(root(F.col("predicate"))))
    said = F.concat(F.when(F.col("correction"), F.lit("correction ")).otherwise(F.lit("")), F.concat_ws(">", "subject", "predicate", "object"))
    return rows.select("*", key.alias("key"), said.alias("claim")).distinct()


def members(atoms_: DataFrame) -> DataFrame:
    """(realm, key, claim, memory_id): which memories make a claim."""
    return atoms_.select("realm", "key", "claim", "memory_id").distinct()


def classes(atoms_: DataFrame) -> DataFrame:
    """One row per (realm, key, claim) with its number of memories and what the scoring needs; pre-aggregated map-side."""
    names = ["domain", "correction", "subject", "predicate", "object"]
    one = atoms_.groupBy("realm", "key", "claim").agg(F.first(F.struct(*names)).alias("s"), F.count(F.lit(1)).alias("n")).select("realm", "key", "claim", "n", *[f"s.{c}" for c in names])
    whole, some = F.concat_ws(" ", "subject", "predicate", "object"), F.concat_ws(" ", "subject", "predicate")
    modality = F.lit("fact")
    for name, signs in reversed(MODALITY):
        modality = F.when(_any(some, signs), F.lit(name)).otherwise(modality)
    masks = {f"{c[0]}{s}": _words(F.col(c), s) for c in ("predicate", "object") for s in (0, 1)}
    return one.withColumns({"negative": F.startswith("subject", F.lit("!")) | _any(whole, NEGATIVE), "modality": modality, "root": root(F.col("predicate")), "denies": F.contains("predicate", F.lit("not-")), **masks})


def _score() -> Column:
    """Score of the classes with suffixes _a and _b: whether they speak of the same, times how far they oppose."""
    a, b = (lambda s: lambda c: F.col(f"{c}_{s}"))("a"), (lambda s: lambda c: F.col(f"{c}_{s}"))("b")
    meet = lambda x, y: (a(f"{x}0").bitwiseAND(b(f"{y}1")) != 0) | (a(f"{x}1").bitwiseAND(b(f"{y}0")) != 0)
    one_key, one_subject, one_root = a("key") == b("key"), a("subject") == b("subject"), a("root") == b("root")
    alike = ((a("predicate") == b("predicate")) & (a("predicate") != "")) | meet("p", "p") | one_root
    same = F.when(one_key, 1.0).when(one_subject & alike, 0.8).when(one_subject, 0.6).otherwise(0.0)
    some = a("predicate") != ""
    parts = [
        F.when(one_key & (a("negative") != b("negative")), 1.0),
        F.when((a("correction") & F.contains(b("subject"), a("subject"))) | (b("correction") & F.contains(a("subject"), b("subject"))), 0.9),
        F.when(meet("p", "p") | meet("o", "o") | meet("p", "o") | meet("o", "p"), 0.85),
        F.when((a("predicate") == b("predicate")) & some & F.array_contains(F.array(F.lit("must cannot"), F.lit("cannot must")), F.concat_ws(" ", a("modality"), b("modality"))), 0.8),
        F.when(one_root & some & (a("denies") != b("denies")), 0.7),
    ]
    return same * F.greatest(*[F.coalesce(p, F.lit(0.0)) for p in parts])


def contradictions(classes_: DataFrame, least: float = LEAST) -> DataFrame:
    """(realm, key, claim_a, claim_b, score) of the contradicting classes of a key, claim_a <= claim_b.

    Keys above ``RUN`` classes are cut into blocks by hash and every two blocks
    meet in a key of their own, so no hot key is one task's work.
    """
    sized = classes_.groupBy("realm", "key").agg(F.ceil(F.count(F.lit(1)) / RUN).cast("int").alias("_n"))
    cut = classes_.join(sized, ["realm", "key"]).withColumn("_own", F.pmod(F.xxhash64("claim"), F.col("_n")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
    side = lambda df, s: df.select("realm", "_k", "_p", "_q", *[F.col(c).alias(f"{c}_{s}") for c in classes_.columns if c != "realm"])
    x = side(cut.withColumns({"_k": F.col("key"), "_p": F.col("_own")}).withColumn("_q", every), "a")
    y = side(cut.withColumns({"_k": F.col("key"), "_q": F.col("_own")}).withColumn("_p", every), "b")
    met = x.join(y, ["realm", "_k", "_p", "_q"]).where((F.col("claim_a") < F.col("claim_b")) | ((F.col("claim_a") == F.col("claim_b")) & (F.col("n_a") > 1)))
    return met.select("realm", F.col("_k").alias("key"), "claim_a", "claim_b", _score().alias("score")).where(F.col("score") >= least)


def transitive(direct: DataFrame, classes_: DataFrame, least: float = LEAST) -> DataFrame:
    """(realm, via, claim_b, claim_c, score): A contradicts B, and C shares A's root and B's domain and contradicts B: 0.85 of that score.

    C has B's key or subject, or else it could not score; the join is by those.
    """
    sides = direct.select("realm", "key", F.col("claim_a").alias("via"), F.col("claim_b").alias("claim"))
    known = classes_.withColumn("_root", root(F.col("subject")))
    of_a = known.select("realm", F.col("key"), F.col("claim").alias("via"), F.col("_root").alias("_ra"))
    b = sides.join(of_a, ["realm", "key", "via"]).join(classes_, ["realm", "key", "claim"])
    b = b.select("realm", "via", "_ra", *[F.col(c).alias(f"{c}_a") for c in classes_.columns if c != "realm"])
    c = known.select("realm", F.col("_root").alias("_rc"), *[F.col(x).alias(f"{x}_b") for x in classes_.columns if x != "realm"])
    ways = []
    for by in ("key", "subject"):
        ways.append(b.withColumn("_k", F.col(f"{by}_a")).join(c.withColumn("_k", F.col(f"{by}_b")), ["realm", "_k"]))
    met = ways[0].unionByName(ways[1].where("key_a <> key_b"))
    apart = (F.col("claim_b") != F.col("via")) & ((F.col("claim_b") != F.col("claim_a")) | (F.col("key_a") != F.col("key_b")))
    met = met.where((F.col("_ra") == F.col("_rc")) & F.col("domain_a").eqNullSafe(F.col("domain_b")) & apart).withColumn("s", _score()).where(F.col("s") >= least)
    return met.groupBy("realm", "via", F.col("claim_a").alias("claim_b"), F.col("claim_b").alias("claim_c")).agg((DISCOUNT * F.max("s")).alias("score"))


def resolutions(pairs: DataFrame, members_: DataFrame, memory: DataFrame) -> DataFrame:
    """(loser, loser_confidence): the class with the more confident memory wins (ties: the first claim).

    A memory that loses falls to 0.05, or 0.3 where no contradiction it loses
    reaches 0.75. One row per losing memory.
    """
    held = members_.join(memory.select("memory_id", "confidence"), "memory_id")
    best = held.groupBy("realm", "key", "claim").agg(F.max("confidence").alias("c"))
    both = pairs.where("claim_a < claim_b").join(best.toDF("realm", "key", "claim_a", "ca"), ["realm", "key", "claim_a"]).join(best.toDF("realm", "key", "claim_b", "cb"), ["realm", "key", "claim_b"])
    lost = both.groupBy("realm", "key", F.when(F.col("ca") >= F.col("cb"), F.col("claim_b")).otherwise(F.col("claim_a")).alias("claim")).agg(F.max("score").alias("score"))
    worst = members_.join(lost, ["realm", "key", "claim"]).groupBy(F.col("memory_id").alias("loser")).agg(F.max("score").alias("score"))
    return worst.select("loser", F.when(F.col("score") < SOFT, 0.3).otherwise(0.05).alias("loser_confidence"))


def prefix_conflicts(memory: DataFrame, words: int = 6, most: int = FIRST) -> DataFrame:
    """The first ``most`` pairs, by id, of notes of a realm with the same first words.

    0.6 where the classes of their kinds differ, 0.4 where only the contents do.
    The beginning is the first 80 characters (shorter notes have none) and must
    give ten characters at least. Copies stand for one another; of the different
    notes of one beginning only the first ``most`` + 1 can be in the result, as
    each two of them conflict, so no more of a group meet.
    """
    begin = F.array_join(F.slice(F.split(F.lower(F.trim(F.substring("content", 1, 80))), r"\s+"), 1, words), " ")
    rows = memory.where(F.col("realm").isNotNull() & (F.length("content") >= 80)).select("memory_id", "realm", begin.alias("begin"), kind_class(F.col("kind"), F.lit("")).alias("class"), F.sha2("content", 256).alias("content"))
    rows = rows.where(F.length("begin") >= 10).groupBy("realm", "begin", "class", "content").agg(F.min("memory_id").alias("memory_id"))
    place = F.row_number().over(Window.partitionBy("realm", "begin").orderBy("memory_id"))
    rows = rows.withColumn("_r", place).where(F.col("_r") <= most + 1).drop("_r")
    x, y = rows.toDF("realm", "begin", "class_a", "content_a", "a"), rows.toDF("realm", "begin", "class_b", "content_b", "b")
    met = x.join(y, ["realm", "begin"]).where("a < b AND (class_a <> class_b OR content_a <> content_b)")
    return met.select("a", "b", F.when(F.col("class_a") != F.col("class_b"), 0.6).otherwise(0.4).alias("score")).orderBy("a", "b").limit(most)
