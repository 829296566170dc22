"""Contradictions: the literal cases of the semantics, and brute force over pairs."""

import pytest

from recollect.operators import claims as C

SCHEMA = "memory_id long, realm string, domain string, type string, subject string, predicate string, object string, key string"


def atoms(spark, rows):
    return C.atoms(spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA))


def pairs(spark, rows):
    return {(r["claim_a"], r["claim_b"]): r["score"] for r in C.contradictions(C.classes(atoms(spark, rows))).collect()}


def test_literal_cases(spark):
    ssh = (1, "brahman", "cluster", "OPERATIONAL", "chaos-nodes", "use-SSH-only-not-SLURM", None)
    slurm = (2, "brahman", "cluster", "cluster", "chaos-nodes", "use-SLURM-sbatch-not-SSH", None)
    other = (3, "brahman", "bgv", "GOTCHA", "mmap", "segment-fault-on-resize", None)
    got = {r["memory_id"]: r for r in atoms(spark, [ssh, slurm, other]).collect()}
    assert got[1]["subject"] == "chaos-nodes" and "ssh" in got[1]["predicate"] and got[1]["domain"] == "cluster"
    k = {r["subject"] + ">" + r["predicate"]: r for r in C.classes(atoms(spark, [ssh, slurm, other])).collect()}
    assert k["chaos-nodes>use-ssh-only-not-slurm"]["negative"] and not k["mmap>segment-fault-on-resize"]["negative"]
    assert pairs(spark, [ssh, other]) == {}  # unrelated
    # antonyms of one subject: 0.8 of 0.85 where keys differ, met through a third claim's key
    rows = [(1, "r", "d", "OPERATIONAL", "n", "use-ssh", None), (2, "r", "d", "OPERATIONAL", "n", "use-ssh-not-slurm", None), (3, "r", "d", "OPERATIONAL", "n", "use-slurm", None)]
    k = C.classes(atoms(spark, rows))
    direct = C.contradictions(k)
    assert {(r["claim_a"], r["claim_b"]): r["score"] for r in direct.collect()} == {("n>use-ssh-not-slurm>", "n>use-ssh>"): 1.0}
    hop = {(r["via"], r["claim_b"], r["claim_c"]): r["score"] for r in C.transitive(direct, k).collect()}
    assert hop == {("n>use-ssh-not-slurm>", "n>use-ssh>", "n>use-slurm>"): pytest.approx(0.85 * 0.8 * 0.85)}


@pytest.mark.parametrize("a,b,score", [("keep-x", "keep-x-not-y", 1.0), ("keep-x", "keep-x-only", None), ("must-keep", "must-keep", None)])
def test_same_key(spark, a, b, score):
    rows = [(1, "r", "d", "BELIEF", "s", a, None), (2, "r", "d", "BELIEF", "s", b, None)]
    assert list(pairs(spark, rows).values()) == ([score] if score else [])


def test_corrections_antonyms_and_short_forms(spark):
    rows = [(1, "r", "d", "CORRECTION", "s", "p", "a"), (2, "r", "d", "BELIEF", "s", "p", "b")]
    assert pairs(spark, rows) == {("correction s>p>a", "s>p>b"): 0.9}
    assert pairs(spark, rows + [(3, *rows[0][1:])])[("correction s>p>a", "correction s>p>a")] == 0.9  # two of one correction
    assert pairs(spark, [(1, "r", "d", "X", "s", "p", "allow-all"), (2, "r", "d", "X", "s", "p", "deny-all")]) == {("s>p>allow-all", "s>p>deny-all"): 0.85}
    assert pairs(spark, [(1, "r", "d", "X", "db_cfg", "p", "yes"), (2, "r", "d", "X", "database cfg", "p", "no")]) == {}
    assert pairs(spark, [(1, "r", "d", "X", "db_host", "p", "yes"), (2, "r", "d", "X", "database-host", "p", "no")]) == {("database-host>p>no", "db-host>p>yes"): 0.85}


@pytest.mark.parametrize("run", [2000, 2])
def test_no_link_between_different_claims_is_lost(spark, monkeypatch, run):
    monkeypatch.setattr(C, "RUN", run)
    said = ["keep-a", "keep-a-not-b", "keep-a-only", "keep-a-not-c"]
    rows = [(i, "r" if i % 3 else "q", "d", "X", "s", said[i % 4], ["yes", "no", None][i % 5 % 3]) for i in range(60)]
    got = [(r["realm"], r["claim_a"], r["claim_b"]) for r in C.contradictions(C.classes(atoms(spark, rows))).collect()]
    texts = sorted({(r[1], f"s>{r[5]}>{r[6] or ''}") for r in rows})
    negative = lambda t: "not-" in t
    opposed = lambda x, y: negative(x) != negative(y) or {x.split(">")[2], y.split(">")[2]} == {"yes", "no"}
    want = {(r, x, y) for r, x in texts for q, y in texts if r == q and x < y and opposed(x, y)}
    assert set(got) == want and len(got) == len(want) > 20
    assert C.members(atoms(spark, rows)).count() == 60


def test_resolutions(spark):
    rows = [(1, "r", "d", "X", "s", "p", "yes"), (2, "r", "d", "X", "s", "p", "no"), (3, "r", "d", "X", "s", "p", "no"), (4, "r", "e", "X", "s", "keep", None), (5, "r", "e", "X", "s", "keep-not", None)]
    a = atoms(spark, rows)
    memory = spark.createDataFrame([(1, 0.9), (2, 0.2), (3, 0.4), (4, 0.1), (5, 0.8)], "memory_id long, confidence double")
    weak = C.contradictions(C.classes(a)).withColumn("score", C.F.when(C.F.col("key").startswith("r:e"), 0.7).otherwise(C.F.col("score")))
    assert {r["loser"]: r["loser_confidence"] for r in C.resolutions(weak, C.members(a), memory).collect()} == {2: 0.05, 3: 0.05}
    assert pairs(spark, rows)  # keep and keep-not are of different keys


def test_odd_rows(spark):
    rows = [(None, "r", "d", "X", "s", "p", "o"), (1, None, "d", "X", "s", "p", "o"), (2, "r", "d", "X", None, "p", "o"), (3, "r", None, None, "s", None, None), (3, "r", None, None, "s", None, None)]
    assert [r["claim"] for r in atoms(spark, rows).collect()] == ["s>>"]
    assert pairs(spark, []) == {}


def test_prefix_conflicts(spark):
    text = "one two three four five six " + "and more words to be long enough " * 3
    rows = [(1, "r", text + "a", "wisdom"), (2, "r", text + "b", "insight"), (3, "r", text.upper() + "c", "correction"), (4, "r", text + "a", "wisdom"), (5, "r", "one two three four five six", "wisdom"), (6, None, text, "wisdom"), (7, "q", text, "wisdom")]
    out = C.prefix_conflicts(spark.createDataFrame(rows, "memory_id long, realm string, content string, kind string"))
    assert {(r["a"], r["b"]): r["score"] for r in out.collect()} == {(1, 2): 0.4, (1, 3): 0.6, (2, 3): 0.6}
    many = spark.range(300).selectExpr("id AS memory_id", "'r' AS realm", f"concat('{text}', id) AS content", "'wisdom' AS kind")
    assert [(r["a"], r["b"]) for r in C.prefix_conflicts(many).collect()] == [(0, b) for b in range(1, 51)]
