"""Subject areas of documents, by class-association rules from parallel frequent-pattern growth (problem 10).

A text is cut into segments (sentences, lines, list items, 64 words at most). A
term counts once a document, in the segment where it first occurs; the terms that
do so in one segment, with the document's area, are a transaction. Frequent
patterns with one area give rules "terms -> area". A rule says how much likelier
the area is among documents with these terms than among all documents of the
language, by the lower Wilson bound of its confidence, so words every text of a
language uses and chance meetings of rare words carry nothing.

The growth is the parallel one: terms are counted in the map tasks; the frequent
ones that an area attracts are listed by frequency and dealt into ``SHARDS``
groups; every map task sends each group the part of its transactions up to the
group's last term; each group is one frequent-pattern tree with a count per area
in its nodes, and is grown by conditional trees, without a bound on the length.

A pattern is a rule of an area if it is frequent there, ``LIFT`` times likelier
than without its terms, and says ``RAISE`` times as much as any shorter rule
within it; beyond two terms, all its parts must be rules of the area themselves.
So the growth goes on only where a term adds something, and phrases that
documents share in many variants don't multiply. A term that alone is so sure of
its areas that no pattern with it could say more takes no part, which loses no rule.

The evidence of a segment for an area is the sum over its matching rules. A
calibration on labelled documents that took no part in the mining gives, for each
bin of evidence, the probability that the best area is right (monotone, by
pooling), and a segment counts for its best area where that is even or better. A
document gets each area that makes up ``SHARE`` of its words or more. Talk about
the store itself matches no rule and only adds words.

The fit takes two rounds. The first learns from at most ``MAX_LABELLED`` labelled
documents (the first by hash of id); every fifth of them is kept for calibration.
Its rules name all documents with one clear area, and the second round counts
over all of those, labelled ones under their labels. Terms and rules are not
capped: a term must occur in a ``SUPPORT`` part of the documents, so there are at
most 2000 times as many as the mean document has distinct terms, whatever the
number of documents.

Defined results: null, empty and blank texts, and texts without words of three
letters, get no area; labels of unknown documents, null areas and repeated labels
are ignored; documents labelled with several areas are not used for the fit;
without labels nothing gets an area; a repeated document gives its rows again;
extra columns are dropped. Text without blanks between words counts each unbroken
run of letters as one word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.storage import materialize

MAX_LABELLED = 20_000
LEAST_COUNT, SUPPORT = 3, 1 / 2000
#: How much likelier an area must be than among all documents, and than by any shorter rule.
LIFT, RAISE = 1.5, 1.1
#: Groups of the frequent list, each with a tree of its own.
SHARDS = 1024
#: A fifth, less the error of measuring a text by its words of three letters or more.
SHARE = 0.19
#: Share from which an area names a document for the second round.
CLEAR = 0.35
#: Words of a segment; longer ones are cut.
WIDTH = 64
#: One labelled document in this many only calibrates.
HELD = 5
BINS, PER_UNIT = 24, 4


def segments(text: Column) -> Column:
    """Segments of a text, each as its words of three letters or more; segments without such words are dropped."""
    plain = F.regexp_replace(F.lower(F.translate(text, "\u00a0", " ")), r"[\u200b-\u200d\ufeff\p{M}]", "")
    parts = F.split(plain, r"[\n;.!?\u2026\u3002\uff01\uff1f\uff1b\u061f\u06d4\u0964]+|\\n")
    found = F.transform(parts, lambda s: F.regexp_extract_all(s, F.lit(r"\p{L}{3,}"), F.lit(0)))
    starts = lambda w: F.sequence(F.lit(0), F.floor((F.size(w) - 1) / WIDTH).cast("int"))
    short = F.filter(found, lambda w: F.size(w) > 0)
    cut = F.transform(short, lambda w: F.when(F.size(w) <= WIDTH, F.array(w)).otherwise(F.transform(starts(w), lambda i: F.slice(w, i * WIDTH + 1, WIDTH))))
    return F.coalesce(F.flatten(cut), F.array().cast("array<array<string>>"))


def prepared(docs: DataFrame, labels: DataFrame | None = None, most: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, lang, area, held, segments) of every document, cut once and kept; ``area`` is its label, if it has one area.

    The labelled documents used are at most ``most``, so they travel to the texts.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.lower(F.trim("lang")), F.lit("")).alias("lang"), segments(F.col("text")).alias("segments"))
    if labels is None:
        return rows
    area = F.lower(F.trim("area"))
    one = labels.where(F.col("doc_id").isNotNull() & (F.length(area) > 0)).groupBy("doc_id").agg(F.min(area).alias("area"), F.max(area).alias("_other"))
    one = one.where(F.col("area") == F.col("_other")).select(F.col("doc_id").cast("long").alias("doc_id"), "area").orderBy(F.xxhash64("doc_id")).limit(most)
    held = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(HELD)) == 0
    return materialize(rows.join(F.broadcast(one), "doc_id", "left").select("doc_id", "lang", "area", held.alias("held"), "segments"), "segments")


class Rules:
    """Rules as arrays, ready for the scoring map.

    ``longer`` has (keys, weights) for each length from two terms on. A key is the
    place of the rule's beginning among the rules one shorter (for two terms, the
    first term), times the number of terms, plus its last term; keys ascend.
    """

    def __init__(self, areas: list[str], terms: list[str], weights: np.ndarray, longer: list[tuple[np.ndarray, np.ndarray]]):
        self.areas, self.terms, self.weights, self.longer = areas, terms, weights, longer
        self.chance = np.zeros(BINS)

    def evidence(self, term_lists: pa.ListArray) -> np.ndarray:
        """(segments, areas) sums of the weights of all matching rules."""
        offsets = term_lists.offsets.to_numpy().astype(np.int64)
        values = term_lists.values.slice(offsets[0], offsets[-1] - offsets[0])
        n = len(term_lists)
        out = np.zeros((n, len(self.areas)))
        if not len(self.terms) or not len(values):
            return out
        at = pc.fill_null(pc.index_in(values, value_set=pa.array(self.terms)), -1).to_numpy().astype(np.int64)
        segment = np.repeat(np.arange(n), np.diff(offsets))
        hit = at >= 0
        key = np.unique(segment[hit] * len(self.terms) + at[hit])
        segment, at = key // len(self.terms), key % len(self.terms)
        for a in range(len(self.areas)):
            out[:, a] = np.bincount(segment, self.weights[at, a], n)
        last, rule = np.arange(len(key)), at
        for keys, weights in self.longer:
            lasts, rules = [], []
            d = 1
            while d < len(key):
                ok = last + d < len(key)
                ok[ok] = segment[last[ok] + d] == segment[last[ok]]
                last, rule = last[ok], rule[ok]  # those with no term left in their segment have none at a greater distance
                if not len(last):
                    break
                both = rule * len(self.terms) + at[last + d]
                where = np.minimum(np.searchsorted(keys, both), len(keys) - 1)
                hit = keys[where] == both
                np.add.at(out, segment[last[hit]], weights[where[hit]])
                lasts.append(last[hit] + d)
                rules.append(where[hit])
                d += 1
            if not lasts:
                break
            last, rule = np.concatenate(lasts), np.concatenate(rules)
        return out


def _least_confidence(k, n, z: float = 1.645):
    """Lower Wilson bound of k of n, numbers or arrays: what a rule promises at the least."""
    p = k / n
    return (p + z * z / (2 * n) - z * np.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


class _Batch:
    """One Arrow batch of documents: which term first occurs where."""

    def __init__(self, batch: pa.RecordBatch):
        docs = batch.column("segments")
        outer = docs.offsets.to_numpy().astype(np.int64)
        inner = docs.values.slice(outer[0], outer[-1] - outer[0])
        offsets = inner.offsets.to_numpy().astype(np.int64)
        self.words = inner.values.slice(offsets[0], offsets[-1] - offsets[0]) if len(inner) else pa.array([], type=pa.string())
        self.segment = np.repeat(np.arange(len(inner)), np.diff(offsets)) if len(inner) else np.zeros(0, dtype=np.int64)
        self.doc = np.repeat(np.arange(batch.num_rows), np.diff(outer))

    def first(self, codes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(segment, code) of the first occurrence of each code in each document; codes below 0 are left out."""
        at = np.nonzero(codes >= 0)[0]
        _, first = np.unique(self.doc[self.segment[at]] * width + codes[at], return_index=True)
        at = at[first]
        return self.segment[at], codes[at]


def _count_terms(batches):
    """Documents with an area -> (term, lang, area, n): documents of the batch that hold the term."""
    for batch in batches:
        b = _Batch(batch)
        if not len(b.words):
            continue
        coded = pc.dictionary_encode(b.words)
        names = coded.dictionary
        seg, term = b.first(coded.indices.to_numpy().astype(np.int64), len(names))
        lang, area = (pc.dictionary_encode(batch.column(c)) for c in ("lang", "area"))
        group = lang.indices.to_numpy().astype(np.int64) * len(area.dictionary) + area.indices.to_numpy()
        key, n = np.unique(group[b.doc[seg]] * len(names) + term, return_counts=True)
        of, term = key // len(names), key % len(names)
        yield pa.RecordBatch.from_arrays([names.take(pa.array(term)), lang.dictionary.take(pa.array(of // len(area.dictionary))), area.dictionary.take(pa.array(of % len(area.dictionary))), pa.array(n)], names=["term", "lang", "area", "n"])


def _shards(listed: list[str], areas: list[str]):
    """Documents with an area -> (shard, items, area, n): transactions up to the last term of each group, as places in the frequent list.

    Items are big-endian, so that their bytes sort as the paths of a tree; equal
    transactions of a batch are one row.
    """
    known, names = pa.array(listed), pa.array(areas)

    def run(batches):
        for batch in batches:
            b = _Batch(batch)
            if not len(b.words):
                continue
            codes = pc.fill_null(pc.index_in(b.words, value_set=known), -1).to_numpy().astype(np.int64)
            seg, item = b.first(codes, len(listed))
            order = np.lexsort((item, seg))
            seg, item = seg[order], item[order]
            at = np.arange(len(seg))
            begin = np.searchsorted(seg, seg)
            _, back = np.unique((seg * SHARDS + item % SHARDS)[::-1], return_index=True)
            end = np.sort(len(seg) - 1 - back)
            end = end[end > begin[end]]  # a term alone is counted already
            if not len(end):
                continue
            size = at[end] - begin[end] + 1
            offsets = np.concatenate([[0], np.cumsum(size)])
            flat = item[np.repeat(begin[end] - offsets[:-1], size) + np.arange(offsets[-1])].astype(">i4")
            paths = pc.dictionary_encode(pa.Array.from_buffers(pa.binary(), len(end), [None, pa.py_buffer((offsets * 4).astype(np.int32)), pa.py_buffer(flat)]))
            area = pc.index_in(batch.column("area"), value_set=names).to_numpy().astype(np.int64)[b.doc[seg[end]]]
            distinct = len(paths.dictionary)
            key, n = np.unique((area * SHARDS + item[end] % SHARDS) * distinct + paths.indices.to_numpy(), return_counts=True)
            path, of = paths.dictionary.take(pa.array(key % distinct)), key // distinct
            yield pa.RecordBatch.from_arrays([pa.array((of % SHARDS).astype(np.int32)), path, pa.array((of // SHARDS).astype(np.int32)), pa.array(n)], names=["shard", "items", "area", "n"])

    return run


class _Tree:
    """Frequent-pattern tree: for each node its item, its parent (-1 below the root) and its count in each area."""

    def __init__(self, items: np.ndarray, offsets: np.ndarray, counts: np.ndarray):
        """From transactions: ``items`` ascending within each, ``offsets`` of the transactions, ``counts`` (transactions, areas)."""
        size, base = np.diff(offsets), int(items.max()) + 1
        node, live, depth, n = np.full(len(size), -1), np.nonzero(size)[0], 0, 0
        parents, found, sums = [], [], []
        while len(live):
            key, to = np.unique((node[live] + 1) * base + items[offsets[live] + depth], return_inverse=True)
            parents.append(key // base - 1)
            found.append(key % base)
            sums.append(np.zeros((len(key), counts.shape[1]), dtype=np.int64))
            np.add.at(sums[-1], to, counts[live])
            node[live], n, depth = n + to, n + len(key), depth + 1
            live = live[size[live] > depth]
        self.parent, self.item, self.counts = np.concatenate(parents), np.concatenate(found), np.concatenate(sums)
        self._order = np.argsort(self.item, kind="stable")
        self.header, self._first = np.unique(self.item[self._order], return_index=True)

    def nodes(self, h: int) -> np.ndarray:
        """Nodes of the item at place ``h`` of the header table."""
        return self._order[self._first[h] : self._first[h + 1] if h + 1 < len(self._first) else None]

    def above(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Conditional pattern base of ``nodes``: (path, item) of all nodes above them, by path, items ascending."""
        paths, items = [], []
        path, at = np.arange(len(nodes)), self.parent[nodes]
        while True:
            path, at = path[at >= 0], at[at >= 0]
            if not len(at):
                break
            paths.append(path)
            items.append(self.item[at])
            at = self.parent[at]
        if not paths:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        path, item = np.concatenate(paths), np.concatenate(items)
        order = np.lexsort((item, path))
        return path[order], item[order]


class _Growth:
    """Rules of two terms and more from a tree. ``conf`` and ``prior`` are (listed terms, areas), ``number`` the terms' places by name."""

    def __init__(self, conf: np.ndarray, prior: np.ndarray, number: np.ndarray, least: int):
        self.conf, self.prior, self.number, self.least = conf, prior, number, least

    def grow(self, tree: _Tree, listed: np.ndarray, conf: np.ndarray, suffix: tuple[int, ...] = (), only=None):
        """(terms, areas, counts, totals) of each pattern that is a rule as far as the tree shows.

        ``listed`` gives the place in the frequent list of each item, ``conf`` what
        the suffix with each item promises, infinite where that is no rule.
        """
        for h, item in enumerate(tree.header):
            if only is not None and not only(item):
                continue
            nodes = tree.nodes(h)
            path, above = tree.above(nodes)
            if not len(path):
                continue
            counts = tree.counts[nodes]
            items, to = np.unique(above, return_inverse=True)
            n = np.zeros((len(items), counts.shape[1]), dtype=np.int64)
            np.add.at(n, to, counts[path])
            total = n.sum(axis=1)
            here = (*suffix, int(listed[item]))
            named = min(here, key=lambda i: self.number[i])
            p = self.prior[np.where(self.number[listed[items]] < self.number[named], listed[items], named)]
            c = _least_confidence(n, total[:, None])
            rule = (n >= self.least) & (c / p >= LIFT) & (c > RAISE * np.maximum(np.maximum(conf[items], conf[item]), p))
            kept = np.nonzero(rule.any(axis=1))[0]
            for r in kept:
                a = np.nonzero(rule[r])[0]
                yield sorted(int(self.number[i]) for i in (*here, listed[items[r]])), a, n[r, a], total[r]
            if len(kept) > 1:
                place = np.full(len(items), -1)
                place[kept] = np.arange(len(kept))
                stay = place[to] >= 0
                path, local = path[stay], place[to[stay]]
                _, begin = np.unique(path, return_index=True)
                below = _Tree(local, np.append(begin, len(path)), counts[path[begin]])
                yield from self.grow(below, listed[items[kept]], np.where(rule[kept], c[kept], np.inf), here)


def _grow(growth: _Growth):
    """Rows of :func:`_shards` sorted by (shard, items) -> (terms, area, n, total): a tree at a time, grown for the terms of its group."""
    listed = np.arange(len(growth.number))

    def grown(shard: int, held: list[tuple[pa.Array, np.ndarray]]):
        paths = pa.concat_arrays([p for p, _ in held])
        offsets = np.frombuffer(paths.buffers()[1], dtype=np.int32)[paths.offset : paths.offset + len(paths) + 1].astype(np.int64) // 4
        items = np.frombuffer(paths.buffers()[2], dtype=">i4")[: offsets[-1]].astype(np.int64)
        tree = _Tree(items, offsets, np.concatenate([c for _, c in held]))
        rows = [(t, int(a), int(k), int(total)) for t, areas, n, total in growth.grow(tree, listed, growth.conf, only=lambda i: i % SHARDS == shard) for a, k in zip(areas, n, strict=True)]
        types = (pa.list_(pa.int32()), pa.int32(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=t) for i, t in enumerate(types)], names=["terms", "area", "n", "total"])

    def run(batches):
        shard, held = None, []
        for batch in batches:
            shards = batch.column("shard").to_numpy()
            cut = np.concatenate([[0], np.nonzero(np.diff(shards))[0] + 1, [len(shards)]]) if len(shards) else [0]
            for start, end in zip(cut[:-1], cut[1:], strict=True):
                if shards[start] != shard:
                    if held:
                        yield grown(shard, held)
                    shard, held = int(shards[start]), []
                part = batch.slice(start, end - start)
                paths = pc.dictionary_encode(part.column("items"))
                counts = np.zeros((len(paths.dictionary), growth.conf.shape[1]), dtype=np.int64)
                np.add.at(counts, (paths.indices.to_numpy(), part.column("area").to_numpy()), part.column("n").to_numpy())
                held.append((paths.dictionary, counts))
        if held:
            yield grown(shard, held)

    return run


def mine(known: DataFrame) -> Rules | None:
    """Rules from (lang, area, segments) of documents with an area; None without any.

    Terms that no area attracts are left out before the growth, which would
    otherwise spend itself on the phrases all texts share.
    """
    prior_rows = known.groupBy("lang", "area").agg(F.count(F.lit(1)).alias("n")).collect()  # languages x areas
    total = sum(r["n"] for r in prior_rows)
    if not total:
        return None
    areas = sorted({r["area"] for r in prior_rows})
    index = {a: i for i, a in enumerate(areas)}
    prior: dict[str, np.ndarray] = {}
    for r in prior_rows:
        prior.setdefault(r["lang"], np.ones(len(areas)))[index[r["area"]]] += r["n"]
    prior = {k: v / v.sum() for k, v in prior.items()}
    least = max(LEAST_COUNT, int(total * SUPPORT))

    counted = known.mapInArrow(_count_terms, "term string, lang string, area string, n long").groupBy("term", "lang", "area").agg(F.sum("n").alias("n"))
    per = counted.groupBy("term").agg(F.sum("n").alias("total"), F.collect_list(F.struct("lang", "area", "n")).alias("c")).where(F.col("total") >= least)  # a term has languages x areas counts
    weights, conf_of, tongue, freq, grows = {}, {}, {}, {}, set()
    for r in per.collect():  # at most 1 / SUPPORT times the distinct terms of a mean document
        by_lang: dict[str, int] = {}
        by_area: dict[str, int] = {}
        for c in r["c"]:
            by_lang[c["lang"]] = by_lang.get(c["lang"], 0) + c["n"]
            by_area[c["area"]] = by_area.get(c["area"], 0) + c["n"]
        lang = max((n, g) for g, n in by_lang.items())[1]
        for a, n in by_area.items():
            c, p = _least_confidence(n, r["total"]), prior[lang][index[a]]
            if c / p >= LIFT:
                tongue[r["term"]], freq[r["term"]] = lang, r["total"]
                if n >= least:
                    conf_of[r["term"], index[a]] = c
                    weights.setdefault(r["term"], np.zeros(len(areas)))[index[a]] = np.log(c / p)
        # a pattern with the term has at most its n, and promises at most n of n
        if r["term"] in tongue and any(n >= least and _least_confidence(n, n) > RAISE * conf_of.get((r["term"], index[a]), 0.0) for a, n in by_area.items()):
            grows.add(r["term"])
    if not tongue:
        return None
    names = sorted(tongue)
    none = np.zeros(len(areas))
    return Rules(areas, names, np.array([weights.get(t, none) for t in names]), _longer(known, names, sorted(grows, key=lambda t: (-freq[t], t)), areas, conf_of, prior, tongue, least))


def _longer(known: DataFrame, names: list[str], listed: list[str], areas: list[str], conf_of: dict, prior: dict, tongue: dict, least: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rules of two terms and more, by length as :class:`Rules` keeps them. ``listed`` is the frequent list, most frequent first."""
    if len(listed) < 2:
        return []
    number = {t: i for i, t in enumerate(names)}
    conf = np.array([[conf_of.get((t, a), 0.0) for a in range(len(areas))] for t in listed])
    growth = _Growth(conf, np.array([prior[tongue[t]] for t in listed]), np.array([number[t] for t in listed]), least)
    sent = known.mapInArrow(_shards(listed, areas), "shard int, items binary, area int, n long")
    rows = sent.repartition("shard").sortWithinPartitions("shard", "items").mapInArrow(_grow(growth), "terms array<int>, area int, n long, total long").collect()  # rules only

    promised = {(number[t], a): c for (t, a), c in conf_of.items()}
    found: dict[tuple[int, ...], np.ndarray] = {}
    confs: dict[tuple[tuple[int, ...], int], float] = {}
    for r in sorted(rows, key=lambda r: len(r["terms"])):  # the parts of a pattern come from several trees
        terms, a, c = tuple(r["terms"]), r["area"], _least_confidence(r["n"], r["total"])
        p = prior[tongue[names[terms[0]]]][a]
        if len(terms) == 2:
            parts = [promised.get((t, a), p) for t in terms]
        else:
            parts = [confs.get((terms[:i] + terms[i + 1 :], a), np.inf) for i in range(len(terms))]
        shorter = max(p, *parts)
        if c > RAISE * shorter:  # else a shorter rule says as much, or a part is no rule
            confs[terms, a] = c
            found.setdefault(terms, np.zeros(len(areas)))[a] = np.log(c / shorter)
    levels, place = [], {(i,): i for i in range(len(names))}
    while True:
        own = sorted((place[t[:-1]] * len(names) + t[-1], t) for t in found if len(t) == len(levels) + 2)
        if not own:
            return levels
        levels.append((np.array([k for k, _ in own], dtype=np.int64), np.array([found[t] for _, t in own])))
        place = {t: i for i, (_, t) in enumerate(own)}


def _strengths(rules: Rules):
    """Labelled documents -> counts of segments by strength of the best area and whether it is the document's."""
    order = {a: i for i, a in enumerate(rules.areas)}

    def run(batches):
        for batch in batches:
            docs = batch.column("segments")
            outer = docs.offsets.to_numpy().astype(np.int64)
            inner = docs.values.slice(outer[0], outer[-1] - outer[0])
            if not len(inner):
                continue
            e = rules.evidence(inner)
            own = np.array([order.get(a, -1) for a in batch.column("area").to_pylist()])[np.repeat(np.arange(batch.num_rows), np.diff(outer))]
            right = e.argmax(axis=1) == own
            bin_ = np.minimum(np.floor(e.max(axis=1) * PER_UNIT), BINS - 1).astype(np.int64)
            key, n = np.unique(bin_ * 2 + right, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array((key // 2).astype(np.int32)), pa.array((key % 2).astype(np.int32)), pa.array(n)], names=["bin", "good", "n"])

    return run


def pooled(good: np.ndarray, every: np.ndarray) -> np.ndarray:
    """Probability of being right per bin, never falling: neighbouring bins that fall are pooled; empty bins take the one below."""
    blocks: list[list[float]] = []
    for g, n in zip(good, every, strict=True):
        blocks.append([g, n, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            g2, n2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + g2, blocks[-1][1] + n2, blocks[-1][2] + k2]
    return np.concatenate([np.full(k, g / n if n else 0.0) for g, n, k in blocks])


def calibrate(rules: Rules, labelled: DataFrame) -> Rules:
    """Set the probability of each bin of evidence from labelled documents that the rules were not mined from."""
    rows = labelled.select("area", "segments").mapInArrow(_strengths(rules), "bin int, good int, n long").groupBy("bin", "good").agg(F.sum("n").alias("n")).collect()  # BINS x 2
    good, every = np.zeros(BINS), np.zeros(BINS)
    for r in rows:
        every[r["bin"]] += r["n"]
        good[r["bin"]] += r["n"] * r["good"]
    rules.chance = pooled(good, every)
    rules.chance[0] = 0.0  # no rule matches
    return rules


def _shares(rules: Rules, batch: pa.RecordBatch) -> np.ndarray:
    """(documents, areas) shares of the words in segments that are rather of the area than not."""
    docs = batch.column("segments")
    outer = docs.offsets.to_numpy().astype(np.int64)
    inner = docs.values.slice(outer[0], outer[-1] - outer[0])
    of = np.zeros((batch.num_rows, len(rules.areas)))
    if not len(inner):
        return of
    e = rules.evidence(inner)
    best = e.argmax(axis=1)
    sure = rules.chance[np.minimum(np.floor(e.max(axis=1) * PER_UNIT), BINS - 1).astype(np.int64)] >= 0.5
    size = np.diff(inner.offsets.to_numpy()).astype(np.float64)
    doc = np.repeat(np.arange(batch.num_rows), np.diff(outer))
    np.add.at(of, (doc[sure], best[sure]), size[sure])
    return of / np.maximum(np.bincount(doc, size, batch.num_rows), 1)[:, None]


def _score(rules: Rules, share: float):
    def run(batches):
        for batch in batches:
            part = _shares(rules, batch)
            r, a = np.nonzero(part >= share)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(r)), pa.array([rules.areas[i] for i in a], type=pa.string()), pa.array(part[r, a])], names=["doc_id", "area", "share"])

    return run


def _name(rules: Rules):
    """Documents -> those with a label or one clear area, under it."""

    def run(batches):
        for batch in batches:
            clear = _shares(rules, batch) >= CLEAR
            own = batch.column("area")
            named = pa.array([rules.areas[i] for i in clear.argmax(axis=1)], type=pa.string())
            area = pc.if_else(pc.is_valid(own), own, named)
            keep = pa.array((clear.sum(axis=1) == 1) | np.asarray(own.is_valid()))
            yield pa.RecordBatch.from_arrays([batch.column("lang"), area, batch.column("segments")], names=["lang", "area", "segments"]).filter(keep)

    return run


def fit(docs: DataFrame) -> Rules | None:
    """Mine and calibrate on :func:`prepared` documents, in two rounds; None without labels.

    The first round learns from the labels. The second counts over all documents
    that are labelled or that the first finds to be of one clear area, which
    teaches it the words that the few labels of a language lack.
    """
    labelled = docs.where(F.col("area").isNotNull())
    known, held = labelled.where(~F.col("held")), labelled.where("held")
    if held.isEmpty():
        held = labelled
    rules = mine(known.select("lang", "area", "segments"))
    if rules is None:
        return None
    rules = calibrate(rules, held)
    pool = docs.where(F.col("area").isNull() | ~F.col("held")).select("lang", "area", "segments")
    named = materialize(pool.mapInArrow(_name(rules), "lang string, area string, segments array<array<string>>"), "area-named")
    again = mine(named)
    return rules if again is None else calibrate(again, held)


def classify(docs: DataFrame, rules: Rules | None, share: float = SHARE) -> DataFrame:
    """(doc_id, area, share of the words) of every area that makes up ``share`` or more of a :func:`prepared` document."""
    if rules is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, area string, share double")
    return docs.select("doc_id", "segments").mapInArrow(_score(rules, share), "doc_id long, area string, share double")
