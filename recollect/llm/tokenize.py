"""Token ids of a whole corpus with a public byte-level BPE, over a table of distinct words (problem 8).

Texts are split into words in Spark by the tokenizer's own pattern; a word's
ids never depend on its neighbours, so each distinct word is encoded once. The
ids go back by position: words so frequent that they cover most of the corpus
(at most ``FREQUENT`` of them) travel as one small broadcast, all others are
joined by word, and only those cross the network.

Defined results: null and empty texts give an empty list; strings that look like
special tokens are ordinary text; rows may repeat, and each keeps its own
result; texts holding code points that Java's tables do not know are one word,
which the encoder splits itself; an empty table gives no rows; columns other
than the key and the text are dropped.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.storage import materialize

#: Words of more than a 1/FREQUENT part of the corpus are frequent; there can be no more than FREQUENT.
FREQUENT = 65_536
#: Fixed value: the tokenizer's pattern, white space spelled out for Java.
_W = r"\t-\r\x{85}\p{Z}"
PATTERN = rf"'(?:[sdmt]|re|ve|ll)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_W}\p{{L}}\p{{N}}]+|[{_W}]+(?![^{_W}])|[{_W}]+"


def vocabulary(path: str | None = None) -> str:
    """File of byte_bpe_50k; the installed one unless a path is given."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def words(text: Column) -> Column:
    """Words of a text in order; their concatenation is the text."""
    split = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    return F.when(text.isNull() | (text == ""), F.array().cast("array<string>")).when(F.rlike(text, F.lit(r"\p{Cn}")), F.array(text)).otherwise(split)


def _encode(path: str):
    def run(batches):
        tokenizer = _tokenizer(path)
        for batch in batches:
            if not batch.num_rows:
                continue
            found = [e.ids for e in tokenizer.encode_batch(batch.column("word").to_pylist(), add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(found, type=pa.list_(pa.int32()))], names=["word", "n", "word_ids"])

    return run


def word_table(texts: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """(word, n, word_ids) of every distinct word; counts are pre-aggregated map-side."""
    counted = texts.select(F.explode(words(F.col(text))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.mapInArrow(_encode(vocabulary(path)), "word string, n long, word_ids array<int>")


def _assemble(frequent_words: list[str], frequent_ids: list[list[int]]):
    """Arrow batches (key, words, rest) -> (key, ids); look-ups and gathers run on whole batches."""
    known = pa.array(frequent_words, type=pa.string())
    lengths = np.array([len(x) for x in frequent_ids] or [0], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    flat = np.fromiter((i for x in frequent_ids for i in x), dtype=np.int32)

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            lists = batch.column("words")
            offsets = lists.offsets.to_numpy().astype(np.int64)
            tokens = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
            offsets -= offsets[0]
            at = pc.fill_null(pc.index_in(tokens, value_set=known), -1).to_numpy().astype(np.int64)
            length = np.where(at >= 0, lengths[at], 0)
            start = np.where(at >= 0, starts[at], 0)
            pool = flat
            rest = batch.column("rest")
            ro = rest.offsets.to_numpy().astype(np.int64)
            cold = rest.values.slice(ro[0], ro[-1] - ro[0])
            if len(cold):
                pos = cold.field("pos").to_numpy().astype(np.int64)
                row = np.repeat(np.arange(n), np.diff(ro))
                ids = cold.field("word_ids")
                io = ids.offsets.to_numpy().astype(np.int64)
                where = offsets[row] + pos
                length[where] = np.diff(io)
                start[where] = len(flat) + io[:-1] - io[0]
                pool = np.concatenate([flat, ids.values.to_numpy()[io[0] : io[-1]]])
            ends = np.cumsum(length)
            total = int(ends[-1]) if len(ends) else 0
            index = np.arange(total, dtype=np.int64) + np.repeat(start - (ends - length), length)
            bounds = np.concatenate([[0], ends])[offsets].astype(np.int32)
            out = pa.ListArray.from_arrays(pa.array(bounds), pa.array(pool[index].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("key"), out], names=["key", "ids"])

    return run


def encode(texts: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, frequent: int = FREQUENT) -> DataFrame:
    """(key, ids) for every row of ``texts``.

    ``frequent`` bounds the broadcast: a word is frequent if it makes up more
    than 1/frequent of all words. The join of the others is free of hot words.
    Repeated rows share one list of rare words: a set, de-duplicated map-side,
    so R copies of a row carry it once and not R times.
    """
    spark = texts.sparkSession
    rows = texts.select(F.col(key).alias("key"), F.col(text).alias("text"))
    table = materialize(word_table(rows, "text", path), "words")
    total = table.agg(F.sum("n")).first()[0] or 0
    common = table.where(F.col("n") * frequent > total).select("word", "word_ids").collect()  # fewer than ``frequent``
    mark = spark.createDataFrame([(r.word, True) for r in common], "word string, known boolean")
    identity = [F.xxhash64("key", "text").alias("h1"), F.hash(F.col("text"), F.col("key")).alias("h2")]
    rare = rows.select(*identity, F.posexplode(words(F.col("text"))).alias("pos", "word")).join(F.broadcast(mark), "word", "left_anti")
    rare = rare.join(table.select("word", "word_ids"), "word").groupBy("h1", "h2").agg(F.collect_set(F.struct("pos", "word_ids")).alias("rest"))
    none = F.array().cast("array<struct<pos:int,word_ids:array<int>>>")
    joined = rows.select("key", "text", *identity).join(rare, ["h1", "h2"], "left").select("key", words(F.col("text")).alias("words"), F.coalesce("rest", none).alias("rest"))
    kind = dict(texts.dtypes)[key]
    return joined.mapInArrow(_assemble([r.word for r in common], [r.word_ids for r in common]), f"key {kind}, ids array<int>").withColumnRenamed("key", key)


@lru_cache(maxsize=2)
def pieces(path: str) -> list[bytes]:
    """Bytes of every id, in order of ids."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    return [bytes(byte_of[c] for c in piece) for piece, _ in sorted(vocab.items(), key=lambda x: x[1])]


def id_table(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(id, piece): the bytes of every id. Bounded by the vocabulary."""
    return spark.createDataFrame(list(enumerate(pieces(vocabulary(path)))), "id int, piece binary")


def decode(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """(key, text): each id joined with its piece and the pieces of a row put together; null and empty lists give ''.

    The table of pieces is bounded by the vocabulary, so the join runs inside
    the map: a batch's ids are looked up at once and nothing is shuffled.
    """
    file, kind = vocabulary(path), dict(encoded.dtypes)[key]

    def run(batches):
        table = pa.array(pieces(file), type=pa.binary())
        for batch in batches:
            lists = batch.column("ids")
            offsets = lists.offsets.to_numpy()
            found = table.take(lists.values.slice(offsets[0], offsets[-1] - offsets[0]))
            parts = pa.ListArray.from_arrays(pa.array(offsets - offsets[0]), found)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pc.binary_join(parts, b"").cast(pa.string())], names=["key", "text"])

    rows = encoded.select(F.col(key).alias("key"), F.coalesce(ids, F.array().cast("array<int>")).alias("ids"))
    return rows.mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)
