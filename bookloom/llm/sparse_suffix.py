"""Repeated passages by a sparse suffix array.

Of all word suffixes of all documents, those at minimiser positions are kept: the least
hash of K words in every run of W positions. Any passage of PASSAGE words holds a whole
run, so equal passages keep a suffix at the same place, with at least PREFIX words of the
passage from there on. The kept suffixes are sorted over the cluster by their first
PREFIX words (as a 64-bit hash, so that equal prefixes are neighbours) and neighbours are
compared. Suffixes with an equal neighbour in another document are then extended: every
PASSAGE-word window that starts up to W - 1 words to their left is matched over all
documents, and the matched windows of a document are joined into maximal spans.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bookloom.llm.best_fit_packing import blocks
from bookloom.llm.shared import attach, drop_written, read, written
from bookloom.runtime import ship

PASSAGE = 50
K, W = 8, 18
PREFIX = PASSAGE - W + 1
#: Words a Python worker remembers the hashes of; then it starts over. Speed only.
CACHED_WORDS = 1_000_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """Word (bytes) to its number; self.hashes has the numbered words' 64-bit hashes."""

    def __init__(self):
        super().__init__()
        self.hashes, self.new = np.zeros(1 << 16, np.uint64), []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > CACHED_WORDS:
            self.clear()
        numbers = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.new:
            if len(self) > len(self.hashes):
                self.hashes = np.concatenate([self.hashes, np.zeros(len(self), np.uint64)])
            first = len(self) - len(self.new)
            self.hashes[first:len(self)] = np.fromiter(map(xxhash.xxh64_intdigest, self.new), np.uint64, len(self.new))
            self.new = []
        return self.hashes[numbers]


_HASHES = WordHashes()


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MULTIPLIER
    return h ^ (h >> np.uint64(29))


def hash_at(h: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each start."""
    out = np.zeros(len(starts), np.uint64)
    for i in range(n):
        out = out * MULTIPLIER + h[starts + i]
    return mixed(out)


def slide(a: np.ndarray, n: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over every n neighbours."""
    size = 1
    while 2 * size <= n:
        a = pick(a[:-size], a[size:])
        size *= 2
    return pick(a[:len(a) - (n - size)], a[n - size:]) if n > size else a


def minimisers(h: np.ndarray) -> np.ndarray:
    """Kept positions of a sequence of word hashes: every position whose K-word hash is
    the least of some W neighbouring ones (ties are all kept)."""
    if len(h) < K + W - 1:
        return np.zeros(0, np.int64)
    grams = np.zeros(len(h) - K + 1, np.uint64)
    for i in range(K):
        grams = grams * MULTIPLIER + h[i:len(h) - K + 1 + i]
    grams = mixed(grams)
    least = slide(grams, W, np.minimum)
    padded = np.concatenate([np.zeros(W - 1, np.uint64), least, np.zeros(W - 1, np.uint64)])
    return np.flatnonzero(slide(padded, W, np.maximum) == grams)


def block_hashes(texts: list[bytes]):
    """(hashes, starts, ends) of the words of all texts."""
    split = [t.split() for t in texts]
    ends = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))
    return _HASHES.of([w for words in split for w in words]), np.concatenate([[0], ends[:-1]]), ends


def suffixes(docs: DataFrame) -> DataFrame:
    """(key, doc_id, pos): kept suffixes of at least PREFIX words. key: hash of their
    first PREFIX words, pos: the word they start at."""
    ship(docs.sparkSession)

    def of_batches(batches):
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            for first, last in blocks(texts):
                h, starts, ends = block_hashes(texts[first:last])
                at = minimisers(h)  # windows over text borders only keep more positions
                doc = np.searchsorted(ends, at, side="right")
                fits = at + PREFIX <= ends[doc]
                at, doc = at[fits], doc[fits]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hash_at(h, at, PREFIX).view(np.int64)), batch.column(0).take(pa.array(doc + first)), pa.array((at - starts[doc]).astype(np.int32))],
                    names=["key", "doc_id", "pos"])

    return docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(
        of_batches, f"key long, doc_id {dict(docs.dtypes)['doc_id']}, pos int")


def with_equal_neighbours(found: DataFrame) -> DataFrame:
    """Rows of found (key, doc_id, pos) whose key another document has: sort, compare
    neighbours. A key's rows may span partitions, so a run of one document at the edge
    of a partition is settled afterwards."""

    def compare(batches):
        held = None
        edge = True  # the run of held rows starts the partition

        def out(rows, state):
            return pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.full(len(rows), state, np.int32))], names=["key", "doc_id", "pos", "state"])

        def judge(rows, last):
            nonlocal edge
            key, doc = rows["key"].to_numpy(), rows["doc_id"].to_numpy()
            first = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
            apart = doc[first[:-1]] != doc[first[1:] - 1]  # documents are sorted within a run
            state = apart.astype(np.int32) * 2
            if edge:
                state[0] = max(state[0], 1)
            if last:
                state[-1] = max(state[-1], 1)
            edge = False
            state = np.repeat(state, np.diff(first))
            for s in (1, 2):
                some = rows.filter(pa.array(state == s))
                for part in some.combine_chunks().to_batches():
                    yield out(part, s)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if len(held) < 200_000:
                continue
            key = held["key"].to_numpy()
            cut = int(np.searchsorted(key, key[-1]))  # the last run may go on
            if cut:
                yield from judge(held.slice(0, cut), False)
                held = held.slice(cut).combine_chunks()
        if held is not None and len(held):
            yield from judge(held, True)

    kind = dict(found.dtypes)["doc_id"]
    ordered = found.repartitionByRange("key", "doc_id").sortWithinPartitions("key", "doc_id", "pos")
    judged = written(ordered.mapInArrow(compare, f"key long, doc_id {kind}, pos int, state int"))
    edges = judged.where("state = 1").groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    inner = judged.where("state = 2").select("key").distinct().withColumn("sure", F.lit(True))
    settled = judged.where("state = 1").join(edges, "key").join(inner, "key", "left").where("lo <> hi OR sure")
    return judged.where("state = 2").select("key", "doc_id", "pos").unionByName(settled.select("key", "doc_id", "pos"))


def windows(docs: DataFrame, positions: DataFrame) -> DataFrame:
    """(window, doc_id, start) of the PASSAGE-word windows that start at or up to W - 1
    words before the positions. positions: (doc_id, at array<int>)."""
    kind = dict(docs.dtypes)["doc_id"]

    def of_batches(batches):
        back = np.arange(W)
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            lists = batch.column(2)
            values, bounds = lists.flatten().to_numpy(), np.cumsum([0, *(len(x) for x in lists)])
            for first, last in blocks(texts):
                h, starts, ends = block_hashes(texts[first:last])
                which, where = [], []
                for i in range(first, last):
                    near = values[bounds[i]:bounds[i + 1]][:, None] - back
                    s = np.unique(near)
                    s = s[(s >= 0) & (s + PASSAGE <= ends[i - first] - starts[i - first])]
                    which.append(np.full(len(s), i))
                    where.append(s + starts[i - first])
                which, where = np.concatenate(which), np.concatenate(where)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hash_at(h, where, PASSAGE).view(np.int64)), batch.column(0).take(pa.array(which)), pa.array((where - starts[which - first]).astype(np.int32))],
                    names=["window", "doc_id", "start"])

    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    return texts.join(positions, "doc_id").select("doc_id", "text", "at").mapInArrow(of_batches, f"window long, doc_id {kind}, start int")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, start_word, n_words, first_doc_id, other_doc_id): the maximal spans of
    each document that are covered by PASSAGE-word windows found in another document
    too. first_doc_id is the smallest document with one of the span's windows, possibly
    the row's own; other_doc_id is another document with one of them.

    Words are runs of anything but ASCII white space, compared as they are. Defined
    cases: null, empty and shorter texts have no passages; rows that share a doc_id are
    one document, so copies under one id do not repeat; a null doc_id is not searched;
    copies of whole documents are passages like any other; other columns are not read,
    whatever their names; an empty table gives no rows.
    """
    kept = written(suffixes(docs))
    same = written(with_equal_neighbours(kept))
    drop_written(kept)
    positions = same.groupBy("doc_id").agg(F.collect_set("pos").alias("at"))
    seen = written(windows(docs, positions))
    shared = written(seen.groupBy("window").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi"))
    matched = attach(seen, shared, "window", seen.count()).where("lo IS NOT NULL")
    by_doc = Window.partitionBy("doc_id").orderBy("start")
    marked = matched.withColumn("_new", (F.col("start") > F.coalesce(F.lag("start").over(by_doc) + PASSAGE, F.lit(-1))).cast("int"))
    spans = marked.withColumn("_span", F.sum("_new").over(by_doc))
    return spans.groupBy("doc_id", "_span").agg(
        F.min("start").alias("start_word"), (F.max("start") + PASSAGE - F.min("start")).alias("n_words"), F.min("lo").alias("first_doc_id"),
        F.max(F.when(F.col("hi") == F.col("doc_id"), F.col("lo")).otherwise(F.col("hi"))).alias("other_doc_id")).drop("_span")


def op5_sparse_suffix(spark, sf_dir: str) -> DataFrame:
    return repeated_passages(read(spark, sf_dir, "documents"))
