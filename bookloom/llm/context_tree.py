"""Language-model scoring by context-tree weighting over bytes.

A byte is coded as eight binary decisions; each decision has a tree of contexts, the
last 0 to DEPTH bytes. A context node keeps the training counts of both outcomes and
their Krichevsky-Trofimov (KT) estimate, and its weighted probability is half the
estimate plus half the product of its children's weighted probabilities. After training,
the share of the own estimate in that sum weighs the node's prediction against that of
the longer contexts, so every prediction mixes the estimates of all depths.

Counts are gathered from all training documents. Runs of documents as they lie make up
chunks of bounded bytes, written once; a chunk sends one packed array of its distinct words
and byte strings, with their training counts, to each key bucket. A bucket adds up the
counts of all chunks and sends back to each, in the same order, the counts of its words and
the log probabilities of its byte strings, so neither the model nor the vocabulary is ever
in one place. A bucket of byte strings holds whole subtrees below contexts of SPLIT bytes,
which it weights a bounded number of byte strings at a time; the shallower nodes, few at
any size, are weighted and mixed as DataFrames in between.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookloom.llm.best_fit_packing import blocks
from bookloom.llm.shared import free_shuffles, read, written
from bookloom.runtime import ship

#: Bytes of context; up to MAX_DEPTH, as a byte string of one more must fit a long with a
#: byte to spare.
DEPTH, MAX_DEPTH = 5, 6
#: Depth at which trees are cut into buckets.
SPLIT = 3
BLOCK_BYTES = 1 << 19
#: Bytes of text in a chunk, at most, but for a longer document.
CHUNK_BYTES = 6 << 20
#: Bytes of text for each key bucket.
BUCKET_BYTES = 6 << 20
#: Byte strings whose trees are weighted at once.
TREE_KEYS = 1 << 18
#: Bytes of keys and counts in a batch of rows for the buckets.
BATCH_BYTES = 2 << 20
HELD_OUT, FOLDS = 2, 7
WORD, GRAM = 0, 1
LOG10_OF_2 = float(np.log10(2))
_PACKER, _UNPACKER = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


def symbols(texts: list[bytes], depth: int):
    """(codes, ends): for every byte of every text and the end sign (byte 0) behind
    it, the depth bytes before it and itself as one number. Before a text lie zeros."""
    pad = b"\0" * depth
    joined = np.frombuffer(b"".join(pad + t + b"\0" for t in texts), np.uint8)
    code = np.zeros(len(joined) - depth, np.uint64)
    for i in range(depth + 1):
        code = (code << np.uint64(8)) | joined[i:len(joined) - depth + i]
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    starts = np.cumsum(sizes + depth) - (sizes + depth)
    keep = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    return code[keep].view(np.int64), np.cumsum(sizes)


def word_key(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) - (1 << 63)


def pack(a: np.ndarray) -> bytes:
    """An array of 8-byte numbers as byte planes, which compress well, compressed."""
    return _PACKER.compress(a.astype("<i8" if a.dtype.kind in "iu" else "<f8").view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack(data: bytes, kind: str = "<i8") -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_UNPACKER.decompress(data), np.uint8).reshape(8, -1).T).view(kind).ravel()


def near_context(keys: np.ndarray, depth: int) -> np.ndarray:
    """The last SPLIT bytes of the contexts of byte strings."""
    return (keys >> 8) & ((1 << (8 * min(SPLIT, depth))) - 1)


def spread(keys: np.ndarray, kind: int, n_buckets: int, depth: int) -> np.ndarray:
    """Bucket of each key: byte strings by the last SPLIT bytes of their context."""
    own = (keys if kind == WORD else near_context(keys, depth)).view(np.uint64)
    mixed = (own ^ (own >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(32)) % np.uint64(n_buckets)).astype(np.int64)


def in_buckets(keys: np.ndarray, kind: int, n_buckets: int, depth: int):
    """(order, bucket, first, last): keys by bucket and value, the same wherever the same
    set of keys is given."""
    bucket = spread(keys, kind, n_buckets, depth)
    order = np.lexsort((keys, bucket))
    names, first = np.unique(bucket[order], return_index=True)
    return order, list(zip(names.tolist(), first.tolist(), [*first[1:].tolist(), len(keys)]))


def chunk_grams(texts: list[bytes], depth: int):
    """(first, last, number of the code at every byte, unique codes, ends) of each block."""
    for first, last in blocks(texts, BLOCK_BYTES):
        codes, ends = symbols(texts[first:last], depth)
        number, unique = pd.factorize(codes)
        yield first, last, number.astype(np.int32), unique, ends


def chunks(rows: DataFrame, chunk_bytes: int) -> DataFrame:
    """(chunk, payload, size): rows (doc_id, text, held_out), lower-cased, in compressed
    Arrow batches of up to chunk_bytes of text. Rows stay where they are, so ids that
    repeat and hot documents don't meet."""
    def of_batches(batches):
        from pyspark import TaskContext

        options = pa.ipc.IpcWriteOptions(compression="zstd")
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def packed():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=options) as out:
                for part in held:
                    out.write_batch(part)
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([size], pa.int64())], names=["chunk", "payload", "size"])

        for batch in batches:
            lower = [t.lower() for t in batch.column(1).to_pylist()]
            first = 0
            for i, text in enumerate(lower):
                if size and size + len(text) > chunk_bytes:
                    if i > first:
                        held.append(taken(batch, lower, first, i))
                    yield packed()
                    number, held, size, first = number + 1, [], 0, i
                size += len(text) + 1
            held.append(taken(batch, lower, first, len(lower)))
        if size:
            yield packed()

    def taken(batch, lower, first, last):
        part = batch.slice(first, last - first)
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(lower[first:last], pa.binary()), part.column(2)], names=["doc_id", "text", "held_out"])

    return rows.select("doc_id", "text", "held_out").mapInArrow(of_batches, "chunk long, payload binary, size long")


def opened(payload: bytes):
    """(doc ids, texts, held out) of a chunk."""
    table = pa.ipc.open_stream(payload).read_all()
    return table["doc_id"].combine_chunks(), table["text"].to_pylist(), table["held_out"].to_numpy()


def chunk_requests(chunk: int, payload: bytes, n_buckets: int, depth: int):
    """Rows (chunk, kind, bucket, keys, counts) for every word and byte string of a chunk;
    counts are of training texts."""
    _, texts, held = opened(payload)
    words, others, grams = Counter(), set(), []
    for text, out in zip(texts, held):
        (others if out else words).update(text.split())
    others.difference_update(words)
    word_keys = np.fromiter(map(word_key, (*words, *others)), np.int64, len(words) + len(others))
    word_counts = np.concatenate([np.fromiter(words.values(), np.int64, len(words)), np.zeros(len(others), np.int64)])
    del words, others
    for first, last, number, unique, ends in chunk_grams(texts, depth):
        train = np.repeat(~held[first:last], np.diff(ends, prepend=0)).astype(np.int64)
        grams.append((unique, np.bincount(number, train, len(unique)).astype(np.int64)))
    gram_keys, number = np.unique(np.concatenate([u for u, _ in grams]), return_inverse=True)
    gram_counts = np.bincount(number, np.concatenate([c for _, c in grams]), len(gram_keys)).astype(np.int64)
    del grams, number, texts
    for kind, keys, counts in ((WORD, word_keys, word_counts), (GRAM, gram_keys, gram_counts)):
        order, parts = in_buckets(keys, kind, n_buckets, depth)
        keys, counts = keys[order], counts[order]
        for b, i, j in parts:
            yield chunk, kind, b, pack(np.diff(keys[i:j], prepend=np.int64(0))), pack(counts[i:j])


def requests(payloads: DataFrame, n_buckets: int, depth: int) -> DataFrame:
    def packed(rows):
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=["chunk", "kind", "bucket", "keys", "counts"])

    def of_batches(batches):
        for batch in batches:
            for chunk, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows, size = [], 0
                for row in chunk_requests(chunk, payload.as_py(), n_buckets, depth):
                    rows.append(row)
                    size += len(row[3]) + len(row[4])
                    if size >= BATCH_BYTES:
                        yield packed(rows)
                        rows, size = [], 0
                if rows:
                    yield packed(rows)

    return payloads.select("chunk", "payload").mapInArrow(of_batches, "chunk long, kind int, bucket long, keys binary, counts binary")


def merged(rows: pd.DataFrame):
    """(unique keys, summed counts, number of each key of each row, ends of rows)."""
    keys = [np.cumsum(unpack(x)) for x in rows["keys"]]
    ends = np.cumsum([len(k) for k in keys])
    keys = np.concatenate(keys)
    unique, number = np.unique(keys, return_inverse=True)
    del keys
    number = number.astype(np.int32)
    counts, at = np.zeros(len(unique)), 0
    for packed, end in zip(rows["counts"], ends.tolist()):
        counts[number[at:end]] += unpack(packed)  # keys of a row are distinct
        at = end
    return unique, counts, number, ends


def answer(rows: pd.DataFrame, values: np.ndarray, ends: np.ndarray) -> pd.DataFrame:
    parts = np.split(values, ends[:-1])
    return pd.DataFrame({"chunk": rows["chunk"].to_numpy(), "kind": rows["kind"].to_numpy(), "bucket": rows["bucket"].to_numpy(), "values": [pack(p) for p in parts]})


def word_answers(rows: pd.DataFrame) -> pd.DataFrame:
    """Counts for every chunk; one row also has the bucket's totals."""
    unique, counts, number, ends = merged(rows)
    out = answer(rows, counts.astype(np.int64)[number], ends)
    once = np.arange(len(out)) == 0
    return out.assign(seen=np.where(once, int(counts.sum()), 0), distinct=np.where(once, int((counts > 0).sum()), 0))


def log_gamma(x):
    """ln gamma of numbers or a column of at least 1/2: Stirling's series at x + 7."""
    log = F.log if isinstance(x, Column) else np.log
    up = x + 7
    product = x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6)
    cube = up * up * up
    return ((up - 0.5) * log(up) - up + float(0.5 * np.log(2 * np.pi)) + 1 / (12 * up) - 1 / (360 * cube)
            + 1 / (1260 * cube * up * up) - 1 / (1680 * cube * cube * up) - log(product))


def log_estimate(zeros, ones):
    """ln of the KT estimate of a sequence with so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1) - float(np.log(np.pi))


def parent(node, depth: int):
    """Node with one byte of context less: a node is its context and, in the low byte,
    the place in the tree of the next byte's bits."""
    mask = (1 << (8 * (depth - 1))) - 1
    if isinstance(node, Column):
        return F.shiftleft(F.shiftright(node, 8).bitwiseAND(mask), 8).bitwiseOR(node.bitwiseAND(0xFF))
    return ((node >> 8) & mask) << 8 | (node & 0xFF)


class Subtrees:
    """Nodes of depth to SPLIT bytes of context over byte strings with their counts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int):
        s, context = keys & 0xFF, keys >> 8
        self.bit = np.stack([(s >> (7 - i)) & 1 for i in range(8)])
        nodes = np.stack([context << 8 | (1 << i) | (s >> (8 - i)) for i in range(8)])
        node, self.leaf = np.unique(nodes.ravel(), return_inverse=True)
        weight = np.tile(counts, 8)
        one = self.bit.ravel() == 1
        zeros, ones = np.bincount(self.leaf, weight * ~one, len(node)), np.bincount(self.leaf, weight * one, len(node))
        weighted = log_estimate(zeros, ones)
        self.levels = [(node, (ones + 0.5) / (zeros + ones + 1), np.ones(len(node)), None)]
        for d in range(depth, SPLIT, -1):
            node, up = np.unique(parent(node, d), return_inverse=True)
            children = np.bincount(up, weighted, len(node))
            zeros, ones = np.bincount(up, zeros, len(node)), np.bincount(up, ones, len(node))
            own = log_estimate(zeros, ones)
            weighted = np.logaddexp(own, children) - np.log(2)
            share = 1 / (1 + np.exp(np.minimum(children - own, 700.0)))
            self.levels.append((node, (ones + 0.5) / (zeros + ones + 1), share, up))
        self.top = (node, zeros, ones, weighted)

    def log10_of_keys(self, done: np.ndarray, left: np.ndarray) -> np.ndarray:
        """done, left: of the top nodes' parents, the prediction mixed so far and the
        weight that is left for longer contexts."""
        for i in range(len(self.levels) - 1, -1, -1):
            _, p1, share, _ = self.levels[i]
            done, left = done + left * share * p1, left * (1 - share)
            if i:
                up = self.levels[i][3]
                done, left = done[up], left[up]
        p1 = done[self.leaf].reshape(8, -1)
        return np.log10(np.where(self.bit == 1, p1, 1 - p1)).sum(axis=0)


def subtrees(keys: np.ndarray, counts: np.ndarray, depth: int):
    """(places, Subtrees) of about TREE_KEYS keys each; trees stay whole."""
    context = near_context(keys, depth)
    order = np.argsort(context, kind="stable")
    starts = np.flatnonzero(np.diff(context[order], prepend=np.int64(-1)))
    first = 0
    while first < len(keys):
        at = np.searchsorted(starts, first + TREE_KEYS)
        last = int(starts[at]) if at < len(starts) else len(keys)
        some = order[first:last]
        yield some, Subtrees(keys[some], counts[some], depth)
        first = last


def top_nodes(rows: pd.DataFrame, depth: int) -> pd.DataFrame:
    unique, counts, _, _ = merged(rows)
    out = []
    for _, tree in subtrees(unique, counts, depth):
        node, zeros, ones, weighted = tree.top
        out.append(pd.DataFrame({"bucket": rows["bucket"].iloc[0], "node": node, "zeros": zeros, "ones": ones, "weighted": weighted}))
    return pd.concat(out)


def gram_answers(rows: pd.DataFrame, tops: pd.DataFrame, depth: int) -> pd.DataFrame:
    unique, counts, number, ends = merged(rows)
    tops, logs = tops.set_index("node"), np.zeros(len(unique))
    for some, tree in subtrees(unique, counts, depth):
        own = tops.loc[tree.top[0]]
        logs[some] = tree.log10_of_keys(own["done"].to_numpy(float), own["left"].to_numpy(float))
    return answer(rows, logs[number], ends)


def mixed_above(tops: DataFrame, split: int) -> DataFrame:
    """tops (bucket, node of split bytes, zeros, ones, weighted) with `done` and `left` of
    their parents: the trees above, weighted upwards and mixed downwards."""
    level, levels = tops.select("node", "zeros", "ones", "weighted"), []
    for depth in range(split, 0, -1):
        above = level.groupBy(parent(F.col("node"), depth).alias("node")).agg(
            F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("children"))
        above = above.withColumn("own", log_estimate(F.col("zeros"), F.col("ones")))
        gap = F.col("children") - F.col("own")
        level = written(above.select(
            "node", "zeros", "ones", ((F.col("ones") + 0.5) / (F.col("zeros") + F.col("ones") + 1)).alias("p1"),
            (F.greatest("own", "children") + F.log1p(F.exp(-F.abs(gap))) - float(np.log(2))).alias("weighted"),
            (1 / (1 + F.exp(F.least(gap, F.lit(700.0))))).alias("share")))
        levels.append(level)
    levels.reverse()
    mixed = levels[0].select("node", (F.col("share") * F.col("p1")).alias("done"), (1 - F.col("share")).alias("left"))
    for depth in range(1, split):
        down = levels[depth].select("node", "share", "p1", parent(F.col("node"), depth).alias("up"))
        above = mixed.select(F.col("node").alias("up"), F.col("done").alias("d"), F.col("left").alias("l"))
        mixed = down.join(above, "up").select(
            "node", (F.col("d") + F.col("l") * F.col("share") * F.col("p1")).alias("done"), (F.col("l") * (1 - F.col("share"))).alias("left"))
    return (tops.select("bucket", "node", parent(F.col("node"), split).alias("up"))
            .join(mixed.select(F.col("node").alias("up"), "done", "left"), "up").select("bucket", "node", "done", "left"))


def score_chunk(rows: pd.DataFrame, answers: pd.DataFrame, n_buckets: int, depth: int, tokens: int, distinct: int, ends: int) -> pd.DataFrame:
    ids, texts, held = opened(rows["payload"].iloc[0])
    got = {(k, b): v for k, b, v in zip(answers["kind"], answers["bucket"], answers["values"])}

    def values(keys, kind, dtype):
        order, parts = in_buckets(keys, kind, n_buckets, depth)
        out = np.zeros(len(keys), dtype)
        for b, i, j in parts:
            out[order[i:j]] = unpack(got[kind, b], dtype)
        return out

    numbers: dict[bytes, int] = {}
    own = []
    for text in texts:
        words = text.split()
        own.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int32, len(words)))
    c = values(np.fromiter(map(word_key, numbers), np.int64, len(numbers)), WORD, "<i8")
    del numbers
    total = float(tokens + distinct + 1)
    logc, known = np.log10((c + 1) / total), c > 0
    end_log = float(np.log10((ends + 1) / total))
    n_tokens, n_known = [len(i) + 1 for i in own], [int(known[i].sum()) + (ends > 0) for i in own]
    base = [float(logc[i].sum()) + end_log for i in own]
    coded = list(chunk_grams(texts, depth))
    keys = np.unique(np.concatenate([unique for _, _, _, unique, _ in coded]))
    logs = values(keys, GRAM, "<f8")
    score = np.zeros(len(texts))
    for first, last, number, unique, stops in coded:
        score[first:last] = np.add.reduceat(logs[np.searchsorted(keys, unique)][number], np.concatenate([[0], stops[:-1]]))
    sizes = np.array([len(t) + 1 for t in texts])
    return pd.DataFrame({
        "doc_id": ids.to_pandas(), "held_out": held, "n_tokens": n_tokens, "n_known": n_known, "train_tokens": tokens,
        "base_score": base, "score": score, "bits_per_byte": -score / LOG10_OF_2 / sizes})


def scored(docs: DataFrame, held_out=None, depth: int = DEPTH, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score,
    bits_per_byte) of every row.

    held_out: boolean column of docs; rows where it is true are scored only. Default:
    crc32(doc_id as text) mod 7 = 2. depth: bytes of context, 1 to MAX_DEPTH. Texts are
    lower-cased (A-Z) and scored with an end sign. Defined cases: a null or empty text is
    the end sign alone; a null doc_id is treated as the empty text in the fold rule and
    stays null; repeated rows train and score each; a text longer than chunk_bytes is a
    chunk of its own; other columns are not read, whatever their names; with no training
    rows all estimates are 1/2; an empty table gives no rows.
    """
    if not 1 <= depth <= MAX_DEPTH:
        raise ValueError(f"depth must be 1 to {MAX_DEPTH}")
    ship(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    if held_out is None:
        held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"), held_out.alias("held_out"))
    ends = rows.where("NOT held_out").count()
    payloads = written(chunks(rows, chunk_bytes))
    size = payloads.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    n_buckets = max(1, -(-size // bucket_bytes))
    asked = written(requests(payloads, n_buckets, depth))
    of_words = written(asked.where(F.col("kind") == WORD).groupBy("bucket").applyInPandas(
        word_answers, "chunk long, kind int, bucket long, values binary, seen long, distinct long"))
    seen, distinct = of_words.agg(F.coalesce(F.sum("seen"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    tokens, distinct = seen + ends, distinct + (ends > 0)
    free_shuffles(docs.sparkSession)
    grams = asked.where(F.col("kind") == GRAM)
    tops = written(grams.groupBy("bucket").applyInPandas(
        lambda r: top_nodes(r, depth), "bucket long, node long, zeros double, ones double, weighted double"))
    mixed = written(mixed_above(tops, min(SPLIT, depth)))
    free_shuffles(docs.sparkSession)
    of_grams = grams.groupBy("bucket").cogroup(mixed.groupBy("bucket")).applyInPandas(
        lambda r, t: gram_answers(r, t, depth), "chunk long, kind int, bucket long, values binary")
    answers = of_words.select("chunk", "kind", "bucket", "values").unionByName(of_grams)
    return payloads.select("chunk", "payload").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(
        lambda left, right: score_chunk(left, right, n_buckets, depth, tokens, distinct, ends),
        f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")


def op7_context_tree_weighting(spark, sf_dir: str) -> DataFrame:
    return scored(read(spark, sf_dir, "documents"))
