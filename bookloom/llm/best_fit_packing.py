"""Tokenise documents and pack them into fixed-length training sequences.

Documents are tokenised where they lie; only piece lengths travel on. Pieces are dealt
by hash into buckets of about BUCKET_PIECES, and each bucket is packed by best-fit
decreasing: a segment tree over remaining capacities finds the tightest open bin in
O(log length) per piece. A bucket leaves at most a few sequences part empty, so the loss
against one global packing is a few sequences in thousands.
"""

from __future__ import annotations

import zlib
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookloom.llm.shared import read, written
from bookloom.runtime import ship

SEQUENCE_TOKENS = 4096
END_ID = 1
END = END_ID.to_bytes(4, "little")
BUCKET_PIECES = 16_384
#: Words whose ids a Python worker remembers; then it starts over. Speed only.
CACHED_WORDS = 1_000_000
#: Words tokenised in one call.
CALL_WORDS = 8192
#: Texts whose ids must be those of their words, or the tokenizer is refused.
PROBES = ("one Two\n three,four  5.6\t(seven) ", " a b\r\nc", "\u00e9t\u00e9 \u65e5\u672c \u0928\u092e x")
#: Bytes of text handled at once.
BLOCK_BYTES = 4 << 20


class WordIds(dict):
    """Word (bytes) to its number; token ids of numbered words lie in flat arrays.

    The tokenizer drops white space and never joins characters across it, so the ids of
    a text are the ids of its words in order.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        ids = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        for text in PROBES:
            if ids(text) != [x for w in text.split() for x in ids(w)]:
                raise ValueError(f"{path}: the ids of a text are not those of its words in order")
        self.special = [x.content.encode().lower() for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.folds = ids(PROBES[0]) == ids(PROBES[0].lower())  # A-Z can be folded before words are looked up
        self.clear_all()

    def clear_all(self):
        self.clear()
        self.new: list[bytes] = []
        self.ids = np.empty(1 << 16, np.uint32)
        self.starts, self.sizes = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.filled = 0

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n

    def _room(self, array, n):
        return array if n <= len(array) else np.concatenate([array, np.zeros(max(n - len(array), len(array)), array.dtype)])

    def encode_new(self):
        first, words = len(self) - len(self.new), self.new
        self.starts, self.sizes = self._room(self.starts, len(self)), self._room(self.sizes, len(self))
        for i in range(0, len(words), CALL_WORDS):
            # one text of many words takes half the time of as many texts; offsets say whose a token is
            part = [w.decode("utf-8") for w in words[i:i + CALL_WORDS]]
            found = self.tokenizer.encode("\n".join(part), add_special_tokens=False)
            flat = np.array(found.ids, np.uint32)
            places = np.fromiter((start for start, _ in found.offsets), np.int64, len(flat))
            ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)
            sizes = np.bincount(np.searchsorted(ends, places, side="right"), minlength=len(part))
            self.ids = self._room(self.ids, self.filled + len(flat))
            self.ids[self.filled:self.filled + len(flat)] = flat
            at = first + i
            self.sizes[at:at + len(part)] = sizes
            self.starts[at:at + len(part)] = self.filled + np.cumsum(sizes) - sizes
            self.filled += len(flat)
        self.new = []

    def folded(self, text: bytes) -> bytes:
        """The text in lower case where that changes no id: it must not make special tokens."""
        if not self.folds:
            return text
        low = text.lower()
        return text if any(x in low for x in self.special) else low

    def tokens(self, texts: list[bytes]):
        """(ids, ends): the token ids of all texts one behind the other, and where each ends."""
        if len(self) > CACHED_WORDS:
            self.clear_all()
        split = [self.folded(t).split() for t in texts]
        numbers = np.fromiter(map(self.__getitem__, chain.from_iterable(split)), np.int64)
        self.encode_new()
        sizes = self.sizes[numbers]
        word_ends = np.cumsum(sizes)
        ids = self.ids[np.repeat(self.starts[numbers] - (word_ends - sizes), sizes) + np.arange(int(sizes.sum()))]
        last = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))
        return ids.astype("<u4", copy=False), np.concatenate([[0], word_ends])[last]


_WORKER: dict[str, WordIds] = {}


def worker_ids(path: str) -> WordIds:
    """One per Python worker, kept between tasks."""
    if path not in _WORKER:
        _WORKER[path] = WordIds(path)
    return _WORKER[path]


def blocks(texts: list, most: int = BLOCK_BYTES):
    """(first, last) of runs of texts of about `most` bytes."""
    first = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, tokenizer_path: str | None = None, length: int = SEQUENCE_TOKENS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, _salt) of every document.

    tokenizer_path: a file every executor can read; None: the installed public one,
    looked up on each executor. _salt tells apart rows that repeat.
    """
    ship(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]

    def of_batches(batches):
        words, row = worker_ids(tokenizer_path or default_tokenizer()), 0
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.binary()).to_pylist()
            texts = [t or b"" for t in texts]
            for first, last in blocks(texts):
                which, piece, start, size, crc, salt = [], [], [], [], [], []
                flat, ends = words.tokens(texts[first:last])
                data, at = memoryview(flat).cast("B"), 0
                for i, end in enumerate(ends.tolist(), first):
                    total = end - at + 1  # with the end id
                    for p, s in enumerate(range(0, total, length)):
                        stop = min(s + length, total)
                        sum_ = zlib.crc32(data[4 * (at + s):4 * min(at + stop, end)])
                        which.append(i)
                        piece.append(p)
                        start.append(s)
                        size.append(stop - s)
                        crc.append(zlib.crc32(END, sum_) if stop == total else sum_)
                        salt.append(row + i)
                    at = end
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(which, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, size, crc, salt))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "_salt"])
            row += len(texts)

    return docs.select("doc_id", "text").mapInArrow(
        of_batches, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, _salt long")


class TightestBin:
    """Open bins by remaining capacity: a segment tree whose leaves are capacities."""

    def __init__(self, capacity: int):
        self.base = 1
        while self.base <= capacity:
            self.base *= 2
        self.tree = [0] * (2 * self.base)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, remaining: int, number: int) -> None:
        if not remaining:
            return
        self.bins[remaining].append(number)
        i = self.base + remaining
        while i and not self.tree[i]:
            self.tree[i] = 1
            i //= 2

    def take(self, size: int):
        """(remaining, number) of the tightest bin that holds size, or None."""
        tree, i = self.tree, self.base + size
        if not tree[i]:
            while i > 1 and (i & 1 or not tree[i + 1]):
                i //= 2
            if i <= 1:
                return None
            i += 1
            while i < self.base:
                i = 2 * i if tree[2 * i] else 2 * i + 1
        remaining = i - self.base
        number = self.bins[remaining].pop()
        while i and not (self.bins[remaining] if i >= self.base else tree[2 * i] or tree[2 * i + 1]):
            tree[i] = 0
            i //= 2
        return remaining, number


def best_fit_decreasing(sizes, capacity: int = SEQUENCE_TOKENS):
    """(bin, offset) arrays for sizes (each 1..capacity), placed largest first."""
    sizes = np.asarray(sizes, np.int64)
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    opened, n = TightestBin(capacity), 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        found = opened.take(size) if size < capacity else None
        if found is None:
            found, n = (capacity, n), n + 1
        remaining, number = found
        bins[i], offsets[i] = number, capacity - remaining
        opened.add(remaining - size, number)
    return bins, offsets


def packed(docs: DataFrame, tokenizer_path: str | None = None, length: int = SEQUENCE_TOKENS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece.

    Defined cases: a null or empty text is one piece of the end id alone; longer
    documents than a sequence are cut into full pieces and a rest; repeated rows are
    packed each; a null doc_id stays null; other columns are not read, whatever their
    names; an empty table gives no rows.
    """
    found = written(pieces(docs, tokenizer_path, length))
    n_buckets = max(1, -(-found.count() // BUCKET_PIECES))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "piece", "_salt"], kind="stable").reset_index(drop=True)
        bins, offsets = best_fit_decreasing(rows["length"].to_numpy(), length)
        rows["sequence_id"], rows["offset"] = (rows["bucket"].to_numpy(np.int64) << 32) + bins, offsets
        return rows[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    kind = dict(docs.dtypes)["doc_id"]
    return (found.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "_salt"), F.lit(n_buckets)).cast("long"))
            .groupBy("bucket").applyInPandas(
                pack, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"))


def op6_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return packed(read(spark, sf_dir, "documents"))
