"""SimHash near-duplicates by multi-index hashing.

A 64-bit fingerprint is cut into two 32-bit segments. Two fingerprints that differ in
at most three bits differ in at most one bit of some segment, so each fingerprint looks
up the Hamming ball of radius one (33 values) around each of its segments in a table of
exact segment values, and every match is verified by its complete distance. Equal
fingerprints are one entry of that table however many documents share them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookloom.llm.shared import attach, components, read, shuffled, written
from bookloom.runtime import ship

SHINGLE_WORDS = 3
SEED = 42
MAX_DISTANCE = 3
SEGMENT_BITS = 32
#: Shingles whose bits are counted at once, so that a long text takes bounded memory.
BLOCK = 1 << 16


def fingerprint(text: str | None) -> int:
    """Fingerprint of a text, unsigned. Null, empty and blank texts: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) < SHINGLE_WORDS:
        starts, ends = starts[:1], ends[-1:]
    else:
        starts, ends = starts[: len(words) - SHINGLE_WORDS + 1], ends[SHINGLE_WORDS - 1:]
    starts, ends, digest = starts.tolist(), ends.tolist(), xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for i in range(0, len(starts), BLOCK):
        part = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[i:i + BLOCK], ends[i:i + BLOCK])], dtype="<u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of every row; fp is the fingerprint as a signed long."""
    ship(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]

    def of_batches(batches):
        for batch in batches:
            prints = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=[id_col, "fp"])

    return docs.select(id_col, text_col).mapInArrow(of_batches, f"`{id_col}` {kind}, fp long")


def links(distinct: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """Pairs (a, b) of `rep` of different fingerprints within max_distance (at most 3).
    distinct: (fp, rep), one row per fingerprint."""
    if not 0 <= max_distance <= 3:
        raise ValueError("two segments with balls of radius one cover distances up to 3")
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("fp", SEGMENT_BITS)
    second = F.lit(1 << SEGMENT_BITS)  # keeps the two tables apart
    table = distinct.select(F.col("fp").alias("fp2"), F.col("rep").alias("rep2"),
                            F.explode(F.array(low, high.bitwiseOR(second))).alias("segment"))
    flips = F.array(F.lit(0), *[F.lit(1 << i) for i in range(SEGMENT_BITS)])
    probes = (distinct.withColumn("own", F.explode(F.array(low, high.bitwiseOR(second))))
              .withColumn("flip", F.explode(flips))
              .select("fp", "rep", F.col("own").bitwiseXOR(F.col("flip")).alias("segment")))
    near = (F.col("fp") < F.col("fp2")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= max_distance)
    return (probes.join(shuffled(table), "segment").where(near)
            .select(F.col("rep").alias("a"), F.col("rep2").alias("b")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(id, fp, component): component is the smallest id reachable over links of at
    most max_distance differing bits, the row's own id where there is none.

    Defined cases: null, empty and blank texts have fingerprint 0 and link like any
    other; texts of one or two words are one shingle; ids that repeat keep a row each;
    a null id keeps a row, links nothing and has a null component; other columns of docs are not
    read, whatever their names; an empty table gives no rows.
    """
    prints = written(fingerprints(docs, id_col, text_col).withColumnRenamed(id_col, "_id"))
    distinct = written(prints.where("_id IS NOT NULL").groupBy("fp").agg(
        F.min("_id").alias("rep"), F.count(F.lit(1)).alias("n")))
    n_rows = distinct.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = components(links(distinct.select("fp", "rep"), max_distance))
    named = distinct.join(shuffled(found), distinct.rep == found.node, "left").select(
        "fp", "n", F.coalesce("component", "rep").alias("component"))
    out = attach(prints.where("_id IS NOT NULL"), named, "fp", n_rows)
    orphans = prints.where("_id IS NULL").withColumn("component", F.lit(None).cast("long"))
    return out.unionByName(orphans).withColumnRenamed("_id", id_col)


def kept(docs: DataFrame) -> DataFrame:
    """docs without all but one document (the smallest doc_id) of each near-duplicate
    group; rows whose doc_id is null stay."""
    marks = near_duplicates(docs).where("doc_id IS NULL OR doc_id = component").select("doc_id").distinct()
    return docs.join(marks, docs.doc_id.eqNullSafe(marks.doc_id), "left_semi")


def op10_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        F.col("component").alias("component_id"))
