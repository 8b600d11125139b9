"""Which chapters of a newer version are which of the edited one.

Keys that stand once on both sides are anchors; the longest run of them that rises on both
sides cuts the two lists into gaps. In a gap the longest common subsequence is paired, and
between its pairs chapters with the same loose key (another name, same kind and number),
in order and without crossing. Anchors meet by a join; what a task gets of a book is the
places of its anchors, or the keys of one gap."""

from __future__ import annotations

from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bookloom.runtime import checkpointed, in_groups, ship, whole_groups


def longest_rise(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence that rises strictly in the second place, of pairs in order of
    the first; pairs with one first place stand with falling second places."""
    tails, ends, before = [], [], [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        at = bisect_left(tails, b)
        before[i] = ends[at - 1] if at else -1
        if at == len(tails):
            tails.append(b)
            ends.append(i)
        else:
            tails[at], ends[at] = b, i
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(pairs[i])
        i = before[i]
    return out[::-1]


def common(new: list, old: list) -> list[tuple[int, int]]:
    """Places (new, old) of a longest common subsequence."""
    where: dict = {}
    for j, key in enumerate(old):
        where.setdefault(key, []).append(j)
    return longest_rise([(i, j) for i, key in enumerate(new) for j in reversed(where.get(key, ()))])


def paired(new: list, old: list) -> list[tuple[int, int, str]]:
    """(new, old, how) of two short lists of (key, loose key or None)."""
    exact = common([k for k, _ in new], [k for k, _ in old])
    out, before = [(i, j, "same") for i, j in exact], (-1, -1)
    for i1, j1 in [*exact, (len(new), len(old))]:
        i0, j0 = before
        following = j0 + 1
        for i in range(i0 + 1, i1):
            loose = new[i][1]
            found = next((j for j in range(following, j1) if old[j][1] == loose), None) if loose is not None else None
            if found is not None:
                out.append((i, found, "loose"))
                following = found + 1
        before = (i1, j1)
    return sorted(out)


def aligned(old: DataFrame, new: DataFrame, book: str = "doc_id") -> DataFrame:
    """(book, new_idx, old_idx, how): same, where the keys agree, or loose. old and new
    (book, idx, key, loose): idx a long, unique within the book; a null key meets nothing, nor
    does a null loose key. Books on one side only and empty tables give no rows."""
    ship(old.sparkSession)
    sides = {"old": old, "new": new}
    once = {n: t.where("key IS NOT NULL").groupBy(book, "key").agg(F.min("idx").alias(n), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n") for n, t in sides.items()}
    anchors = once["new"].join(once["old"], [book, "key"]).select(book, "new", "old")
    kind = old.schema[book].dataType.simpleString()

    def rise(batches):
        for table, spans in whole_groups(batches):
            new, old, kept, at = table["new"].to_pylist(), table["old"].to_pylist(), [], []
            for a, b in spans:
                some = longest_rise(list(zip(new[a:b], old[a:b], strict=True)))
                kept += some
                at += [a] * len(some)
            yield pa.RecordBatch.from_arrays([table[book].combine_chunks().take(pa.array(at, pa.int64())), pa.array([a for a, _ in kept], pa.int64()), pa.array([b for _, b in kept], pa.int64())], [book, "new", "old"])

    kept = checkpointed(in_groups(anchors, [book], [F.col("new"), F.col("old")]).mapInArrow(rise, f"{book} {kind}, new long, old long"))  # read three times
    order = Window.partitionBy(book).orderBy("idx")

    def gaps(name):
        at = kept.select(book, F.col(name).alias("idx"), F.lit(1).alias("_anchor"))
        rows = sides[name].select(book, "idx", F.col("key").cast("string").alias("key"), F.col("loose").cast("string").alias("loose")).join(at, [book, "idx"], "left")
        return rows.withColumn("gap", F.coalesce(F.sum("_anchor").over(order), F.lit(0))).where("_anchor IS NULL").select(
            *[F.col(c).alias(c) for c in (book, "gap", "idx", "key", "loose")])  # attributes of its own, should both sides be one table

    def pair(batches):
        for table, spans in whole_groups(batches):
            side, idx, key, loose = (table[c].to_pylist() for c in ("side", "idx", "key", "loose"))
            # null keys differ from each other
            told = [(k if k is not None else (i,), x) for i, (k, x) in enumerate(zip(key, loose, strict=True))]
            out = []
            for a, b in spans:
                middle = a + sum(side[a:b])
                if a < middle < b:
                    out += [(a, idx[a + i], idx[middle + j], how) for i, j, how in paired(told[a:middle], told[middle:b])]
            at, new_idx, old_idx, hows = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([table[book].combine_chunks().take(pa.array(at, pa.int64())), pa.array(new_idx, pa.int64()), pa.array(old_idx, pa.int64()), pa.array(hows, pa.string())], [book, "new_idx", "old_idx", "how"])

    # side: 1 of new rows, which come first
    both = gaps("new").withColumn("side", F.lit(1)).unionByName(gaps("old").withColumn("side", F.lit(0)))
    rest = in_groups(both, [book, "gap"], [F.col("side").desc(), F.col("idx")]).mapInArrow(pair, f"{book} {kind}, new_idx long, old_idx long, how string")
    return kept.select(book, F.col("new").alias("new_idx"), F.col("old").alias("old_idx"), F.lit("same").alias("how")).unionByName(rest)


LONGER_SHARE, LONGER_CHARS = 1.2, 300


def plan(old: DataFrame, new: DataFrame, pairs: DataFrame, book: str = "doc_id") -> DataFrame:
    """A row for each new chapter: status same, longer (by a fifth and LONGER_CHARS Chinese
    characters), missing (goes behind old chapter `position`) or new (behind the last), and
    suggested. old and new (book, idx, n_han); pairs of aligned()."""
    both = (new.select(book, F.col("idx").alias("new_idx"), F.col("n_han").alias("new_han")).join(pairs.select(book, "new_idx", F.col("old_idx").alias("body_idx")), [book, "new_idx"], "left")
            .join(old.select(book, F.col("idx").alias("body_idx"), F.col("n_han").alias("body_han")), [book, "body_idx"], "left"))
    order = Window.partitionBy(book).orderBy("new_idx")
    before = F.max("body_idx").over(order.rowsBetween(Window.unboundedPreceding, 0))
    later = F.min("body_idx").over(order.rowsBetween(1, Window.unboundedFollowing))
    longer = (F.col("new_han") >= F.col("body_han") * LONGER_SHARE) & (F.col("new_han") >= F.col("body_han") + LONGER_CHARS)
    status = F.when(F.col("body_idx").isNotNull(), F.when(longer, "longer").otherwise("same")).when(later.isNull(), "new").otherwise("missing")
    rows = both.withColumns({"position": before, "status": status})
    return rows.select(book, "new_idx", "body_idx", "new_han", "body_han", "position", "status", (F.col("status") != "same").alias("suggested"))
