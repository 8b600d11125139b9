"""Chapter-number analysis as windows over (group columns, idx, number)."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bookloom.runtime import dealt, in_groups, ship, whole_groups


def missing_ranges(numbers: DataFrame, group: list[str], mode: str = "middle") -> DataFrame:
    """(group, first_missing, last_missing) between present numbers; mode "from_one" also
    looks before the first, "continue" before the first down to the previous group's
    last (groups ordered by their last group column within the ones before)."""
    distinct = numbers.select(*group, "number").distinct()
    order = Window.partitionBy(*group).orderBy("number")
    before = F.lag("number").over(order)
    if mode == "from_one":
        before = F.coalesce(before, F.lit(0))
    rows = distinct.withColumn("_before", before)
    if mode == "continue":
        ends = distinct.groupBy(*group).agg(F.max("number").alias("_last"))
        if len(group) < 2:
            raise ValueError("the groups of one work can be continued: give the work's column first")
        by_group = Window.partitionBy(*group[:-1]).orderBy(group[-1])
        ends = ends.withColumn("_previous", F.lag("_last").over(by_group)).select(*group, "_previous")
        rows = rows.join(ends, group).withColumn("_before", F.coalesce("_before", F.when(F.col("_previous") < F.col("number"), F.col("_previous"))))
    return rows.where(F.col("number") - F.col("_before") > 1).select(
        *group, (F.col("_before") + 1).alias("first_missing"), (F.col("number") - 1).alias("last_missing"))


def segments(numbers: DataFrame, group: list[str]) -> DataFrame:
    """numbers with `segment`: a new one starts at a number of at most 2, at least 3
    below its predecessor, followed by its successor number or by nothing."""
    order = Window.partitionBy(*group).orderBy("idx")
    back, ahead = F.lag("number").over(order), F.lead("number").over(order)
    restart = (F.col("number") <= 2) & (back >= F.col("number") + 3) & (ahead.isNull() | (ahead == F.col("number") + 1))
    return numbers.withColumn("_restart", F.when(restart, 1).otherwise(0)).withColumn("segment", F.sum("_restart").over(order)).drop("_restart")


def duplicates(segmented: DataFrame, group: list[str]) -> DataFrame:
    return segmented.groupBy(*group, "segment", "number").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def compact_ranges(numbers: DataFrame, group: list[str]) -> DataFrame:
    """(group, ranges): distinct numbers as "1–3、7"."""
    # a fixed number of parts, as Spark would make few large ones of these few bytes
    distinct = dealt(numbers.select(*group, "number").distinct(), *group)
    island = distinct.withColumn("_island", F.col("number") - F.row_number().over(Window.partitionBy(*group).orderBy("number")))
    runs = island.groupBy(*group, "_island").agg(F.min("number").alias("lo"), F.max("number").alias("hi"))
    rows = runs.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("runs"))
    text = lambda r: F.when(r["lo"] == r["hi"], r["lo"].cast("string")).otherwise(F.concat(r["lo"].cast("string"), F.lit("–"), r["hi"].cast("string")))
    return rows.select(*group, F.array_join(F.transform("runs", text), "、").alias("ranges"))


def isolated_typos(numbers: DataFrame, group: list[str]) -> DataFrame:
    """(group, idx, number, guess): single numbers out of place between neighbours that
    are two apart."""
    order = Window.partitionBy(*group).orderBy("idx")
    rows = numbers.withColumns({"_back": F.lag("number").over(order), "_ahead": F.lead("number").over(order)})
    return rows.where((F.col("_ahead") == F.col("_back") + 2) & (F.col("number") != F.col("_back") + 1)).select(
        *group, "idx", "number", (F.col("_back") + 1).alias("guess"))


def renumbered(titles: DataFrame, group: list[str]) -> DataFrame:
    """titles with new_number: consecutive from the first title's number."""
    order = Window.partitionBy(*group).orderBy("idx")
    return titles.withColumn("new_number", F.first("number").over(order) + F.row_number().over(order) - 1)


def length_report(sections: DataFrame, group: list[str]) -> DataFrame:
    """sections (group, n_chars) with the group's median of non-empty sections and a
    flag: empty, short (under 0.3 x median), long (over 3 x) or fine."""
    median = sections.where("n_chars > 0").groupBy(*group).agg(F.median("n_chars").alias("median"))
    joined = sections.join(median, group, "left")
    n, m = F.col("n_chars"), F.col("median")
    return joined.withColumn("flag", F.when(n == 0, "empty").when(n * 10 < m * 3, "short").when(n > m * 3, "long").otherwise("fine"))


def longest_increasing(values: list[int]) -> list[int]:
    """Indexes of a longest strictly increasing subsequence."""
    from bisect import bisect_left

    tails: list[int] = []
    last: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        if k == len(tails):
            tails.append(v)
            last.append(i)
        else:
            tails[k], last[k] = v, i
        back[i] = last[k - 1] if k else -1
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def misplaced(numbers: DataFrame, group: list[str]) -> DataFrame:
    """(group, idx, number): numbers outside a longest increasing run that covers at
    least half of the group. A group's numbers go to one task: use it on books."""
    ship(numbers.sparkSession)

    def leftovers(batches):
        for table, spans in whole_groups(batches):
            found, left = [math.nan if x is None else x for x in table["number"].to_pylist()], []
            for a, b in spans:
                kept = longest_increasing(found[a:b])
                if 2 * len(kept) >= b - a:
                    left += sorted(set(range(a, b)) - {a + i for i in kept})
            yield from table.drop_columns("_nth").take(pa.array(left, pa.int64())).to_batches()

    rows = numbers.select(*group, "idx", "number")
    return in_groups(rows, group, [F.col("idx").asc_nulls_last()]).mapInArrow(leftovers, rows.schema)
