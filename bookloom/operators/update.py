"""Merging a newer version of a book into an edited one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LONGER_SHARE, LONGER_CHARS = 1.2, 300


def plan(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old and new (key, idx, n_chars), key unique within each and its first column the
    book's: a row per new chapter
    with status same, longer (worth taking), missing (belongs after old chapter
    `position`) or new (behind the last), and suggested."""
    left = old.select(*key, F.col("idx").alias("body_idx"), F.col("n_chars").alias("body_chars"))
    both = new.withColumnRenamed("idx", "new_idx").withColumnRenamed("n_chars", "new_chars").join(left, key, "left")
    if len(key) < 2:
        raise ValueError("the key needs the book's column in front of the chapter's")
    order = Window.partitionBy(*key[:-1]).orderBy("new_idx")
    before = F.last("body_idx", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    later = F.first("body_idx", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    longer = (F.col("new_chars") >= F.col("body_chars") * LONGER_SHARE) & (F.col("new_chars") >= F.col("body_chars") + LONGER_CHARS)
    rows = both.withColumns({"position": before, "_later": later})
    status = F.when(F.col("body_idx").isNotNull(), F.when(longer, "longer").otherwise("same")).when(F.col("_later").isNull(), "new").otherwise("missing")
    return rows.withColumn("status", status).withColumn("suggested", F.col("status") != "same").drop("_later")


def applied(old_lines: DataFrame, new_lines: DataFrame, accepted: DataFrame) -> DataFrame:
    """Lines of the merged book. old_lines and new_lines (doc_id, chapter, row, text);
    accepted (doc_id, new_idx, status, body_idx, position): longer bodies take the place
    of the old chapter, missing and new chapters follow old chapter `position`."""
    taken = accepted.where("status = 'longer'").select("doc_id", F.col("body_idx").alias("chapter"))
    stays = old_lines.join(taken, ["doc_id", "chapter"], "left_anti").select(
        "doc_id", F.col("chapter").alias("at"), F.lit(-1).cast("long").alias("seq"), "row", "text")
    place = accepted.where("status <> 'same'").select("doc_id", F.col("new_idx").alias("chapter"), F.when(F.col("status") == "longer", F.col("body_idx")).otherwise(
        F.coalesce("position", F.lit(-1))).alias("at"), F.when(F.col("status") == "longer", -1).otherwise(F.col("new_idx")).cast("long").alias("seq"))
    comes = new_lines.join(place, ["doc_id", "chapter"]).select("doc_id", "at", "seq", "row", "text")
    order = Window.partitionBy("doc_id").orderBy("at", "seq", "row")
    return stays.unionByName(comes).select("doc_id", (F.row_number().over(order) - 1).cast("long").alias("row"), "text")


def appended(old_lines: DataFrame, new_lines: DataFrame) -> DataFrame:
    """new_lines behind old_lines of the same document."""
    size = old_lines.groupBy("doc_id").agg((F.max("row") + 1).alias("_n"))
    rest = new_lines.join(size, "doc_id", "left").withColumn("row", F.col("row") + F.coalesce("_n", F.lit(0))).drop("_n")
    return old_lines.unionByName(rest)
