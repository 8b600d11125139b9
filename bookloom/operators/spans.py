"""Row spans (doc_id, start, end), both ends inclusive."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merged(spans: DataFrame, touching: bool = True) -> DataFrame:
    """Overlapping (and, by default, touching) spans of a document as one."""
    order = Window.partitionBy("doc_id").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("start") > F.coalesce(reach, F.lit(-2)) + (1 if touching else 0), 1).otherwise(0)
    island = spans.withColumn("_new", new).withColumn("_island", F.sum("_new").over(order))
    return island.groupBy("doc_id", "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def clipped(spans: DataFrame, ranges: DataFrame) -> DataFrame:
    """Parts of spans that lie in ranges; one span may give several."""
    other = ranges.select("doc_id", F.col("start").alias("_from"), F.col("end").alias("_to"))
    met = spans.join(other, "doc_id").where((F.col("start") <= F.col("_to")) & (F.col("end") >= F.col("_from")))
    return met.withColumn("start", F.greatest("start", "_from")).withColumn("end", F.least("end", "_to")).drop("_from", "_to")


def without_rows(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """lines without the rows in spans, numbered anew; src_row is the old number. Spans
    become rows first, so that this is an equality join."""
    gone = spans.select("doc_id", F.explode(F.sequence("start", "end")).alias("row")).distinct()
    return renumbered(lines.join(gone, ["doc_id", "row"], "left_anti"))


def renumbered(lines: DataFrame, *order: str) -> DataFrame:
    by = Window.partitionBy("doc_id").orderBy(*(order or ("row",)))
    return lines.withColumn("src_row", F.col("row")).withColumn("row", (F.row_number().over(by) - 1).cast("long"))


def replaced(lines: DataFrame, fixes: DataFrame) -> DataFrame:
    """lines with the text of fixes (doc_id, row, before, fix) where the row still reads
    `before`; a fix of several lines is split and rows are numbered anew."""
    both = lines.join(fixes, ["doc_id", "row"], "left")
    text = F.when(F.col("before") == F.col("text"), F.col("fix")).otherwise(F.col("text"))
    parts = both.select("doc_id", "row", F.posexplode(F.split(text, "\n", -1)).alias("part", "text"))
    return renumbered(parts, "row", "part").drop("part")


def moved(lines: DataFrame, moves: DataFrame) -> DataFrame:
    """Blocks of moves (doc_id, start, end, before) put before another row, in their own
    order; rows are numbered anew."""
    blocks = moves.select("doc_id", F.explode(F.sequence("start", "end")).alias("row"), F.col("before"))
    placed = lines.join(blocks, ["doc_id", "row"], "left").withColumns({
        "_at": F.coalesce("before", "row"), "_late": F.when(F.col("before").isNull(), 1).otherwise(0)})
    return renumbered(placed, "_at", "_late", "row").drop("_at", "_late", "before")
