"""Table of contents from lines: headings, parents, records, export sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bookloom.functions.chars import char_count
from bookloom.functions.headings import end_mark, may_be_heading, parts
from bookloom.runtime import dealt


def classified(lines: DataFrame) -> DataFrame:
    """lines with kind, number_text, unit, number and name."""
    return lines.withColumns(parts(F.col("text")))


def toc(lines: DataFrame) -> DataFrame:
    """(doc_id, row, kind, unit, number, name, parent_row, ord) of headings. A chapter's
    parent is the last volume, unless that volume's end mark stands between."""
    # the patterns are dear and most lines are text, which takes no part below
    rows = classified(dealt(lines.where(may_be_heading(F.col("text"))), "doc_id")).withColumn("_end", end_mark(F.col("text")))
    by_row = Window.partitionBy("doc_id").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    volume = F.last(F.when(F.col("kind") == "volume", F.col("row")).when(F.col("_end"), F.lit(-1)), ignorenulls=True).over(by_row)
    placed = rows.withColumn("_volume", volume).where("kind <> 'body' AND NOT _end")
    parent = F.when((F.col("kind") != "volume") & (F.col("_volume") >= 0), F.col("_volume"))
    order = Window.partitionBy("doc_id").orderBy("row")
    return placed.select("doc_id", "row", "kind", "unit", "number", "name", parent.alias("parent_row"), (F.row_number().over(order) - 1).cast("long").alias("ord"))


def _sectioned(lines: DataFrame, titles: DataFrame) -> DataFrame:
    """sections() with _t, null but in the rows of titles."""
    marked = lines.join(titles.select("doc_id", "row", F.lit(1).alias("_t")), ["doc_id", "row"], "left")
    by_row = Window.partitionBy("doc_id").orderBy("row")
    n = F.sum(F.coalesce("_t", F.lit(0))).over(by_row)
    return marked.withColumn("section", F.greatest(n - 1, F.lit(0)).cast("long"))


def sections(lines: DataFrame, titles: DataFrame) -> DataFrame:
    """lines with `section`: 0, 1, ... from title to title; what stands before the first
    title belongs to the first section."""
    return _sectioned(lines, titles).drop("_t")


def section_sizes(lines: DataFrame, titles: DataFrame) -> DataFrame:
    """(doc_id, section, n_lines, n_chars) without the title rows' characters."""
    chars = F.when(F.col("_t").isNotNull(), 0).otherwise(char_count(F.col("text")))
    return _sectioned(lines, titles).groupBy("doc_id", "section").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(chars).alias("n_chars"))


def section_texts(lines: DataFrame, titles: DataFrame) -> DataFrame:
    """(doc_id, section, text) with trailing blank lines cut."""
    rows = sections(lines, titles).groupBy("doc_id", "section").agg(F.array_sort(F.collect_list(F.struct("row", "text"))).alias("rows"))
    text = F.array_join(F.transform("rows", lambda r: r["text"]), "\n")
    return rows.select("doc_id", "section", F.regexp_replace(text, "[ \t\n　]+$", "").alias("text"))


def file_names(titles: DataFrame) -> DataFrame:
    """titles (doc_id, row, text) with `file`: 0001 and a safe name."""
    order = Window.partitionBy("doc_id").orderBy("row")
    n = F.row_number().over(order).cast("string")
    safe = F.substring(F.trim(F.regexp_replace("text", r'[\\/:*?"<>|]', "_")), 1, 80)
    return titles.withColumn("file", F.concat(F.lpad(n, F.greatest(F.lit(4), F.length(n)), F.lit("0")), F.lit(" "), F.when(safe == "", "untitled").otherwise(safe), F.lit(".txt")))


def section_ranges(titles: DataFrame) -> DataFrame:
    """titles (doc_id, row, level) with `stop`: the next row of the same or a higher
    level (null at the end)."""
    order = Window.partitionBy("doc_id").orderBy("row").rowsBetween(1, Window.unboundedFollowing)
    stops = [F.min(F.when(F.col("level") <= k, F.col("row"))).over(order) for k in (1, 2, 3)]
    return titles.withColumn("stop", F.when(F.col("level") == 1, stops[0]).when(F.col("level") == 2, stops[1]).otherwise(stops[2]))


def missed_titles(lines: DataFrame, titles: DataFrame) -> DataFrame:
    """Heading lines that the given contents lack, with the reason."""
    from bookloom.functions.chars import clean
    from bookloom.functions.headings import FORBIDDEN_TAILS, TITLE_LIMIT, marker

    looks = clean(F.col("text")).rlike("^第[^ 　]{1,10}[章回節卷部]")
    rest = lines.where(looks).join(titles.select("doc_id", "row"), ["doc_id", "row"], "left_anti")
    reason = F.when(marker(F.col("text")) == "exclude", "excluded").when(F.length("text") > TITLE_LIMIT, "too_long").when(
        F.col("text").rlike(f"[{FORBIDDEN_TAILS}]$"), "tail").otherwise("unrecognised")
    return rest.select("doc_id", "row", reason.alias("reason"))
