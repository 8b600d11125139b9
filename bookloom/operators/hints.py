"""What a table of contents seems to lack: volumes, chapters in a gap, chapters behind the
last one. And books whose paragraphs are cut into lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bookloom.functions.chars import clean
from bookloom.functions.rules import PRESETS, matched
from bookloom.operators.fixes import balanced, body_of

# Fixed values of the text format -------------------------------------
LEAST_VOLUMES, LEAST_IN_ORDER, VOLUME_CHARS = 3, 2, 30
LEAST_GAP, MOST_GAP, LEAST_CHAPTERS, LEAST_SPACING = 2, 500, 3, 15
TAIL_FOLLOWS, LONG_NAME, TAIL_ROWS, TAIL_SHARE = 3, 15, 200, 5
LEAST_PARAGRAPHS = 50
# ---------------------------------------------------------------------------------------


def missed_volumes(lines: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, n): books without a volume in their contents that have three lines or more such
    as 卷二 山路, at least two of them the number behind the one before."""
    rules = tuple(r for r in PRESETS if r.name == "leading_unit_volume")
    t = clean(F.col("text"))
    short = lines.where(t.rlike("^[卷部篇集]") & (F.length(t) <= VOLUME_CHARS)).select("doc_id", "row", matched(t, rules).alias("m"), t.alias("t"))
    rows = short.where("m IS NOT NULL").where(~F.col("t").rlike("第.{1,8}[章回節节]")).join(found.select("doc_id", "row").distinct(), ["doc_id", "row"], "left_anti")
    rows = rows.join(found.where("kind = 'volume'").select("doc_id").distinct(), "doc_id", "left_anti")
    order = Window.partitionBy("doc_id").orderBy("row")
    rows = rows.withColumn("_next", F.col("m.number") == F.lag("m.number").over(order) + 1)
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("_next").alias("_k")).where((F.col("n") >= LEAST_VOLUMES) & (F.col("_k") >= LEAST_IN_ORDER)).select("doc_id", "n")


def _numbered(found: DataFrame) -> DataFrame:
    value = F.coalesce(F.col("settled"), F.col("number")) if "settled" in found.columns else F.col("number")
    return found.where("kind = 'chapter'").select("doc_id", "row", value.alias("number")).where("number > 0")


def missed_middle(found: DataFrame, candidates: DataFrame) -> DataFrame:
    """(doc_id, style, n, after): where the contents jump from one chapter to another and three
    lines or more of one style between have numbers between theirs, a median of LEAST_SPACING
    rows apart; the most frequent style, and the number of the chapter before the first of
    them. found: titles; candidates: contents.suspects, low ones don't count."""
    chapters = _numbered(found).select("doc_id", "row", F.struct("row", "number").alias("_c"), F.lit(None).cast("struct<style: string, number: bigint>").alias("_w"))
    weak = candidates.where("confidence <> 'low'").select("doc_id", "row", F.lit(None).cast("struct<row: bigint, number: double>").alias("_c"), F.struct("style", F.col("number").cast("long").alias("number")).alias("_w"))
    # a candidate meets the chapters around it by its place in their order
    order = Window.partitionBy("doc_id").orderBy("row")
    rows = chapters.unionByName(weak).withColumns({"_a": F.last("_c", ignorenulls=True).over(order), "_b": F.first("_c", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))})
    gap = F.col("_b.number") - F.col("_a.number")
    rows = rows.where("_w IS NOT NULL").where(gap.between(LEAST_GAP, MOST_GAP) & (F.col("_w.number") > F.col("_a.number")) & (F.col("_w.number") < F.col("_b.number")))
    rows = rows.select("doc_id", "row", F.col("_w.style").alias("style"), F.col("_a.number").alias("after"))
    by = Window.partitionBy("doc_id", "style").orderBy("row")
    rows = rows.withColumn("_apart", F.col("row") - F.lag("row").over(by))
    # of an even number of distances the upper middle one
    apart = F.array_sort(F.collect_list("_apart"))
    styles = rows.groupBy("doc_id", "style").agg(F.count(F.lit(1)).alias("n"), F.min_by("after", "row").alias("after"), apart.alias("_d"), F.min("row").alias("_first"))
    best = Window.partitionBy("doc_id").orderBy(F.desc("n"), "_first")
    styles = styles.withColumn("_i", F.row_number().over(best)).where("_i = 1 AND n >= %d" % LEAST_CHAPTERS)
    return styles.where(F.get("_d", F.floor(F.size("_d") / 2).cast("int")) >= LEAST_SPACING).select("doc_id", "style", "n", "after")


def missed_tail(lines: DataFrame, found: DataFrame, candidates: DataFrame) -> DataFrame:
    """(doc_id, style, n, kind): behind the last title, counts: three lines or more of one style
    with high confidence that go on from the last chapter, or, of volume and chapter numbers,
    begin at 1; many: no such, but TAIL_ROWS rows or five chapters' length and three lines of
    a style."""
    last = found.groupBy("doc_id").agg(F.max("row").alias("_last"))
    chapters = _numbered(found).groupBy("doc_id").agg(F.max_by("number", "row").alias("_number"), F.count(F.lit(1)).alias("_n"))
    sizes = lines.groupBy("doc_id").agg(F.max("row").alias("_end"))
    books = last.join(chapters, "doc_id").join(sizes, "doc_id").withColumns({"_rest": F.col("_end") - F.col("_last"), "_mean": F.greatest(F.lit(1), F.floor(F.col("_last") / F.col("_n")))})
    rows = candidates.join(books, "doc_id").where("row > _last AND _rest >= 3")
    sure = (F.col("confidence") == "high") & ~((F.length("name") > LONG_NAME) & F.col("name").rlike("[，,]"))
    by = Window.partitionBy("doc_id", "style").orderBy("row")
    high = rows.where(sure).withColumn("_next", F.col("number") == F.lag("number").over(by) + 1)
    told = high.groupBy("doc_id", "style").agg(F.count(F.lit(1)).alias("n"), F.count_if("_next").alias("_k"), F.min_by("number", "row").alias("_from"), F.first("_number").alias("_number"), F.first("_rest").alias("_rest"), F.first("_mean").alias("_mean"))
    starts = F.when(F.col("style") == "volume-chapter", F.col("_from") == 1).otherwise((F.col("_number") >= 1) & (F.col("_from") > F.col("_number")) & (F.col("_from") <= F.col("_number") + TAIL_FOLLOWS))
    counts = told.where(starts & (F.col("n") >= LEAST_CHAPTERS) & (F.col("_k") >= LEAST_IN_ORDER) & (F.col("_rest") / F.col("n") >= F.col("_mean") / TAIL_SHARE))
    many = rows.where(F.col("_rest") >= F.greatest(F.lit(TAIL_ROWS), F.col("_mean") * TAIL_SHARE)).groupBy("doc_id", "style").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_CHAPTERS)
    both = counts.select("doc_id", "style", "n", F.lit("counts").alias("kind"), F.lit(0).alias("_o")).unionByName(many.select("doc_id", "style", "n", F.lit("many").alias("kind"), F.lit(1).alias("_o")))
    first = Window.partitionBy("doc_id").orderBy("_o", F.desc("n"), "style")
    return both.withColumn("_i", F.row_number().over(first)).where("_i = 1").select("doc_id", "style", "n", "kind")


def wrapped_paragraphs(lines: DataFrame, titles: DataFrame) -> DataFrame:
    """(doc_id, paragraph, row) of lines that are one paragraph in several: rows with text, those
    behind the first without an indent and no title between, whose quotes fit only together."""
    heads = titles.select("doc_id", "row").distinct().withColumn("_title", F.lit(True))
    rows = lines.join(heads, ["doc_id", "row"], "left").withColumns({"_t": body_of(F.coalesce("text", F.lit(""))), "_indented": F.coalesce("text", F.lit("")).rlike(r"^[ \t\x{3000}\x{00A0}]")})
    full = (F.translate("_t", " \t ", "") != "") & F.col("_title").isNull()
    order = Window.partitionBy("doc_id").orderBy("row")
    rows = rows.withColumn("_full", full)
    starts = F.when(F.col("_full") & ~F.col("_indented") & F.coalesce(F.lag("_full").over(order), F.lit(False)), 0).otherwise(1)
    rows = rows.withColumn("paragraph", F.sum(starts).over(order)).where("_full")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "_t"))), lambda x: x["_t"]), "")
    groups = rows.groupBy("doc_id", "paragraph").agg(F.count(F.lit(1)).alias("n"), F.bool_and(balanced(F.col("_t"))).alias("_each"), whole.alias("_whole"), F.collect_list("row").alias("_rows")).where("n > 1 AND NOT _each")
    return groups.where(balanced(F.col("_whole"))).select("doc_id", "paragraph", F.explode("_rows").alias("row"))


def hard_wrapped(lines: DataFrame, titles: DataFrame) -> DataFrame:
    """(doc_id, n_paragraphs, n_covered, n_problems) of books with LEAST_PARAGRAPHS such
    paragraphs or more, which cover at least half of the lines whose quotes don't fit."""
    inside = wrapped_paragraphs(lines, titles)
    heads = titles.select("doc_id", "row").distinct()
    bad = lines.join(heads, ["doc_id", "row"], "left_anti").where(~balanced(F.coalesce("text", F.lit("")))).select("doc_id", "row")
    covered = bad.join(inside.withColumn("_in", F.lit(True)), ["doc_id", "row"], "left").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_problems"), F.count_if("_in").alias("n_covered"))
    books = inside.groupBy("doc_id").agg(F.count_distinct("paragraph").alias("n_paragraphs"))
    out = books.join(covered, "doc_id").where((F.col("n_paragraphs") >= LEAST_PARAGRAPHS) & (F.col("n_covered") * 2 >= F.col("n_problems")))
    return out.select("doc_id", "n_paragraphs", "n_covered", "n_problems")
