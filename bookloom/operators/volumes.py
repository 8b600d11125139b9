"""Volumes that a book has but does not write, from three kinds of evidence, for each book
the first that it has: chapters numbered 2-1, volume words in front of every chapter, or
volumes and their end marks with chapter numbers that begin again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookloom.functions.chars import clean
from bookloom.functions.context import end_of
from bookloom.functions.forms import B, VOLUME_UNITS, S, group, ordinal, spaced
from bookloom.functions.headings import unmarked
from bookloom.functions.numerals import chinese, number
from bookloom.functions.titles import N, weak
from bookloom.runtime import checkpointed

_PREFIX = "^(?:" + ordinal(VOLUME_UNITS, N) + "|" + spaced("([部卷篇])", group(N)) + rf")([{S}（(].*)?$"


def _whole(value: Column) -> Column:
    return F.when((value > 0) & (value == F.floor(value)), value.cast("long"))


def _islands(rows: DataFrame, key: Column) -> DataFrame:
    """rows with `_island`, the number of the run of equal keys that a row is in; rows without
    a key are in none."""
    order = Window.partitionBy("doc_id").orderBy("row", "part")
    rows = rows.withColumn("_key", key)
    starts = F.col("_key").isNotNull() & ~F.coalesce(F.lag("_key").over(order) == F.col("_key"), F.lit(False))
    return rows.withColumn("_starts", starts).withColumn("_island", F.sum(F.when(F.col("_starts"), 1).otherwise(0)).over(order)).where("_key IS NOT NULL")


def _of_islands(rows: DataFrame, unit: Column, evidence: str) -> DataFrame:
    return rows.select("doc_id", "row", "part", F.col("_island").alias("nth"), F.col("_key").alias("number"), unit.alias("unit"), F.lit("").alias("name"), F.lit(evidence).alias("evidence"))


def _by_restarts(items: DataFrame, bounds: DataFrame) -> DataFrame:
    """items between boundaries, cut where the count begins again. bounds (doc_id, row, type,
    number, unit, name): volumes and end marks."""
    marks = bounds.select("doc_id", "row", F.lit(-1).alias("part"), F.struct("type", "number", "name").alias("bound"))
    rows = items.select("doc_id", "row", "part", "formal").withColumn("bound", F.lit(None).cast(marks.schema["bound"].dataType)).unionByName(marks.withColumn("formal", F.lit(None).cast("long")))
    order = Window.partitionBy("doc_id").orderBy("row", "part")
    rows = rows.withColumns({"block": F.sum(F.when(F.col("bound").isNotNull(), 1).otherwise(0)).over(order), "prev": F.last("bound", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)),
                             "next": F.first("bound", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))}).where("bound IS NULL")
    in_block = Window.partitionBy("doc_id", "block")
    by_row = in_block.orderBy("row", "part")
    before = F.last("formal", ignorenulls=True).over(by_row.rowsBetween(Window.unboundedPreceding, -1))
    seen = F.count("formal").over(by_row)
    left = F.count("formal").over(by_row.rowsBetween(0, Window.unboundedFollowing))
    # what stands before the first chapter of a book, and behind its last, is in no volume
    rows = rows.withColumns({"_before": before, "_seen": seen, "_left": left}).where("(prev IS NOT NULL OR _seen > 0) AND (next IS NOT NULL OR _left > 0)")
    rows = rows.withColumn("seg", F.sum(F.when((F.col("formal") == 1) & (F.col("_before") > 1), 1).otherwise(0)).over(by_row))
    rows = rows.withColumn("last", F.max("seg").over(in_block)).withColumn("_any", F.count("formal").over(in_block)).where("_any > 0")
    p, n = F.col("prev"), F.col("next")
    inside, ended = p["type"] == "volume", n["type"] == "end"
    back = F.col("seg") - F.col("last")
    value = (F.when(inside, F.when(ended & (n["number"] > p["number"]) & (F.col("seg") > 0) & (n["number"] + back > p["number"]), n["number"] + back))
             .when(ended & n["number"].isNotNull(), n["number"] + back)
             .when((p["type"] == "end") & p["number"].isNotNull(), p["number"] + 1 + F.col("seg"))
             .when((n["type"] == "volume") & (n["number"] > 1), n["number"] - 1 + back))
    limit = F.when(n["type"] == "volume", n["number"])
    rows = rows.withColumn("number", value).where((F.col("number") >= 1) & (limit.isNull() | (F.col("number") < limit)))
    real = bounds.where("type = 'volume' AND number IS NOT NULL").select("doc_id", "number").distinct().withColumn("_real", F.lit(True))
    rows = rows.join(real, ["doc_id", "number"], "left")
    # from the end of the block back, only as long as no number is taken
    taken = F.max(F.when(F.col("_real") & inside, F.col("seg"))).over(in_block)
    rows = rows.withColumn("_taken", taken).where("_real IS NULL")
    rows = rows.where(~inside | F.col("_taken").isNull() | (F.col("seg") > F.col("_taken")))
    # of two places for one number the first stays
    rows = rows.withColumn("_first", F.min("block").over(Window.partitionBy("doc_id", "number"))).where("block = _first")
    shown = bounds.where("type = 'end' AND number IS NOT NULL AND name <> ''").groupBy("doc_id", "number").agg(F.max_by("name", "row").alias("name"))
    unit = F.coalesce(F.min(F.when(F.col("type") == "end", F.struct("row", "unit")))["unit"], F.min(F.when(F.col("unit") != "", F.struct("row", "unit")))["unit"], F.lit("卷"))
    units = bounds.groupBy("doc_id").agg(unit.alias("unit"))
    rows = rows.join(shown, ["doc_id", "number"], "left").join(units, "doc_id", "left")
    return rows.select("doc_id", "row", "part", (F.col("block") * 100_000 + F.col("seg")).alias("nth"), "number", "unit", F.coalesce("name", F.lit("")).alias("name"), F.lit("restart").alias("evidence"))


def inferred(found: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Volumes (doc_id, row, number, unit, title, evidence), row being that of their first
    title, in front of which they would stand, and members (doc_id, row, part, number). found:
    titles with parents and settled numbers, in `settled` or else number. Books with a work,
    or without evidence, get none."""
    value = F.coalesce(F.col("settled"), F.col("number")) if "settled" in found.columns else F.col("number")
    found = checkpointed(found)  # read a dozen times below
    t = clean(unmarked(F.col("text")))
    texts = checkpointed(lines.select("doc_id", "row", t.alias("t"), end_of(t).alias("e"), weak(t).alias("_w")).where("e IS NOT NULL OR _w IS NOT NULL"))
    works = found.where("kind = 'work'").select("doc_id").distinct()
    rows = found.join(works, "doc_id", "left_anti").withColumn("formal", F.when(F.col("kind") == "chapter", _whole(value)))
    volumes = rows.where("kind = 'volume'").select("doc_id", "row", F.lit("volume").alias("type"), _whole(F.col("number")).alias("number"), "unit", F.lit("").alias("name"), "number_text")
    told = texts.where("e.level = 'volume'").join(works, "doc_id", "left_anti")
    ends = told.select("doc_id", "row", F.lit("end").alias("type"), _whole(F.col("e.number")).alias("number"), F.col("e.unit").alias("unit"), F.col("e.name").alias("name"), F.col("t").alias("number_text"))
    # an end mark without a number ends the volume before it
    bounds = volumes.unionByName(ends)
    order = Window.partitionBy("doc_id").orderBy("row")
    current = F.last(F.struct(F.col("type").alias("t"), F.col("number").alias("n")), ignorenulls=False).over(order.rowsBetween(Window.unboundedPreceding, -1))
    bounds = bounds.withColumn("_c", current).withColumn("number", F.when((F.col("type") == "end") & F.col("number").isNull() & (F.col("_c.t") == "volume"), F.col("_c.n")).otherwise(F.col("number"))).drop("_c")
    items = rows.where("kind <> 'volume'")

    real = volumes.where("number IS NOT NULL").select("doc_id", F.col("number").alias("_dash")).distinct().withColumn("_written", F.lit(True))
    dash = items.where("kind IN ('chapter', 'side')").join(texts.select("doc_id", "row", "_w"), ["doc_id", "row"], "left")
    dash = dash.withColumn("_dash", F.when(F.col("_w.style") == "volume-chapter", number(F.col("_w.volume_text")).cast("long"))).join(real, ["doc_id", "_dash"], "left")
    above = F.coalesce(F.last(F.when(F.col("kind") == "volume", F.col("unit")), ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("row", "part")), F.lit("卷"))
    units = rows.withColumn("_above", above).select("doc_id", "row", "part", "_above")
    dashed = _of_islands(_islands(dash, F.when(F.col("_written").isNull(), F.col("_dash"))).join(units, ["doc_id", "row", "part"]), F.col("_above"), "dash")

    lead = lambda i: F.regexp_extract("work", _PREFIX, i)
    prefix = F.when(F.col("work").rlike(_PREFIX), _whole(number(F.concat(lead(1), lead(4)))))
    prefixed = items.withColumn("_unit", F.concat(lead(2), lead(3))).withColumn("_p", prefix)
    many = prefixed.groupBy("doc_id").agg(F.count("_p").alias("n")).where("n >= 2").join(volumes.select("doc_id").distinct(), "doc_id", "left_anti")
    led = _of_islands(_islands(prefixed.join(many, "doc_id", "left_semi"), F.col("_p")), F.col("_unit"), "prefix")

    restarts = _by_restarts(items.select("doc_id", "row", "part", "formal"), bounds.drop("number_text"))
    dashed = checkpointed(dashed)
    led = checkpointed(led.join(dashed.select("doc_id").distinct(), "doc_id", "left_anti"))
    taken = dashed.select("doc_id").union(led.select("doc_id")).distinct()
    members = checkpointed(dashed.unionByName(led).unionByName(restarts.join(taken, "doc_id", "left_anti").select(*dashed.columns)))

    figures = bounds.groupBy("doc_id").agg(F.max(F.col("number_text").rlike("[0-9０-９]")).alias("_figures"))
    first = members.groupBy("doc_id", "nth", "number").agg(F.min("row").alias("row"), F.min_by("unit", F.struct("row", "part")).alias("unit"), F.max("name").alias("name"), F.first("evidence").alias("evidence"))
    first = first.join(figures, "doc_id", "left")
    numeral = F.when(F.coalesce("_figures", F.lit(False)), F.col("number").cast("string")).otherwise(chinese(F.col("number")))
    title = F.concat(F.lit("第"), numeral, F.col("unit"), F.when(F.col("name") != "", F.concat(F.lit(" "), F.col("name"))).otherwise(""))
    return first.select("doc_id", "row", "number", "unit", title.alias("title"), "evidence"), members.select("doc_id", "row", "part", "number")
