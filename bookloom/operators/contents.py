"""Table of contents by the whole title grammar: what kind of title each line is, headers
that name two levels, parents, names on the following line, repeated headings, records
with numbers settled, and lines that look like titles but are none yet."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bookloom.functions.chars import BLANK, BLANK_CHARS, char_count, clean
from bookloom.functions.context import end_of, ends_in_period, only_noted
from bookloom.functions.forms import words
from bookloom.functions.headings import marker, unmarked
from bookloom.functions.rules import matched
from bookloom.functions.titles import (
    ALLOWED_TAILS, NAMED_VOLUMES, SPECIALS, TITLE_LIMIT, chapter, forbidden_tail, merged_subtitle, mixed, no_heading, range_end, special, strip_body, title_length, valid_title, volume, weak)

#: What every title of the grammar has in it somewhere: 第, 番外, a volume's or a special word.
MAYBE = "第|番外|" + words(*NAMED_VOLUMES, *SPECIALS)
#: Headings repeated within so many characters and rows are one.
REPEAT_CHARS, REPEAT_ROWS = 100, 40
#: What no line is that holds a chapter's name: dialogue, notes, links.
_NO_NAME = r"^[「『“\"‘'—…*=#~\-]|[。！？!?；;，,：:]$|^(作者|ps|http)|www\.|求(票|收藏|推薦|推荐)"


def titles(lines: DataFrame, rules=(), allowed: str = ALLOWED_TAILS, more: str = "", limit: int = TITLE_LIMIT, short_volume: bool = False,
           contextual: bool = False) -> DataFrame:
    """(doc_id, row, part, kind, source, work, unit, number, number_text, name) of title lines, in
    one pass of fixed precedence: excluded by a marker, work, volume with chapter, forced by a
    marker, rules, volume, chapter, special. kind: work, volume, chapter, side or special;
    part: 0, and 1 for the chapter of a line that names both. contextual: also lines that are
    titles only behind certain others, with range_end and accepts (see acceptance)."""
    text = clean(unmarked(F.col("text")))
    # equal lines are parsed once
    found = lines.select("text").distinct().select("text", text.alias("t"), marker(F.col("text")).alias("mark")).where("t <> '' AND mark <> 'exclude'")
    if not rules:  # one pattern lets body lines go before the grammar is asked
        found = found.where((F.col("mark") != "none") | F.col("t").rlike(MAYBE))
    parsed = found.select("text", "t", "mark", mixed(F.col("t"), short_volume).alias("m"), (matched(F.col("t"), rules, allowed, more, limit) if rules else F.lit(None)).alias("r"),
                          volume(F.col("t")).alias("v"), chapter(F.col("t")).alias("c"), special(F.col("t")).alias("s"))
    known = {"volume": F.col("v"), "chapter": F.col("c"), "special": F.col("s")}  # each form is parsed once a line
    parsed = parsed.withColumns({"valid": valid_title(F.col("t"), allowed, more, limit, known), "heading": no_heading(F.col("t"), known).isNull()})
    parsed = parsed.withColumn("ok", F.col("valid") & F.col("heading"))
    mixed_ok, accepts = F.col("ok"), F.lit("always")
    if contextual:
        # both parts of a line that names two levels fit by themselves; end marks and full stops are asked about
        parsed = parsed.withColumns({"end": end_of(F.col("t")), "period": ends_in_period(F.col("t"), F.col("c"), limit)})
        mixed_ok = F.col("heading") & (title_length(F.col("m.volume_name")) <= limit) & (title_length(F.col("m.name")) <= limit)
        noted = F.when(F.col("end").isNotNull(), (F.col("end.level") == "chapter") & F.col("end.number").isNotNull()).otherwise(~only_noted(F.col("t"), F.col("c")))
        parsed = parsed.withColumn("ok", F.col("heading") & noted & (F.col("valid") | F.col("period").isNotNull()))
        accepts = F.when(F.col("end").isNotNull(), "unless_same").when(~F.col("valid"), F.col("period")).otherwise("always")

    def event(part, kind, source, work, unit, number, number_text, name):
        lit = lambda x: x if not isinstance(x, (str, int)) else F.lit(x)
        return F.struct(F.lit(part).alias("part"), lit(kind).alias("kind"), F.lit(source).alias("source"), lit(work).alias("work"), lit(unit).alias("unit"),
                        number.cast("double").alias("number"), lit(number_text).alias("number_text"), strip_body(lit(name)).alias("name"))

    from bookloom.functions.numerals import number as value

    c = F.col
    none = F.lit(0.0)
    events = (F.when(c("mark") == "work", F.array(event(0, "work", "marker", "", "", none, "", c("t"))))
              .when(c("m").isNotNull() & mixed_ok, F.array(
                  event(0, "volume", "auto", "", c("m.volume_unit"), value(c("m.volume_number_text")), c("m.volume_number_text"), c("m.volume_name")),
                  event(1, "chapter", "auto", "", c("m.unit"), value(c("m.number_text")), c("m.number_text"), c("m.name"))))
              .when(c("mark") == "special", F.array(event(0, "special", "marker", "", "", none, "", c("t")))))
    if rules:
        events = events.when(c("r").isNotNull(), F.array(event(
            0, F.when(c("r.level") == 1, "volume").otherwise("chapter"), "rule", "", "", c("r.number"), c("r.number_text"), c("r.title"))))
    events = (events.when(c("v").isNotNull() & c("ok"), F.array(event(0, "volume", "auto", c("v.work"), c("v.unit"), c("v.number"), c("v.number_text"), c("v.name"))))
              .when(c("c").isNotNull() & c("ok"), F.array(event(
                  0, F.when(c("c.kind") == "side", "side").otherwise("chapter"), "auto", c("c.work"), c("c.unit"), c("c.number"), c("c.number_text"), c("c.name"))))
              .when(c("s").isNotNull() & c("ok"), F.array(event(0, "special", "auto", c("s.work"), c("s.word"), none, "", c("s.name"))))
              .when(c("mark") == "include", F.array(event(0, "chapter", "marker", "", "", none, "", c("t")))))
    if not contextual:
        # outer: no filter on the events is inferred, which would ask the grammar again for each use
        known = parsed.select("text", F.explode_outer(events).alias("e")).where("e IS NOT NULL")
        return lines.select("doc_id", "row", "text").join(known, "text").select("doc_id", "row", "e.*")
    both = c("m").isNotNull() & mixed_ok
    out = parsed.select("text", F.explode_outer(events).alias("e"), F.when(~both, range_end(c("t"))).alias("range_end"), F.when(both, "always").otherwise(accepts).alias("accepts"), "mark")
    out = lines.select("doc_id", "row", "text").join(out.where("e IS NOT NULL"), "text").select("doc_id", "row", "e.*", "range_end", "accepts", "mark").withColumn("source", F.when(F.col("mark") == "include", "marker").otherwise(F.col("source"))).drop("mark")
    # only chapters of the grammar wait for others; what a marker or a rule says holds
    forced, asked = F.col("source").isin("marker", "rule"), (F.col("kind") == "chapter") & (F.col("part") == 0)
    out = out.where(forced | asked | (F.col("accepts") == "always"))
    return out.withColumn("accepts", F.when(forced | (F.col("accepts") == "first"), "always").otherwise(F.col("accepts")))


def with_parents(found: DataFrame, lines: DataFrame) -> DataFrame:
    """found with parent_row and ord. The volume of a line that names both goes where it is
    the current one; an end mark closes the current volume, and is no title."""
    ends = lines.where(end_of(clean(F.col("text")))["level"] == "volume").select("doc_id", "row", F.lit(True).alias("ends"))
    rows = found.join(ends, ["doc_id", "row"], "full").withColumn("part", F.coalesce("part", F.lit(0)))
    before = Window.partitionBy("doc_id").orderBy("row", "part").rowsBetween(Window.unboundedPreceding, -1)
    same = F.struct("number", "unit")
    current = F.last(F.when(F.col("ends"), F.struct(F.lit(-1.0).alias("number"), F.lit("").alias("unit"))).when(F.col("kind") == "volume", same), ignorenulls=True).over(before)
    rows = rows.withColumn("_now", current)
    again = F.coalesce((F.col("kind") == "volume") & F.exists(F.array(F.col("_now")), lambda x: (x["number"] == F.col("number")) & (x["unit"] == F.col("unit"))), F.lit(False))
    both = F.max("part").over(Window.partitionBy("doc_id", "row")) == 1
    rows = rows.withColumn("_both", both).where(~(again & F.col("_both"))).drop("_now")
    upto = Window.partitionBy("doc_id").orderBy("row", "part").rowsBetween(Window.unboundedPreceding, 0)
    volume_row = F.last(F.when(F.col("ends"), F.lit(-1)).when(F.col("kind") == "volume", F.col("row")), ignorenulls=True).over(upto)
    work_row = F.last(F.when(F.col("kind") == "work", F.col("row")), ignorenulls=True).over(upto)
    rows = rows.withColumn("_volume", volume_row).withColumn("_work", work_row).where("ends IS NULL")
    parent = F.when((F.col("kind") != "volume") & (F.col("kind") != "work") & (F.col("_volume") >= 0), F.col("_volume")).when(F.col("kind") != "work", F.col("_work"))
    order = Window.partitionBy("doc_id").orderBy("row", "part")
    return rows.withColumn("parent_row", parent).withColumn("ord", (F.row_number().over(order) - 1).cast("long")).drop("ends", "_both", "_volume", "_work")


def with_subtitles(found: DataFrame, lines: DataFrame, limit: int = TITLE_LIMIT) -> DataFrame:
    """found with subtitle and subtitle_row: for numbered titles without a name, the next line
    that is not blank, if it can be one: not indented, no title, no dialogue, no sentence."""
    by_row = Window.partitionBy("doc_id").orderBy("row")
    after = by_row.rowsBetween(1, Window.unboundedFollowing)
    blank = F.translate("text", BLANK_CHARS, "") == ""
    following = F.first(F.when(~blank, F.struct(F.col("row").alias("at"), F.col("text").alias("next"))), ignorenulls=True).over(after)
    beside = lines.withColumn("_f", following).join(found.select("doc_id", "row").distinct(), ["doc_id", "row"], "left_semi").select("doc_id", "row", "_f.at", "_f.next")
    t = clean(F.col("next"))
    is_title = found.select("doc_id", F.col("row").alias("at"), F.lit(True).alias("_t")).distinct()
    fits = ((title_length(t) <= limit) & ~F.col("next").rlike(f"^({BLANK}{{2}}|\t)") & ~F.lower(t).rlike(_NO_NAME) & ~forbidden_tail(t) & F.col("_t").isNull())
    names = beside.join(is_title, ["doc_id", "at"], "left").where(fits).select("doc_id", "row", F.col("at").alias("subtitle_row"), merged_subtitle(F.col("next")).alias("subtitle"))
    bare = (F.col("name") == "") & (F.col("number") > 0) & F.col("kind").isin("chapter", "volume")
    joined = found.join(names, ["doc_id", "row"], "left")
    return joined.withColumn("subtitle", F.when(bare, F.col("subtitle"))).withColumn("subtitle_row", F.when(bare, F.col("subtitle_row")))


def without_repeats(found: DataFrame, lines: DataFrame) -> DataFrame:
    """found without headings that the next one says again: same kind, unit and number, names
    equal or one of them missing, under REPEAT_CHARS characters and REPEAT_ROWS rows apart.
    The last of a run stays, with the longest name."""
    by_row = Window.partitionBy("doc_id").orderBy("row")
    chars = lines.withColumn("_chars", F.sum(char_count(F.col("text"))).over(by_row)).select("doc_id", "row", "_chars")
    placed = found.join(chars, ["doc_id", "row"])
    order = Window.partitionBy("doc_id").orderBy("row", "part")
    nxt = F.lead(F.struct("kind", "unit", "number", "name", "row", "_chars", "part")).over(order)
    own = char_count(F.concat_ws("", "work", "unit", "number_text", "name")) + 2
    rows = placed.withColumn("_n", nxt)
    same = ((F.col("_n.kind") == F.col("kind")) & (F.col("_n.unit") == F.col("unit")) & (F.col("_n.number") == F.col("number")) & (F.col("number") > 0)
            & ((F.col("_n.name") == F.col("name")) | (F.col("_n.name") == "") | (F.col("name") == ""))
            & (F.col("_n.row") - F.col("row") <= REPEAT_ROWS) & (F.col("_n.row") > F.col("row")) & (F.col("_n._chars") - F.col("_chars") < F.lit(REPEAT_CHARS) + own))
    rows = rows.withColumn("_again", F.coalesce(same, F.lit(False)))
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_run", F.coalesce(F.sum(F.when(F.col("_again"), 0).otherwise(1)).over(upto), F.lit(0)))
    run = Window.partitionBy("doc_id", "_run")
    longest = F.max(F.struct(F.length("name").alias("n"), F.col("name").alias("name"))).over(run)["name"]
    return rows.withColumn("name", longest).where("NOT _again").drop("_n", "_again", "_run", "_chars")


def records(found: DataFrame) -> DataFrame:
    """found with `settled`: the number of each chapter, ambiguous ones read so as to follow on
    the chapter before with the same parent, as that was read itself."""
    from bookloom.operators.acceptance import settle

    chapters = found.where("kind IN ('chapter', 'side') AND number > 0")
    plain = chapters.withColumn("range_end", F.lit(None).cast("double")).withColumn("accepts", F.lit("always"))
    # side stories keep their numbers
    asked = plain.withColumn("_text", F.col("number_text")).withColumn("number_text", F.when(F.col("kind") == "chapter", F.col("number_text")).otherwise(""))
    return settle(asked, ("doc_id", "parent_row")).withColumn("number_text", F.col("_text")).select(*found.columns, "settled")


def volume_summary(found: DataFrame) -> DataFrame:
    """(doc_id, volume_row, n_chapters, first_number, last_number) of the records of each
    volume; null volume_row: chapters in none."""
    return records(found).groupBy("doc_id", F.col("parent_row").alias("volume_row")).agg(
        F.count(F.lit(1)).alias("n_chapters"), F.min("settled").alias("first_number"), F.max("settled").alias("last_number"))


def suspects(lines: DataFrame, found: DataFrame, limit: int = TITLE_LIMIT) -> DataFrame:
    """(doc_id, row, style, number, name, score, confidence) of weak titles that found lacks.
    Score: 2 for a candidate of the same style one number before and one behind, 1 for a style of
    three or more, 3 or 2 for 200 or 60 characters of body up to the next, 1 for a blank line
    beside, minus 3 if linked without 60, minus 4 or 2 for a name like a sentence or a clause,
    minus 1 for a mere blank behind the number. 5 is high, 3 medium, the rest low."""
    by_row = Window.partitionBy("doc_id").orderBy("row")
    blank = F.translate("text", BLANK_CHARS, "") == ""
    beside = F.coalesce(F.lag(blank).over(by_row), F.lit(True)) | F.coalesce(F.lead(blank).over(by_row), F.lit(True))
    total = F.sum(char_count(F.col("text"))).over(by_row)
    whole = F.sum(char_count(F.col("text"))).over(Window.partitionBy("doc_id"))
    rows = lines.withColumns({"_beside": beside, "_upto": total, "_all": whole, "_t": clean(F.col("text"))})
    rows = rows.where(title_length(F.col("_t")) <= limit).withColumn("_w", weak(F.col("_t"))).where("_w IS NOT NULL")
    rows = rows.join(found.select("doc_id", "row").distinct(), ["doc_id", "row"], "left_anti").select(
        "doc_id", "row", F.concat(F.col("_w.style"), F.col("_w.sign")).alias("style"), F.col("_w.number").alias("number"), F.col("_w.name").alias("name"), "_beside", "_upto", "_all")
    in_style = Window.partitionBy("doc_id", "style").orderBy("row")
    follows = F.coalesce(F.lag("number").over(in_style) == F.col("number") - 1, F.lit(False))
    leads = F.coalesce(F.lead("number").over(in_style) == F.col("number") + 1, F.lit(False))
    body = F.coalesce(F.lead("_upto").over(Window.partitionBy("doc_id").orderBy("row")), F.col("_all")) - F.col("_upto")
    one = lambda c, n: F.when(c, n).otherwise(0)
    rows = rows.withColumns({"_follows": follows, "_leads": leads, "_body": body, "_n": F.count(F.lit(1)).over(Window.partitionBy("doc_id", "style"))})
    linked = F.col("_follows") | F.col("_leads")
    score = (one(F.col("_follows"), 2) + one(F.col("_leads"), 2) + one(F.col("_n") >= 3, 1) + F.when(F.col("_body") >= 200, 3).when(F.col("_body") >= 60, 2).otherwise(0)
             + one(F.col("_beside"), 1) - one(linked & (F.col("_body") < 60), 3) - F.when(F.col("name").rlike("[。！？!?]$"), 4).when(F.col("name").rlike("[，,；;]"), 2).otherwise(0)
             - one(F.col("style") == "plain ", 1))
    rows = rows.withColumn("score", score)
    return rows.select("doc_id", "row", "style", "number", "name", "score", F.when(F.col("score") >= 5, "high").when(F.col("score") >= 3, "medium").otherwise("low").alias("confidence"))
