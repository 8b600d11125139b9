"""Titles whose acceptance or number depends on the titles accepted before, and titles that
fold into another.

The only state of the pass over a book is the number of the last accepted chapter. Most
titles set it whatever it was; the others (a number that can be read in two ways, a name
with a full stop, an end mark that could be a title) wait for it. So a book is cut into
blocks of rows: a block whose last titles set the state tells it by itself, and only the
few others are chained. No task reads a whole book but for one state for each block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bookloom.functions.chars import char_count, without_blanks
from bookloom.functions.titles import TITLE_LIMIT, readings, settled_reading, title_length
from bookloom.operators import contents
from bookloom.runtime import checkpointed

#: Rows of a block.
BLOCK_ROWS = 2000
#: How a title is accepted: always; if its number follows on the last one; if there is a last
#: one with another number.
ALWAYS, FOLLOWS, UNLESS_SAME = "always", "follows", "unless_same"


def _fold(last, events, out):
    """State behind events, with the events that are accepted and their settled numbers.
    out: an empty array of what is gathered, or None to gather nothing."""
    def step(acc, e):
        settled = settled_reading(e["_number"], e["_undotted"], e["_ten"], acc["last"])
        ok = (F.when(e["_when"] == ALWAYS, True).when(e["_when"] == FOLLOWS, F.coalesce(acc["last"] == e["_number"] - 1, F.lit(False)))
              .otherwise(F.coalesce(acc["last"] != e["_number"], F.lit(False))))
        now = F.when(ok & (e["_number"] > 0), F.coalesce(e["_ends"], settled)).otherwise(acc["last"]).alias("last")
        if out is None:
            return F.struct(now)
        kept = F.array_append(acc["out"], F.struct(e.alias("e"), F.when(e["_number"] > 0, settled).alias("settled")))
        return F.struct(now, F.when(ok, kept).otherwise(acc["out"]).alias("out"))

    return F.aggregate(events, F.struct(last.alias("last")) if out is None else F.struct(last.alias("last"), out.alias("out")), step)


def settle(events: DataFrame, group=("doc_id",), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The events that are accepted, with `settled`, their numbers read so as to follow on the
    accepted event before in the group. events: group columns, row, part, number (0: none),
    number_text, range_end (null: none), accepts (ALWAYS, FOLLOWS or UNLESS_SAME). An empty
    table gives none; rows of one place are taken by all their columns in order."""
    names = [c for c in events.columns if c not in group]
    number, read = F.col("number"), readings(F.col("number"), F.col("number_text"))
    rows = events.withColumns({"_number": number.cast("double"), "_r": read, "_ends": F.col("range_end").cast("double"), "_when": F.col("accepts")})
    rows = rows.withColumns({"_undotted": F.col("_r.undotted"), "_ten": F.col("_r.ten")})
    own = F.struct("row", "part", *[c for c in names if c not in ("row", "part")], "_number", "_undotted", "_ten", "_ends", "_when")
    blocks = checkpointed(rows.withColumn("_block", F.floor(F.col("row") / block_rows)).groupBy(*group, "_block").agg(F.array_sort(F.collect_list(own)).alias("_events")))

    def sets(e):
        return (e["_when"] == ALWAYS) & (e["_number"] > 0) & ((e["_undotted"].isNull() & e["_ten"].isNull()) | e["_ends"].isNotNull())

    # place of the last event that sets the state, 0 if none does
    at = F.size("_events") + 1 - F.array_position(F.reverse(F.transform("_events", sets)), F.lit(True)).cast("int")
    at = F.when(at > F.size("_events"), 0).otherwise(at)
    slim = F.transform("_events", lambda e: F.struct(*[e[c].alias(c) for c in ("_number", "_undotted", "_ten", "_ends", "_when")]))
    none = F.lit(None).cast("double")
    told = blocks.select(*group, "_block", slim.alias("_slim"), at.alias("_at")).select(
        *group, "_block", (F.col("_at") > 0).alias("_fixed"),
        F.when(F.col("_at") > 0, _fold(none, F.slice("_slim", F.col("_at"), F.size("_slim")), None)["last"]).alias("_out"), F.when(F.col("_at") == 0, F.col("_slim")).alias("_open"))

    def chained(acc, b):
        after = F.when(b["_fixed"], b["_out"]).otherwise(_fold(acc["last"], b["_open"], None)["last"])
        return F.struct(after.alias("last"), F.array_append(acc["ins"], F.struct(b["_block"].alias("_block"), acc["last"].alias("_in"))).alias("ins"))

    ins = told.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("_block", "_fixed", "_out", "_open"))).alias("_b"))
    start = F.struct(none.alias("last"), F.expr("cast(array() as array<struct<_block: bigint, _in: double>>)").alias("ins"))
    ins = ins.select(*group, F.explode(F.aggregate("_b", start, chained)["ins"]).alias("_i")).select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], "_i.*")
    same = F.col("b._block") == F.col("i._block")
    for i, g in enumerate(group):
        same = same & F.col(f"b.{g}").eqNullSafe(F.col(f"i._g{i}"))
    joined = blocks.alias("b").join(ins.alias("i"), same).select(*[f"b.{g}" for g in group], "_events", "_in")
    empty = F.slice(F.transform("_events", lambda e: F.struct(e.alias("e"), e["_number"].alias("settled"))), 1, 0)
    out = joined.select(*group, F.explode(_fold(F.col("_in"), F.col("_events"), empty)["out"]).alias("x"))
    return out.select(*group, *[F.col(f"x.e.{c}").alias(c) for c in names], "x.settled")


def accepted(lines: DataFrame, rules=(), block_rows: int = BLOCK_ROWS, **limits) -> DataFrame:
    """Title lines of books with all that depends on other lines settled: columns of
    contents.titles, accepts and settled. Beyond the grammar by itself: short names with a
    full stop that continue the count, notes such as （本卷完） behind a name, end marks of
    chapters, long lines that say the heading before them again."""
    found = contents.titles(lines, rules, contextual=True, **limits)
    limit = limits.get("limit", TITLE_LIMIT)
    text = without_blanks(F.col("text"))
    rows = lines.where(text != "").withColumn("_before", F.lag(text).over(Window.partitionBy("doc_id").orderBy("row")))
    again = rows.where((title_length(F.col("text")) > limit) & F.col("_before").startswith("第") & text.startswith(F.col("_before"))).select("doc_id", "row")
    kept = found.join(again.withColumn("source", F.lit("auto")), ["doc_id", "row", "source"], "left_anti").select(*found.columns)
    return settle(kept, ("doc_id",), block_rows)


#: A heading said again within so many characters and rows is the same.
AGAIN_CHARS, AGAIN_ROWS = 100, 40


def absorbed(found: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, row, into_row, reason) of chapter headings that fold into another. phantom: no
    name, and the next line is the same heading in full. bare: no name, and the next line is
    a named chapter. range: covers several chapters, and the first of them follows. adjacent:
    the same heading on the next line; the longest name stays. repeat: the same heading
    again after less than AGAIN_CHARS characters. Headings set by markers or rules stay."""
    by_row = Window.partitionBy("doc_id").orderBy("row")
    chars = lines.withColumn("_chars", F.sum(char_count(F.col("text"))).over(by_row)).withColumn("_own", char_count(F.col("text"))).select("doc_id", "row", "_chars", "_own")
    order = Window.partitionBy("doc_id").orderBy("row", "part")
    placed = found.join(chars, ["doc_id", "row"]).withColumn("_body", F.regexp_replace("name", r"[\s\p{P}\p{S}]+", ""))
    nxt = F.struct("row", "kind", "work", "unit", "number", "name", "_body", "range_end", "_chars", "_own", "source")

    def with_next(rows):
        return rows.withColumn("_n", F.lead(nxt).over(order)).withColumn("_between", F.col("_n._chars") - F.col("_n._own") - F.col("_chars"))

    chapter = lambda c: F.col(f"{c}kind").isin("chapter", "side")
    identity = ((F.col("_n.kind") == F.col("kind")) & (F.col("_n.work") == F.col("work")) & (F.col("_n.unit") == F.col("unit")) & (F.col("_n.number") == F.col("number")))
    like = identity & (F.col("number") > 0) & F.col("_n.range_end").eqNullSafe(F.col("range_end")) & (
        (F.col("_body") == "") | (F.col("_n._body") == "") | (F.col("_body") == F.col("_n._body")))
    auto = ~F.col("source").isin("marker", "rule")
    near = (F.col("_between") < AGAIN_CHARS) & (F.col("_n.row") - F.col("row") <= AGAIN_ROWS)
    one = with_next(placed)
    alone = (F.when(auto & chapter("") & (F.col("name") == "") & (F.col("_between") == 0) & identity, "phantom")
             .when(auto & chapter("") & (F.col("name") == "") & (F.col("_between") == 0) & chapter("_n.") & (F.col("_n.name") != "") & ~F.col("_n.source").isin("marker", "rule"), "bare")
             .when(auto & chapter("") & F.col("range_end").isNotNull() & near & (F.col("_n.kind") == "chapter") & (F.col("_n.number") == F.col("number")) & F.col("_n.range_end").isNull(), "range"))
    one = one.withColumn("reason", alone)
    first = one.where("reason IS NOT NULL").select("doc_id", "row", F.col("_n.row").alias("into_row"), "reason")
    # runs of one heading: beside each other all fold into the longest name, else each second one into the first
    rest = with_next(one.where("reason IS NULL").drop("_n", "_between", "reason"))
    rest = rest.withColumn("_link", F.when(auto & chapter("") & F.coalesce(like, F.lit(False)), F.when(F.col("_between") == 0, "adjacent").when(near, "repeat")))
    before = F.lag("_link").over(order)
    rest = rest.withColumn("_before", before).withColumn("_run", F.sum(F.when(F.col("_before") == "adjacent", 0).otherwise(1)).over(order))
    run = Window.partitionBy("doc_id", "_run")
    best = F.max_by("row", F.struct(F.length("name"), -F.col("row"))).over(run)
    rest = rest.withColumn("_best", best).withColumn("_starts", F.first("_before", ignorenulls=False).over(run.orderBy("row", "part")))
    adjacent = rest.where("row <> _best").select("doc_id", "row", F.col("_best").alias("into_row"), F.lit("adjacent").alias("reason"))
    stays = rest.where("row = _best").select("doc_id", "row", "part", (F.col("_starts") == "repeat").alias("_again"))
    by = Window.partitionBy("doc_id").orderBy("row", "part")
    stays = stays.withColumn("_again", F.coalesce("_again", F.lit(False))).withColumn("_chain", F.sum(F.when(F.col("_again"), 0).otherwise(1)).over(by))
    place = Window.partitionBy("doc_id", "_chain").orderBy("row", "part")
    stays = stays.withColumn("_i", F.row_number().over(place)).withColumn("into_row", F.lag("row").over(by))
    repeat = stays.where("_i % 2 = 0").select("doc_id", "row", "into_row", F.lit("repeat").alias("reason"))
    return first.unionByName(adjacent).unionByName(repeat)
