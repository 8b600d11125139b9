"""Where the rows of a text are after it was edited: maps from old to new rows, by comparing
the lines, by chapters, or by the lines of text in a chapter; maps compose, and what was kept
by row moves along.

A map is (doc_id, old_row, new_row, ...), one row for each old row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookloom.functions.chars import BLANK_CHARS
from bookloom.operators.alignment import aligned
from bookloom.runtime import checkpointed, dealt


def _full(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), BLANK_CHARS, "") != ""


def _key(text: Column) -> Column:
    """120 bits of a hash in 20 characters: rows are kept and shuffled with it several times."""
    return F.base64(F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)), 1, 15))


def _edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_id, n_old, n_new, head, tail) of texts (doc_id, row, _key) on both sides: how many lines are equal at
    the beginning, and how many of the others at the end."""
    sizes = old.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_old")).join(new.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_new")), "doc_id")
    sized = lambda t, n: t.join(sizes.select("doc_id", n), "doc_id").withColumn("_back", F.col(n) - F.col("row")).drop(n)
    shortest = F.least("n_old", "n_new")

    def first_other(key):
        a, b = (sized(t, n).select("doc_id", F.col(key).alias("_k"), F.col("_key").alias(name)) for t, n, name in ((old, "n_old", "_a"), (new, "n_new", "_b")))
        return a.join(b, ["doc_id", "_k"]).where("_a <> _b").groupBy("doc_id").agg(F.min("_k").alias(f"_{key}_other"))

    both = sizes.join(first_other("row"), "doc_id", "left").join(first_other("_back"), "doc_id", "left")
    head = F.coalesce("_row_other", shortest)
    tail = F.least(F.coalesce(F.col("__back_other") - 1, shortest), shortest - head)
    return both.select("doc_id", "n_old", "n_new", head.alias("head"), tail.alias("tail"))


def changed_rows(old: DataFrame, new: DataFrame) -> DataFrame:
    """The map of all rows of old to new, both (doc_id, row, text) with rows from 0 without
    gaps; null texts are empty ones. how: same, where the line is found again; replaced, by its
    place, where as many lines stand between the same two neighbours; else gone, with the row
    in front of the change (-1: none). A text that new lacks is gone.

    Equal lines at both ends need no comparison. Between them lines with text are aligned
    (alignment.aligned: unique lines as anchors, common subsequences of the gaps); blank lines
    go with the line in front of them."""
    # each is read several times
    old, new = (checkpointed(dealt(t.select("doc_id", "row", _full(F.col("text")).alias("_full"), _key(F.col("text")).alias("_key")), "doc_id")) for t in (old, new))
    edges = checkpointed(_edges(old, new))
    middle = lambda t, n: t.join(edges, "doc_id").where((F.col("row") >= F.col("head")) & (F.col("row") < F.col(n) - F.col("tail"))).where("_full").select(
        "doc_id", F.col("row").alias("idx"), F.col("_key").alias("key"), F.lit(None).cast("string").alias("loose"))
    pairs = aligned(middle(old, "n_old"), middle(new, "n_new")).select("doc_id", F.col("old_idx").alias("row"), F.col("new_idx").alias("_pair"))
    order = Window.partitionBy("doc_id").orderBy("row")
    rows = old.select("doc_id", "row", F.col("_full").cast("int").alias("_full")).join(edges, "doc_id", "left").join(pairs, ["doc_id", "row"], "left")
    to = F.when(F.col("row") < F.col("head"), F.col("row")).when(F.col("row") >= F.col("n_old") - F.col("tail"), F.col("row") + F.col("n_new") - F.col("n_old")).otherwise(F.col("_pair"))
    rows = rows.withColumns({"_to": to, "_texts": F.sum("_full").over(order)})
    at = F.when(F.col("_to").isNotNull(), F.struct("row", "_to", "_texts"))
    before = F.coalesce(F.last(at, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.struct(F.lit(-1).cast("long").alias("row"), F.lit(-1).cast("long").alias("_to"), F.lit(0).cast("long").alias("_texts")))
    after = F.coalesce(F.first(at, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing)), F.struct(F.col("n_old").alias("row"), F.col("n_new").alias("_to"), F.lit(0).cast("long").alias("_texts")))
    rows = rows.withColumns({"_before": before, "_after": after}).withColumn("_shift", F.col("_before._to") + F.col("row") - F.col("_before.row"))
    # of what is found only what is asked for below is kept, as a checkpoint is not compressed
    blank = F.col("_to").isNull() & (F.col("_texts") == F.col("_before._texts")) & (F.col("_shift") < F.col("_after._to"))
    even = (F.col("_after.row") - F.col("_before.row")) == (F.col("_after._to") - F.col("_before._to"))
    rows = checkpointed(rows.select("doc_id", "row", "_to", "_shift", F.col("_before._to").alias("_from"), blank.alias("_blank"), even.alias("_even")))
    # blank lines right behind the line in front, on both sides
    new_order = Window.partitionBy("doc_id").orderBy("row")
    counted = new.select("doc_id", F.col("row"), F.sum(F.col("_full").cast("int")).over(new_order).alias("_n"))
    asked = rows.where("_blank").select("doc_id", "row", "_shift", "_from")
    there = asked.join(counted.select("doc_id", F.col("row").alias("_shift"), "_n"), ["doc_id", "_shift"]).join(
        counted.select("doc_id", F.col("row").alias("_from"), F.col("_n").alias("_n0")), ["doc_id", "_from"], "left")
    follows = there.where(F.col("_n") == F.coalesce("_n0", F.lit(0))).select("doc_id", "row", F.lit(True).alias("_follows"))
    rows = rows.join(follows, ["doc_id", "row"], "left")
    found = F.when(F.col("_to").isNotNull(), F.struct(F.col("_to").alias("r"), F.lit("same").alias("h"))).when(
        F.col("_follows"), F.struct(F.col("_shift").alias("r"), F.lit("same").alias("h"))).when(
        F.col("_even"), F.struct(F.col("_shift").alias("r"), F.lit("replaced").alias("h"))).otherwise(F.struct(F.col("_from").alias("r"), F.lit("gone").alias("h")))
    return rows.select("doc_id", F.col("row").alias("old_row"), found["r"].alias("new_row"), found["h"].alias("how"))


def by_chapters(rows: DataFrame, titles: DataFrame) -> DataFrame:
    """The map of rows (doc_id, row) by titles (doc_id, old_row, new_row): that of the title they
    are, else of the last one in front; rows in front of all titles stay."""
    events = rows.select("doc_id", "row", F.lit(True).alias("_own"), F.lit(None).cast("long").alias("_to")).distinct().unionByName(
        titles.select("doc_id", F.col("old_row").alias("row"), F.lit(False).alias("_own"), F.col("new_row").cast("long").alias("_to")))
    upto = Window.partitionBy("doc_id").orderBy("row").rangeBetween(Window.unboundedPreceding, 0)
    met = events.withColumn("_last", F.max(F.when(F.col("_to").isNotNull(), F.struct("row", "_to"))).over(upto)).where("_own")
    return met.select("doc_id", F.col("row").alias("old_row"), F.coalesce("_last._to", "row").alias("new_row"))


def by_texts(old: DataFrame, new: DataFrame, titles: DataFrame) -> DataFrame:
    """The map of all rows of old to new, both (doc_id, row, text), for edits that keep lines of
    text in order in their chapters: the same line of text behind the chapter's title. A blank
    row is where the text in front of it is; what is beyond the chapter's lines goes to its last
    row; rows in front of all titles (doc_id, old_row, new_row) stay, at most at the last row."""
    order = Window.partitionBy("doc_id").orderBy("row")

    def told(lines, side):
        heads = titles.select("doc_id", F.col(f"{side}_row").alias("row"), F.col("new_row").alias("_head")).distinct()
        rows = lines.select("doc_id", "row", _full(F.col("text")).alias("_full")).join(heads, ["doc_id", "row"], "left")
        rows = rows.withColumn("_chapter", F.last("_head", ignorenulls=True).over(order))
        inner = Window.partitionBy("doc_id", "_chapter").orderBy("row")
        return rows.withColumn("_nth", F.sum(F.when(F.col("_full") & F.col("_head").isNull(), 1).otherwise(0)).over(inner))

    after = told(new, "new")
    places = after.where("_full AND _head IS NULL AND _chapter IS NOT NULL").select("doc_id", "_chapter", "_nth", F.col("row").alias("_there"))
    ends = after.where("_chapter IS NOT NULL").groupBy("doc_id", "_chapter").agg(F.max("row").alias("_end"))
    size = new.groupBy("doc_id").agg(F.max("row").alias("_last"))
    rows = told(old, "old").join(places, ["doc_id", "_chapter", "_nth"], "left").join(ends, ["doc_id", "_chapter"], "left").join(size, "doc_id", "left")
    to = F.when(F.col("_chapter").isNull(), F.least("row", F.coalesce("_last", F.lit(-1)))).when(F.col("_nth") == 0, F.col("_chapter")).otherwise(F.coalesce("_there", "_end"))
    return rows.select("doc_id", F.col("row").alias("old_row"), to.cast("long").alias("new_row"))


def composed(first: DataFrame, second: DataFrame) -> DataFrame:
    """The map of two edits, one behind the other, both with `how`: the weaker of both; what is
    in front of the text (-1) stays there. Rows that second does not know are gone at -1."""
    then = second.select("doc_id", F.col("old_row").alias("_mid"), F.col("new_row").alias("_to"), F.col("how").alias("_how"))
    met = first.withColumnRenamed("new_row", "_mid").join(then, ["doc_id", "_mid"], "left")
    weaker = F.when((F.col("how") == "gone") | F.col("_to").isNull() | (F.col("_how") == "gone"), "gone").when((F.col("how") == "replaced") | (F.col("_how") == "replaced"), "replaced").otherwise("same")
    return met.select("doc_id", "old_row", F.coalesce("_to", F.lit(-1).cast("long")).alias("new_row"), weaker.alias("how"))


def carried(state: DataFrame, rows: DataFrame, moved_on: bool = False) -> DataFrame:
    """state (doc_id, row, ...) at its new rows. With moved_on what stood on a line that is gone
    stays, at the row in front of the change if there is one; else it goes. Where several meet
    in a row all stay."""
    there = rows.where("new_row >= 0") if moved_on else rows.where("new_row >= 0 AND how <> 'gone'")
    met = state.withColumnRenamed("row", "_old").join(there.select("doc_id", F.col("old_row").alias("_old"), F.col("new_row").alias("_new")), ["doc_id", "_old"])
    return met.withColumn("row", F.col("_new")).select(*state.columns)
