"""Paragraphs that were cut into lines of a fixed width, joined again.

Whether a line goes on in the next is seen from both and from the widths around, but for
two cases: brackets that close what the paragraph has opened, and paragraphs that begin
with an indent. So lines are cut into runs at every place where no state could join them;
the state is folded over each run by itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookloom.functions.chars import BLANK_CHARS, HAN
from bookloom.functions.forms import CHAPTER_UNITS, NUMERALS, B, S, one_of, spaced, words
from bookloom.functions.titles import display_width

# Fixed values of the text format -------------------------------------
FIELDS = ("作者", "書名", "书名", "來源", "来源")
SECTION_WORDS = ("序章", "序言", "前言", "楔子", "引子", "後記", "后记", "尾聲", "尾声", "終章", "终章")
_PROTECTED_UNITS = CHAPTER_UNITS[:4] + "卷集部篇"
PAIRS = {"「": "」", "『": "』", "（": "）", "(": ")", "《": "》", "【": "】", "“": "”", "‘": "’"}
LEAST_WIDTH, MOST_WIDTH = 24, 180
NEIGHBOURS, LEAST_ALIKE, LEAST_OPEN = 10, 3, 2
LEAST_TOLERANCE, TOLERANCE = 4, 0.08
# ---------------------------------------------------------------------------------------
#: Lines that are no body: headings, fields, words of sections, list items, table rows.
PROTECTED = (f"^{B}(?:" + spaced("第", f"[{NUMERALS}]+", f"[{_PROTECTED_UNITS}]") + rf"([{S}：:、.．]|$)|(?:{words(*FIELDS)}){B}[：:]"
             + rf"|(?:{words(*SECTION_WORDS)})([{S}：:]|$)|[-*•][{S}]+|[（(]?[0-9０-９]+[)）.．、]|\|)")
INDENT = r"^(\x{3000}|[ \t]*\t| {2,})"
TERMINAL = r"""[。！？!?…]["'”’」』）》】]*$"""
ONLY_CLOSERS = r"^[」』）)》】”’]+[。！？!?，、；;]*$"
_OPENERS, _CLOSERS = "".join(PAIRS), "".join(PAIRS.values())


def _edge(text: Column, left: bool = True, right: bool = True) -> Column:
    out = F.regexp_replace(text, f"^[{S}]+", "") if left else text
    return F.regexp_replace(out, f"[{S}]+$", "") if right else out


def protected(text: Column) -> Column:
    return text.rlike(PROTECTED)


def quotes_of(text: Column) -> Column:
    """The brackets and quotes of a text."""
    return F.regexp_replace(text, f"[^{one_of(_OPENERS + _CLOSERS)[1:-1]}]", "")


def open_after(stack: Column, marks: Column) -> Column:
    """What is left to close behind some marks, innermost last; a closer that does not fit
    changes nothing."""
    def step(acc, c):
        opened = F.translate(c, _OPENERS, _CLOSERS)
        return F.when(opened != c, F.concat(acc, opened)).when((acc != "") & (F.right(acc, F.lit(1)) == c), F.left(acc, F.length(acc) - 1)).otherwise(acc)

    return F.aggregate(F.filter(F.split(marks, ""), lambda c: c != ""), stack, step)


def _around(rows: DataFrame) -> Column:
    """The width that lines around repeat, or null."""
    about = Window.partitionBy("doc_id", "_part").orderBy("row").rowsBetween(-NEIGHBOURS, NEIGHBOURS)
    fits = F.col("_width").between(LEAST_WIDTH, MOST_WIDTH) & ~F.col("_protected") & (F.col("_t") != "")
    near = F.collect_list(F.when(fits, F.struct(F.col("_width").alias("w"), F.col("_terminal").alias("t")))).over(about)
    alike = F.filter(near, lambda x: F.abs(x["w"] - F.col("_width")) <= F.greatest(F.lit(LEAST_TOLERANCE), F.col("_width") * TOLERANCE))
    return alike


def joins(lines: DataFrame, fixed: DataFrame | None = None) -> DataFrame:
    """(doc_id, row, text, joins): whether the next line goes on in this one. fixed (doc_id,
    row): lines that stay as they are, such as titles; blank lines stay too."""
    if fixed is None:
        rows = lines.withColumn("_fixed", F.lit(False))
    else:
        rows = lines.join(fixed.select("doc_id", "row").distinct().withColumn("_fixed", F.lit(True)), ["doc_id", "row"], "left").withColumn("_fixed", F.coalesce("_fixed", F.lit(False)))
    text = F.coalesce("text", F.lit(""))
    by_row = Window.partitionBy("doc_id").orderBy("row")
    rows = rows.withColumns({"text": text, "_t": _edge(text), "_part": F.sum(F.when(F.col("_fixed"), 1).otherwise(0)).over(by_row)})
    left = _edge(F.col("text"), left=False)
    rows = rows.withColumns({"_width": display_width(F.col("_t")), "_terminal": left.rlike(TERMINAL), "_protected": protected(F.col("text")) | F.col("_fixed"),
                             "_indented": F.col("text").rlike(INDENT), "_marks": quotes_of(F.col("text")), "_last": F.right(left, F.lit(1))})
    nxt = F.lead(F.struct("_t", "_protected", "_indented")).over(by_row)
    rows = rows.withColumns({"_alike": _around(rows), "_n": nxt})
    never = (F.col("_n").isNull() | (F.col("_t") == "") | (F.col("_n._t") == "") | F.col("_protected") | F.col("_n._protected") | F.col("_n._indented"))
    middle = F.array_sort(F.transform("_alike", lambda x: x["w"]))
    n = F.size("_alike")
    median = (F.get(middle, F.floor((n - 1) / 2).cast("int")) + F.get(middle, F.floor(n / 2).cast("int"))) / 2
    repeated = (n >= LEAST_ALIKE) & (F.size(F.filter("_alike", lambda x: ~x["t"])) >= LEAST_OPEN) & (
        F.abs(F.col("_width") - median) <= F.greatest(F.lit(LEAST_TOLERANCE), median * TOLERANCE))
    in_range = F.col("_width").between(LEAST_WIDTH, MOST_WIDTH)
    first = F.left("_n._t", F.lit(1))
    glues = ~(F.col("_last").rlike("[0-9A-Za-z]") & first.rlike("[0-9A-Za-z]"))
    cut_word = (open_after(F.lit(""), F.col("_marks")) != "") & F.col("_last").rlike(rf"[{HAN[1:-1]}々〇\p{{L}}\p{{N}}]") & ~first.rlike(one_of(_OPENERS))
    going = ~F.col("_terminal") & glues
    closes = F.when(F.col("_n._t").rlike(ONLY_CLOSERS), F.reverse(F.regexp_replace("_n._t", f"[^{one_of(_CLOSERS)[1:-1]}]", ""))).otherwise("")
    rows = rows.withColumns({"_never": never, "_local": going & (cut_word | (in_range & F.coalesce(repeated, F.lit(False)))), "_by_indent": going & in_range, "_closes": closes})
    # a run ends where neither brackets nor an indent could join
    ends = F.col("_never") | ~(F.col("_local") | F.col("_by_indent") | (F.col("_closes") != ""))
    rows = rows.withColumn("_run", F.coalesce(F.sum(F.when(ends, 1).otherwise(0)).over(by_row.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))

    def step(acc, e):
        stack = open_after(F.when(acc["open"], acc["stack"]).otherwise(""), e["_marks"])
        indented = F.when(acc["open"], acc["indented"]).otherwise(e["_indented"])
        return F.struct(stack.alias("stack"), indented.alias("indented"), e.alias("e"), acc["out"].alias("out"))

    def decided(acc, e):
        now = F.element_at(F.transform(F.array(step(acc, e)), lambda s: F.struct(
            (~e["_never"] & (((e["_closes"] != "") & s["stack"].endswith(e["_closes"])) | e["_local"] | (s["indented"] & e["_by_indent"]))).alias("open"),
            s["stack"].alias("stack"), s["indented"].alias("indented"))), 1)
        return F.element_at(F.transform(F.array(now), lambda s: F.struct(
            s["open"].alias("open"), s["stack"].alias("stack"), s["indented"].alias("indented"), F.array_append(acc["out"], F.struct(e["row"].alias("row"), s["open"].alias("joins"))).alias("out"))), 1)

    run = rows.groupBy("doc_id", "_run").agg(F.array_sort(F.collect_list(F.struct("row", "_marks", "_indented", "_never", "_local", "_by_indent", "_closes"))).alias("_e"))
    start = F.struct(F.lit(False).alias("open"), F.lit("").alias("stack"), F.lit(False).alias("indented"), F.slice(F.transform("_e", lambda e: F.struct(e["row"].alias("row"), F.lit(False).alias("joins"))), 1, 0).alias("out"))
    told = run.select("doc_id", F.explode(F.aggregate("_e", start, decided)["out"]).alias("x")).select("doc_id", "x.*")
    return rows.select("doc_id", "row", "text").join(told, ["doc_id", "row"])


def placed(joined: DataFrame) -> DataFrame:
    """joined (doc_id, row, text, joins) with new_row, the row of the paragraph that a line
    goes into, and whether it goes on from the one before."""
    by_row = Window.partitionBy("doc_id").orderBy("row")
    before = F.coalesce(F.lag("joins").over(by_row), F.lit(False))
    rows = joined.withColumn("goes_on", before)
    return rows.withColumn("new_row", (F.sum(F.when(F.col("goes_on"), 0).otherwise(1)).over(by_row) - 1).cast("long"))


def reflowed(lines: DataFrame, fixed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Paragraphs (doc_id, row, text) and the map (doc_id, row, new_row) of the lines that
    went into them. Blanks and tabs at the seams go."""
    rows = placed(joins(lines, fixed))
    piece = F.when(F.col("goes_on"), F.regexp_replace("text", r"^[ \t]+", "")).otherwise(F.col("text"))
    piece = F.when(F.col("joins"), F.regexp_replace(piece, r"[ \t]+$", "")).otherwise(piece)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", piece.alias("piece")))), lambda x: x["piece"]), "").alias("text")
    paragraphs = rows.groupBy("doc_id", "new_row").agg(text).select("doc_id", F.col("new_row").alias("row"), "text")
    return paragraphs, rows.select("doc_id", "row", "new_row")


def composed(first: DataFrame, second: DataFrame) -> DataFrame:
    """The map from the rows before two edits to those behind both; rows that the second
    edit has cut go to their first piece."""
    after = second.groupBy("doc_id", F.col("row").alias("_r")).agg(F.min("new_row").alias("_n"))
    return first.join(after.withColumnRenamed("doc_id", "_d"), (F.col("doc_id") == F.col("_d")) & (F.col("new_row") == F.col("_r")), "left").select(
        "doc_id", "row", F.col("_n").alias("new_row"))


def even_spaces(text: Column) -> Column:
    """Blanks inside a line: none between Chinese characters or at the end, one for a run or
    an ideographic one elsewhere; the indent and protected lines stay."""
    han = HAN[1:-1] + "々〇"
    indent = F.regexp_extract(text, r"^(\x{3000}+|[ \t]*\t| {2,})", 1)
    body = F.regexp_replace(F.substr(text, F.length(indent) + 1), f"[{S}]+$", "")
    body = F.regexp_replace(body, rf"(?<=[{han}])[{S}]+(?=[{han}])", "")
    body = F.regexp_replace(body, rf"[{S}]{{2,}}|\x{{3000}}", " ")
    return F.when((F.translate(text, BLANK_CHARS, "") == "") | protected(_edge(text)), text).otherwise(F.concat(indent, body))
