"""Fixes of punctuation that have one right answer, and their application to books.

A plan says which rows it takes and which lines stand there afterwards. Plans that take the
same row exclude each other, the first by place wins; whether one is taken depends only on
the plans that touch it, directly or through others, so the choice is folded over such
groups by themselves. What is skipped and changes characters only is done again on the
lines that the winner has made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookloom.functions.forms import one_of
from bookloom.operators.review import latin, suspicious
from bookloom.runtime import checkpointed, dealt

# Fixed values of the text format -----------------------------
PAIRS = {"「": "」", "『": "』", "“": "”", "‘": "’"}
LEADING = "，。！？：；、,.!?;"
SENTENCE_ENDS = "。！？!?…～~—.」』”’"
SEPARATORS = "-－—–―─━=＝*＊#＃~～_＿※☆★◆◇●○■□+＋"
SEPARATOR_LENGTH = 3
DASHES, HYPHENS, TILDES = "—―─━–", "-－", "~～"
LIST_NUMERALS = "一二三四五六七八九十〇零"
_CJK = r"\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3134F}，。！？：；、「」『』“”‘’（）《》〈〉【】—…～"
_HAN = r"\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}"
ELLIPSIS, DASH, TILDE = "……", "——", "～"
# ---------------------------------------------------------------------------------------
OPENERS, CLOSERS = "".join(PAIRS), "".join(PAIRS.values())
#: In this order where several take the same rows. The first five change characters of a line only.
LOCAL = ("separator_line", "repeated_punct", "dash_run", "homoglyph", "noise_dot")
KINDS = ("leading_punct", "unpaired", "unclosed", "missing_separator", *LOCAL)


def _class(signs: str) -> str:
    return one_of(signs)[1:-1]


_D, _A = _class(DASHES + HYPHENS), "A-Za-z0-9"


def indent_of(text: Column) -> Column:
    return F.regexp_extract(text, r"^[ \t\x{3000}]*", 0)


def body_of(text: Column) -> Column:
    return F.regexp_replace(text, r"^[ \t\x{3000}]+", "")


def separator_fix(text: Column) -> Column:
    """A line of one sign, four times or more, with SEPARATOR_LENGTH of it; others as they are."""
    t = F.rtrim(text)
    first = F.left(t, F.lit(1))
    hit = (F.length(t) > SEPARATOR_LENGTH) & first.rlike(one_of(SEPARATORS)) & (F.replace(t, first, F.lit("")) == "")
    return F.when(hit, F.repeat(first, F.lit(SEPARATOR_LENGTH))).otherwise(text)


def repeated_fix(text: Column) -> Column:
    """Runs of full stops, of ellipses, and of dots among Chinese as the six-dot ellipsis."""
    t = F.regexp_replace(text, r"(?<!…)…+([ \x{3000}]+…+)+", ELLIPSIS)
    t = F.regexp_replace(t, rf"(?<=[{_CJK}]|^)\.(?:[ \x{{3000}}]\.){{2,}}(?=[{_CJK}]|$)", "...")
    t = F.regexp_replace(F.regexp_replace(t, "。{3,}", ELLIPSIS), "…{3,}", ELLIPSIS)
    return F.regexp_replace(t, rf"(?:(?<=[{_CJK}])|^) *\.{{3,}} *(?=[{_CJK}]|$)", ELLIPSIS)


def dash_fix(text: Column) -> Column:
    """Runs of dashes as the dash of two cells, runs of tildes as one: hyphens, two dashes and
    tildes only beside Chinese and no Latin letter or figure. Lines that are or begin with a
    row of signs stay."""
    run = lambda c: rf"(?<![{c}{_A}])(?:(?<=[{_CJK}])[{c}]{{2,}}+(?![{_A}])|[{c}]{{2,}}+(?=[{_CJK}]))"
    long = rf"(?<![{_D}])(?=[{_D}]*[{_class(DASHES)}])[{_D}]{{3,}}+"
    changed = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, long, DASH), run(_D), DASH), run(_class(TILDES)), TILDE)
    t = F.trim(text)
    decoration = t.rlike(rf"^([{_D}]{{3}}|[{_class(TILDES)}]{{3}})") | ((F.length(t) >= SEPARATOR_LENGTH) & F.left(t, F.lit(1)).rlike(one_of(SEPARATORS)) & (F.replace(t, F.left(t, F.lit(1)), F.lit("")) == ""))
    return F.when(decoration, text).otherwise(changed)


def dot_fix(text: Column) -> Column:
    """Without dots between Chinese characters, but those behind a list's numeral, and without
    dots in a chapter's number."""
    listed = rf"((?:^|[^{_HAN}])[{LIST_NUMERALS}])[.．](?=[{_HAN}])"
    mark = "\x1e"
    t = F.regexp_replace(text, listed, f"$1{mark}")
    t = F.regexp_replace(t, rf"(?<=[{_HAN}])[.．](?=[{_HAN}])", "")
    t = F.regexp_replace(t, r"(?<=第)[ \x{3000}]*[.．][ \x{3000}]*(?=[0-9０-９])", "")
    t = F.regexp_replace(t, r"(第[0-9０-９]{1,3})[.．](?=[0-9０-９]{2,}[ \x{3000}]*[章回節节])", "$1")
    # the signs of list numerals come back as they were
    sign = F.when(text.contains("．") & ~text.contains("."), "．").otherwise(".")
    return F.replace(t, F.lit(mark), sign)


def local_fix(text: Column, kind: Column) -> Column:
    """The body of a line after a fix of one of the LOCAL kinds."""
    return (F.when(kind == "separator_line", separator_fix(text)).when(kind == "repeated_punct", repeated_fix(text)).when(kind == "dash_run", dash_fix(text))
            .when(kind == "homoglyph", latin(text)).when(kind == "noise_dot", dot_fix(text)).otherwise(text))


#: What a line must hold for a fix to change it.
_MAY_REPEAT = r"…|。。。|\.[. \x{3000}]"
_MAY_DASH = rf"[{_D}{_class(TILDES)}]{{2}}"
_MAY_DOT = r"[.．\x1e]"


def balance(text: Column) -> Column:
    """stack: the closers that are missing at the end, innermost last; stray: a closer came
    that nothing had opened."""
    def step(acc, c):
        closer = F.translate(c, OPENERS, CLOSERS)
        fits = (acc["stack"] != "") & (F.right(acc["stack"], F.lit(1)) == c)
        return (F.when(closer != c, F.struct(F.concat(acc["stack"], closer).alias("stack"), acc["stray"].alias("stray")))
                .when(fits, F.struct(F.left(acc["stack"], F.length(acc["stack"]) - 1).alias("stack"), acc["stray"].alias("stray")))
                .otherwise(F.struct(acc["stack"].alias("stack"), F.lit(True).alias("stray"))))

    marks = F.split(F.regexp_replace(text, f"[^{_class(OPENERS + CLOSERS)}]", ""), "")
    return F.aggregate(F.filter(marks, lambda c: c != ""), F.struct(F.lit("").alias("stack"), F.lit(False).alias("stray")), step)


def balanced(text: Column) -> Column:
    told = F.transform(F.array(balance(text)), lambda b: (b["stack"] == "") & ~b["stray"])
    return F.when(text.rlike(one_of(OPENERS + CLOSERS)), F.element_at(told, 1)).when(text.isNotNull(), F.lit(True))


def realigned(text: Column) -> Column:
    """Double and single curly quotes, the straight double one among the former, opened and
    closed in turn where their number is even and all pairs fit then; else null."""
    def one(t, family, opener, closer):
        parts = F.split(t, one_of(family), -1)
        turned = F.array_join(F.transform(parts, lambda p, i: F.concat(F.when(i == 0, "").when(i % 2 == 1, opener).otherwise(closer), p)), "")
        return F.when(F.size(parts) % 2 == 1, turned).otherwise(t)

    out = F.transform(F.transform(F.array(text), lambda t: one(t, "“”\"", "“", "”")), lambda t: one(t, "‘’", "‘", "’"))
    fits = F.element_at(F.transform(out, lambda t: F.when((t != text) & balanced(t), t)), 1)
    return F.when(text.rlike("[“”‘’\"]"), fits)


def plans(lines: DataFrame) -> DataFrame:
    """(doc_id, row, kind, start, end, after): lines start to end (exclusive) become after.
    Kinds as in KINDS; what has several right answers has no plan."""
    order = Window.partitionBy("doc_id").orderBy("row")
    # the expressions below cost far more than the bytes of a line tell
    rows = dealt(lines.withColumn("text", F.coalesce("text", F.lit(""))), "doc_id")
    near = F.array(*[F.lead("text", i).over(order) for i in (1, 2, 3)])
    rows = rows.withColumns({"_before": F.lag("text").over(order), "_next": F.lead("text").over(order), "_near": near})
    rows = rows.withColumns({"_i": indent_of(F.col("text")), "_t": body_of(F.col("text"))}).where("_t <> ''")
    t = F.col("_t")
    only_if = lambda pattern, new: F.when(t.rlike(pattern), new).otherwise(t)
    cut_at = rf"([{_class(SENTENCE_ENDS)}][{_class(CLOSERS)}])(?=[{_class(OPENERS)}])"
    rows = rows.withColumns({
        "_b": F.when(t.rlike(one_of(OPENERS + CLOSERS)), balance(t)).otherwise(F.struct(F.lit("").alias("stack"), F.lit(False).alias("stray"))),
        "_nb": body_of(F.coalesce("_next", F.lit(""))), "_pb": body_of(F.coalesce("_before", F.lit(""))), "_sep": separator_fix(t), "_rep": only_if(_MAY_REPEAT, repeated_fix(t)),
        "_dash": only_if(_MAY_DASH, dash_fix(t)), "_dot": only_if(_MAY_DOT, dot_fix(t)),
        "_cut": F.when(t.rlike(f"{cut_at}|\n"), F.split(F.regexp_replace(t, cut_at, "$1\n"), "\n"))})
    stray, stack = F.col("_b.stray"), F.col("_b.stack")
    full = lambda c: F.coalesce(F.trim(F.translate(c, "\t　", "  ")) != "", F.lit(False))
    rows = rows.withColumns({"_whole": F.when(stray, realigned(t)), "_broken": ~stray & (stack != "") & full(F.col("_next")) & balanced(F.concat("_t", "_nb"))})
    i, row, cut, whole, broken = F.col("_i"), F.col("row"), F.col("_cut"), F.col("_whole"), F.col("_broken")

    def plan(kind, ok, after, start=row, end=row + 1):
        return F.when(ok, F.struct(F.lit(kind).alias("kind"), start.cast("long").alias("start"), end.cast("long").alias("end"), after.alias("after")))

    def own(kind, new):
        return plan(kind, new != t, F.array(F.concat(i, new)))

    joined_before = F.array(F.concat(F.rtrim("_before"), t))
    leads = F.left(t, F.lit(1)).rlike(one_of(LEADING)) & ~t.startswith("。。。") & ~t.startswith("...")
    is_separator = F.col("_sep") != t
    # one closer too many or one that is turned round
    opens_next = F.coalesce(F.left(F.get(F.filter(F.transform("_near", lambda x: body_of(F.coalesce(x, F.lit("")))), lambda x: x != ""), F.lit(0)), F.lit(1)).rlike(one_of(OPENERS)), F.lit(False))
    marks = F.regexp_replace(t, f"[^{_class(OPENERS + CLOSERS)}]", "")
    first, second = F.left(marks, F.lit(1)), F.right(marks, F.lit(1))
    swapped = F.overlay(F.overlay(t, second, F.instr(t, first), F.lit(1)), first, F.instr(t, second), F.lit(1))
    turned = (F.length(marks) == 2) & (F.translate(second, OPENERS, CLOSERS) == first) & (first != second)
    lone = (F.length(marks) == 1) & first.rlike(one_of(CLOSERS))
    # the line before has opened what this one closes
    pb = balance(F.col("_pb"))
    continues = lone & full(F.col("_before")) & ~pb["stray"] & (pb["stack"] != "") & balanced(F.concat("_pb", "_t"))
    unpaired = (F.when(~stray, F.lit(None)).when(whole.isNotNull(), plan("unpaired", F.lit(True), F.array(F.concat(i, whole))))
                .when(t.contains('"'), F.lit(None))
                .when(turned, plan("unpaired", F.lit(True), F.array(F.concat(i, swapped))))
                .when(continues, plan("unpaired", F.lit(True), joined_before, row - 1))
                .when(lone, plan("unpaired", F.lit(True), F.array(F.concat(i, F.translate(first, CLOSERS, OPENERS), t)))))
    # opened and not closed, the sentence is over and the next line is no speech: the closers go behind
    closes = ~stray & (stack != "") & ~broken & F.right(t, F.lit(1)).rlike(one_of(SENTENCE_ENDS)) & ~opens_next & ~t.contains('"')
    kinds = suspicious(t)
    found = F.array_compact(F.array(
        plan("leading_punct", leads & full(F.col("_before")), joined_before, row - 1), unpaired,
        plan("unpaired", closes, F.array(F.concat(i, t, F.reverse(stack)))),
        plan("unclosed", broken, F.array(F.concat(F.rtrim("text"), F.col("_nb"))), row, row + 2),
        plan("missing_separator", F.size(cut) > 1, F.transform(cut, lambda p: F.concat(i, p))),
        own("separator_line", F.col("_sep")), F.when(~is_separator, own("repeated_punct", F.col("_rep"))), own("dash_run", F.col("_dash")),
        F.when(F.array_contains(kinds, "homoglyph"), own("homoglyph", latin(t))), own("noise_dot", F.col("_dot"))))
    return rows.select("doc_id", "row", F.explode(found).alias("p")).select("doc_id", "row", "p.*")


def chosen(found: DataFrame) -> DataFrame:
    """plans with `taken`: by start, end, row and kind, each that begins where no taken one
    goes on."""
    kind = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    rows = found.withColumn("_k", kind)
    order = Window.partitionBy("doc_id").orderBy("start", "end", "row", "_k")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_new", F.coalesce(F.col("start") >= reached, F.lit(True))).withColumn("_island", F.sum(F.when(F.col("_new"), 1).otherwise(0)).over(order))
    island = rows.groupBy("doc_id", "_island").agg(F.array_sort(F.collect_list(F.struct("start", "end", "row", "_k", "kind", "after"))).alias("_p"))

    def step(acc, p):
        ok = p["start"] >= acc["end"]
        return F.struct(F.when(ok, p["end"]).otherwise(acc["end"]).alias("end"), F.array_append(acc["out"], F.struct(p.alias("p"), ok.alias("taken"))).alias("out"))

    start = F.struct(F.lit(-1).cast("long").alias("end"), F.slice(F.transform("_p", lambda p: F.struct(p.alias("p"), F.lit(False).alias("taken"))), 1, 0).alias("out"))
    out = island.select("doc_id", F.explode(F.aggregate("_p", start, step)["out"]).alias("x"))
    return out.select("doc_id", "x.p.row", "x.p.kind", "x.p.start", "x.p.end", "x.p.after", "x.taken")


def applied(lines: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lines (doc_id, row, text) after the plans, and (doc_id, row, new_row) for every old
    row: the lines that it went into."""
    told = checkpointed(chosen(found))  # its parts read it several times
    taken = told.where("taken")
    covered = taken.select("doc_id", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("row"), F.col("start").alias("_at"))
    stays = lines.join(covered, ["doc_id", "row"], "left_anti").select("doc_id", F.col("row").alias("_at"), F.lit(0).alias("_pos"), "text")
    comes = taken.select("doc_id", F.col("start").alias("_at"), F.posexplode("after").alias("_pos", "text"))
    order = Window.partitionBy("doc_id").orderBy("_at", "_pos")
    new = stays.unionByName(comes).withColumn("new_row", (F.row_number().over(order) - 1).cast("long"))
    places = new.select("doc_id", "_at", "new_row")
    where = lines.select("doc_id", "row").join(covered, ["doc_id", "row"], "left").withColumn("_at", F.coalesce("_at", "row")).join(places, ["doc_id", "_at"]).select("doc_id", "row", "new_row")
    again = told.where("NOT taken").where(F.col("kind").isin(*LOCAL)).join(where, ["doc_id", "row"])
    kind = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    again = again.groupBy("doc_id", "new_row").agg(F.array_sort(F.collect_set(F.struct("start", "end", F.col("row").alias("r"), kind.alias("k"), "kind"))).alias("_again"))
    done = new.join(again, ["doc_id", "new_row"], "left")
    fixed = F.concat(indent_of(F.col("text")), F.aggregate("_again", body_of(F.col("text")), lambda t, k: local_fix(t, k["kind"])))
    return done.select("doc_id", F.col("new_row").alias("row"), F.when(F.col("_again").isNull(), F.col("text")).otherwise(fixed).alias("text")), where
