"""Repeated lines, duplicated passages, markup residue, separators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookloom.functions.chars import compact
from bookloom.functions.markup import bind, decoded, untagged, without_forum_codes

MIN_LENGTH, MAX_LENGTH, MIN_COUNT = 12, 180, 3
PASSAGE_ROWS = 6
# Fixed values of the text format
OPENING_QUOTES, CLOSING_QUOTES = "[\"“「『]", "[\"”」』]"
SPEAKER = f"^[^:：“「『\"]{{1,8}}[:：]{OPENING_QUOTES}"
#: Up to three different letters; what was matched is not tried again.
FEW_LETTERS = r"^(.)\1*+(?:(.)(?:\1|\2)*+(?:(.)(?:\1|\2|\3)*+)?)?$"
SYSTEM = r"^[【\[][^】\]]{1,40}[】\]]$"


def is_dialogue_or_marks(form: Column) -> Column:
    """What stories repeat: speech in quotes, or behind a speaker's name; a message of a system in
    brackets; a sound (up to three different letters, one of them three times); or nothing but
    punctuation. form: compact."""
    sound = bind(F.regexp_replace(form, r"[^\p{L}\p{N}]", ""), lambda letters: letters.rlike(FEW_LETTERS) & letters.rlike(r"(.).*\1.*\1"))
    return (form.rlike(f"^{OPENING_QUOTES}") & form.rlike(f"{CLOSING_QUOTES}$")) | form.rlike(SPEAKER) | form.rlike(SYSTEM) | ~form.rlike(r"[\p{L}\p{N}]") | sound


def is_separator(text: Column) -> Column:
    """A line of one symbol, three times or more."""
    t = F.trim(text)
    return (F.length(t) >= 3) & t.rlike(r"^[-=*_~#+.]+$") & (F.replace(t, F.left(t, F.lit(1)), F.lit("")) == "")


def repeated_lines(lines: DataFrame, scope: str = "doc", min_count: int = MIN_COUNT) -> DataFrame:
    """(doc_id, form, n, first_row) of forms that occur min_count times; scope "corpus"
    counts over all documents and gives (form, n, n_docs)."""
    forms = lines.withColumn("form", compact(F.col("text"))).where(
        F.length("form").between(MIN_LENGTH, MAX_LENGTH) & ~is_dialogue_or_marks(F.col("form")))
    if scope == "corpus":
        return forms.groupBy("form").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_docs")).where(F.col("n") >= min_count)
    return forms.groupBy("doc_id", "form").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first_row")).where(F.col("n") >= min_count)


def without_passages(lines: DataFrame, found: DataFrame) -> DataFrame:
    """found (doc_id, form, n, ...) without forms that mostly occur in runs of
    PASSAGE_ROWS repeated lines or more: those are copied passages, not boilerplate. Only
    a line that is not repeated ends a run."""
    forms = lines.withColumn("form", compact(F.col("text"))).where("form <> ''")
    marked = forms.join(found.select("doc_id", "form", F.lit(1).alias("_hit")), ["doc_id", "form"], "left")
    by_row = Window.partitionBy("doc_id").orderBy("row")
    runs = marked.withColumn("_run", F.sum(F.when(F.col("_hit").isNull(), 1).otherwise(0)).over(by_row)).where("_hit = 1")
    size = runs.withColumn("_size", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "_run")))
    inside = size.groupBy("doc_id", "form").agg(F.count_if(F.col("_size") >= PASSAGE_ROWS).alias("n_inside"))
    return found.join(inside, ["doc_id", "form"]).where("2 * n_inside < n").drop("n_inside")


def rows_of_forms(lines: DataFrame, found: DataFrame) -> DataFrame:
    """Spans (doc_id, start, end) of the rows whose form was found."""
    forms = lines.withColumn("form", compact(F.col("text")))
    hit = forms.join(found.select("doc_id", "form"), ["doc_id", "form"], "left_semi")
    return hit.select("doc_id", F.col("row").alias("start"), F.col("row").alias("end"))


def markup_fixes(lines: DataFrame) -> DataFrame:
    """(doc_id, row, before, fix) of lines with references, tags or forum codes."""
    fix = without_forum_codes(untagged(decoded(F.col("text"))))
    return lines.select("doc_id", "row", F.col("text").alias("before"), fix.alias("fix")).where("fix <> before")


def separator_styles(lines: DataFrame) -> DataFrame:
    marked = lines.where(is_separator(F.col("text"))).select(F.left(F.trim("text"), F.lit(1)).alias("symbol"), "doc_id")
    return marked.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_docs"))


def top_by_confidence(candidates: DataFrame, n: int = 2000) -> DataFrame:
    """The n candidates of highest confidence, in document order."""
    rank = F.when(F.col("confidence") == "high", 0).when(F.col("confidence") == "medium", 1).otherwise(2)
    return candidates.orderBy(rank, "doc_id", "row").limit(n).orderBy("doc_id", "row")
