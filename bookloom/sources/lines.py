"""From raw text to lines: break normalisation, invisible characters, the line scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookloom.functions.chars import BLANK, clean

BOM, ZERO_WIDTH = r"\x{FEFF}", r"[\x{200B}\x{2060}]"
NONCHARACTERS = r"[\x{FDD0}\x{FDD1}]"
SUSPECT = r"[\x{E000}-\x{F8FF}\x{FFFD}\x{0080}-\x{009F}]"


def with_plain_breaks(text: Column) -> Column:
    """CRLF, CR and the Unicode separators as \\n; no-break space as space."""
    unix = F.regexp_replace(text, r"\r\n|\r|\x{2028}|\x{2029}", "\n")
    return F.regexp_replace(F.regexp_replace(unix, NONCHARACTERS, ""), r"\x{00A0}", " ")


def n_changed_breaks(text: Column) -> Column:
    """Breaks that were neither \\n nor \\r\\n."""
    rest = F.regexp_replace(text, r"\r\n", "\n")
    return F.regexp_count(rest, F.lit(r"\r|\x{2028}|\x{2029}")).cast("long")


def without_invisible(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, BOM, ""), ZERO_WIDTH, "")


def n_invisible(text: Column) -> Column:
    return (F.regexp_count(text, F.lit(BOM)) + F.regexp_count(text, F.lit(ZERO_WIDTH))).cast("long")


def looks_misdecoded(text: Column) -> Column:
    """Over 1 % private-use, replacement or control characters."""
    return F.length(F.regexp_replace(text, f"[^{SUSPECT[1:-1]}]", "")) * 100 > F.length(text)


def lines_of(docs: DataFrame) -> DataFrame:
    """lines (doc_id, row, text): rows count from 0."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("row", "text")).withColumn("row", F.col("row").cast("long"))


def joined(lines: DataFrame) -> DataFrame:
    """docs (doc_id, text) of lines, in row order. A document is one row again, so it is
    gathered by its own key only."""
    rows = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("row", "text"))).alias("rows"))
    return rows.select("doc_id", F.array_join(F.transform("rows", lambda r: r["text"]), "\n").alias("text"))


def with_neighbours(lines: DataFrame, *, blank: bool = False) -> DataFrame:
    """lines with previous and next non-blank text (or any, with blank=True)."""
    by_row = Window.partitionBy("doc_id").orderBy("row")
    own = F.col("text") if blank else F.when(clean(F.col("text")) != "", F.col("text"))
    return lines.withColumns({
        "before": F.last(own, ignorenulls=True).over(by_row.rowsBetween(Window.unboundedPreceding, -1)),
        "after": F.first(own, ignorenulls=True).over(by_row.rowsBetween(1, Window.unboundedFollowing))})


def file_kind(path: Column) -> Column:
    """txt, docx, epub or other, by extension."""
    low = F.lower(path)
    return F.when(low.endswith(".docx"), "docx").when(low.endswith(".epub"), "epub").when(low.endswith(".txt"), "txt").otherwise("other")


def book_meta(name: Column) -> dict[str, Column]:
    """title, author and status from a file name such as 《T》作者：A（完）.txt."""
    stem = F.regexp_replace(name, r"\.[A-Za-z0-9]{1,5}$", "")
    quoted = F.regexp_extract(stem, "《([^》]+)》", 1)
    framed = F.regexp_extract(stem, "【([^】]+)】", 1)
    bare = F.regexp_replace(F.regexp_replace(stem, "作者[:：].*$", ""), f"[（(][^（）()]*[)）]|{BLANK}+$", "")
    author = F.regexp_extract(stem, r"作者[:：] ?([^（(《【\[\] ]+)", 1)
    return {"title": F.coalesce(F.nullif(quoted, F.lit("")), F.nullif(framed, F.lit("")), clean(bare)), "author": author,
            "status": F.when(stem.rlike("完結|完本|全本|[（(]完[)）]"), "completed").when(stem.rlike("連載|未完"), "ongoing").otherwise("unspecified")}
