"""Punctuation problems of lines and the fixes that have one right answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bookloom.functions import formats
from bookloom.functions.chars import clean

#: Kinds and the predicate of the clean line that shows each.
KINDS = {
    "leading_mark": "^[，。、；：！？」』”]", "empty_quote": "「」|『』|“”", "stuck_dialogue": "[」”][「“]", "repeated_mark": "。{2,}|，{2,}|！{4,}|？{4,}",
    "dash_run": ".[—─]{3,}.", "long_separator": "^[-=*_~]{4,}$",
}


def problems(lines: DataFrame) -> DataFrame:
    """(doc_id, row, kind) for every problem of a line; `unclosed` is a line break if the
    next line closes what this one opened."""
    own, after = formats.n_unbalanced(F.col("text")), F.lead("text").over(Window.partitionBy("doc_id").orderBy("row"))
    rows = lines.withColumns({"_n": own, "_joined": F.when(own > 0, formats.n_unbalanced(F.concat("text", F.coalesce(after, F.lit("")))))})
    found = F.array_compact(F.array(
        *[F.when(clean(F.col("text")).rlike(pattern), kind) for kind, pattern in KINDS.items()],
        F.when(F.col("_n") > 0, F.when(F.col("_joined") == 0, "broken_line").otherwise("unclosed"))))
    return rows.select("doc_id", "row", F.explode(found).alias("kind"))


def fixed(lines: DataFrame) -> DataFrame:
    """(doc_id, row, before, fix) of lines that ellipsis, dash and dialogue rules change;
    separators become three of their symbol."""
    text = F.array_join(formats.dialogue_lines(formats.dashes(formats.ellipses(F.col("text")))), "\n")
    fix = F.when(clean(F.col("text")).rlike(KINDS["long_separator"]), F.repeat(F.left(clean(F.col("text")), F.lit(1)), F.lit(3))).otherwise(text)
    return lines.select("doc_id", "row", F.col("text").alias("before"), fix.alias("fix")).where("fix <> before")


def inline_adverts(lines: DataFrame, min_lines: int = 3, min_rest: int = 20) -> DataFrame:
    """(host, n_lines) of hosts named in min_lines lines that say something else too."""
    named = lines.select("doc_id", "row", F.length("text").alias("_n"), F.explode(F.array_distinct(formats.hosts(F.col("text")))).alias("host"))
    rest = named.where(F.col("_n") - F.length("host") >= min_rest)
    return rest.groupBy("host").agg(F.count(F.lit(1)).alias("n_lines")).where(F.col("n_lines") >= min_lines)
