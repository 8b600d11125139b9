"""Formatting of a line as columns: width of punctuation, spaces, indents, ellipses,
quotes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bookloom.functions.chars import HAN, clean

#: Half-width punctuation and its full-width form.
HALF, FULL = ",;:?!()", "，；：？！（）"
#: Quote styles: outer and inner pair.
CURLY, CORNER = "“”‘’", "「」『』"
_HAN = HAN[1:-1]


def full_width(text: Column) -> Column:
    return F.translate(text, HALF, FULL)


def half_width(text: Column) -> Column:
    return F.translate(text, FULL, HALF)


def corner_quotes(text: Column) -> Column:
    """Directional curly quotes as corner quotes."""
    return F.translate(text, CURLY, CORNER)


def collapsed_spaces(text: Column) -> Column:
    """No space between Chinese characters, one elsewhere, none at the ends."""
    one = F.regexp_replace(clean(text), r"[ \t\x{00A0}\x{3000}]+", " ")
    return F.regexp_replace(one, f"(?<=[{_HAN}]) (?=[{_HAN}])", "")


def indented(text: Column, width: int = 2) -> Column:
    body = clean(text)
    return F.when(body == "", "").otherwise(F.concat(F.lit("　" * width), body))


def ellipses(text: Column) -> Column:
    """Runs of full stops and dots as the six-dot ellipsis."""
    return F.regexp_replace(F.regexp_replace(text, "。{3,}|(…[ ]*){3,}", "……"), r"\.{6,}|(?<=[^\x{0000}-\x{007F}])\.{3,}", "……")


def dashes(text: Column) -> Column:
    """Runs of dashes between other characters as the two-cell dash."""
    return F.regexp_replace(text, "(?<=.)[—─]{3,}(?=.)", "——")


def _unmatched(chars: Column, opener: str, closer: str) -> Column:
    def step(acc, c):
        return F.struct((acc["open"] + F.when(c == opener, 1).when((c == closer) & (acc["open"] > 0), -1).otherwise(0)).alias("open"),
                        (acc["stray"] + F.when((c == closer) & (acc["open"] == 0), 1).otherwise(0)).alias("stray"))

    return F.aggregate(chars, F.struct(F.lit(0).alias("open"), F.lit(0).alias("stray")), step, lambda acc: acc["open"] + acc["stray"])


def n_unbalanced(text: Column) -> Column:
    """Openers without closer plus closers without opener, per pair, left to right."""
    total = F.lit(0)
    for opener, closer in ("「」", "『』", "“”", "（）", "《》", "【】"):
        total = total + _unmatched(F.split(F.regexp_replace(text, f"[^{opener}{closer}]", ""), ""), opener, closer)
    return total.cast("long")


def realigned_quotes(text: Column, opener: str = "“", closer: str = "”") -> Column:
    """An even number of the two quote marks, opener and closer in turn; else as it was."""
    marks = f"[{opener}{closer}]"
    n = F.regexp_count(text, F.lit(marks))
    parts = F.split(text, marks, -1)
    joined = F.array_join(F.transform(parts, lambda p, i: F.concat(F.when(i == 0, "").when(i % 2 == 1, opener).otherwise(closer), p)), "")
    return F.when((n > 0) & (n % 2 == 0), joined).otherwise(text)


def dialogue_lines(text: Column) -> Column:
    """array<string>: stuck dialogue split before each opener that follows a closer."""
    return F.split(F.regexp_replace(text, "([」”])(?=[「“])", "$1\n"), "\n")


def hosts(text: Column) -> Column:
    """array<string>: domains and IPv4 addresses named in a line, lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"((?:[a-z0-9-]+\.)+(?:com|net|org|cc|info|cn|tw|hk|me|io|tv|biz|xyz|top|vip|club)|[0-9]{1,3}(?:\.[0-9]{1,3}){3})"), 1)
