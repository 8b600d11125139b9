"""Character classes that mean the same to Java, RE2 and Python regular expressions, and
small column helpers over them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of book text: ASCII space, tab, no-break and ideographic space.
BLANK = r"[ \t\x{00A0}\x{3000}]"
BLANK_CHARS = " \t 　"
#: Digits of either width.
DIGIT = "[0-9０-９]"
#: Numerals that write a number in Chinese text.
CN_DIGITS = "零〇一二三四五六七八九"
CN_FINANCIAL = "壹貳參肆伍陸柒捌玖"
CN_UNITS = "十百千"
HAN = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]"
SENTENCE_END = "[。！？!?…]"
#: Number text of a heading.
NUMBER = f"[0-9０-９{CN_DIGITS}兩两十百千萬万]+"


def clean(text: Column) -> Column:
    """Without white space at either end, of either width."""
    return F.regexp_replace(F.regexp_replace(text, f"^{BLANK}+", ""), f"{BLANK}+$", "")


def without_blanks(text: Column) -> Column:
    return F.translate(text, BLANK_CHARS, "")


def char_count(text: Column) -> Column:
    """Characters other than white space."""
    return F.length(without_blanks(text)).cast("long")


def han_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, f"[^{HAN[1:-1]}]", "")).cast("long")


def half_width_digits(text: Column) -> Column:
    return F.translate(text, "０１２３４５６７８９", "0123456789")


def compact(text: Column) -> Column:
    """Lower case, no white space: the form repeated lines are compared in."""
    return F.lower(F.regexp_replace(text, r"[ \t\n\r\f]+", ""))
