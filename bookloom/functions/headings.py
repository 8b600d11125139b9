"""Headings of volumes, chapters and special sections as columns of a line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bookloom.functions.chars import BLANK, NUMBER, clean
from bookloom.functions.numerals import number

# Fixed values of the text format: units, words, markers.
CHAPTER_UNITS, VOLUME_UNITS = "章回節折幕", "卷部篇集季"
SPECIAL_WORDS = "序章|楔子|引子|前言|序|後記|尾聲|終章|番外|外傳|簡介|附錄"
#: What makes 第N部.. an ordinary word: 部分 and the like.
GLUED = "^第[^ 　]{1,8}?(部分|季度|回合|節課|集團|部門)"
TITLE_LIMIT = 40
MARKERS = (("[::x]", "exclude"), ("[::w]", "work"), ("[::t]", "special"), ("[::]", "include"))
FORBIDDEN_TAILS = "。，、；,;"


def marker(text: Column) -> Column:
    """Persistent marker at the end of a line, or none."""
    tail = F.lower(F.regexp_replace(text, "[ \t　]+$", ""))
    out = F.lit("none")
    for sign, name in reversed(MARKERS):
        out = F.when(tail.endswith(sign), name).otherwise(out)
    return out


def unmarked(text: Column) -> Column:
    return F.regexp_replace(text, r"[ \t　]*\[::[xXwWtT]?\][ \t　]*$", "")


def parts(text: Column) -> dict[str, Column]:
    """kind (volume, chapter, special or body), number_text, unit, number and name of a
    line."""
    t = clean(unmarked(text))
    formal = rf"^第({NUMBER})([{CHAPTER_UNITS}{VOLUME_UNITS}])(?:[ :：、　]+(.*))?$"
    unit = F.regexp_extract(t, formal, 2)
    special = F.regexp_extract(t, rf"^({SPECIAL_WORDS})(?:[ :：　]+.*)?$", 1)
    fits = (F.length(t) <= TITLE_LIMIT) & ~t.rlike(f"[{FORBIDDEN_TAILS}]$") & ~t.rlike(GLUED) & (marker(text) != "exclude")
    kind = F.when(~fits, "body").when(F.instr(F.lit(VOLUME_UNITS), unit) * F.length(unit) > 0, "volume").when(
        F.length(unit) > 0, "chapter").when(special != "", "special").otherwise("body")
    number_text = F.regexp_extract(t, formal, 1)
    return {"kind": kind, "number_text": number_text, "unit": unit, "number": F.when(unit != "", number(number_text)), "name": F.regexp_extract(t, formal, 3)}


def may_be_heading(text: Column) -> Column:
    """False for most body lines: parts() finds no heading in them, and end_mark() no end."""
    return text.rlike(f"^{BLANK}*[（(【]?[第本{''.join(w[0] for w in SPECIAL_WORDS.split('|'))}]")


def weak(text: Column) -> dict[str, Column]:
    """number (null beyond a long), separator style and body of "12. x", "12、x", "#12 x", "(12) x"."""
    pattern = r"^(#|\(|（)?([0-9]+)(\)|）)?([.、:： ]|)[ ]*(.*)$"
    t = clean(text)
    return {"number": F.regexp_extract(t, pattern, 2).try_cast("long"),
            "style": F.concat(F.regexp_extract(t, pattern, 1), F.lit("N"), F.regexp_extract(t, pattern, 3), F.regexp_extract(t, pattern, 4)),
            "body": F.regexp_extract(t, pattern, 5)}


def end_mark(text: Column) -> Column:
    """True for lines such as 第一卷終 or 本卷完."""
    return clean(text).rlike(f"^[（(【]?(第{NUMBER}|本)[{VOLUME_UNITS}][ 　]*(終|完|結束)[)）】]?$")
