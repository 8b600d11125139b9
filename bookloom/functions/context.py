"""What decides about a line as a title besides its own grammar: end marks, notes behind a
name, full stops behind a short name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bookloom.functions.chars import clean
from bookloom.functions.forms import BARE_CHAPTER_UNITS, BARE_VOLUME_UNITS, CHAPTER_UNITS, FIGURES, VOLUME_UNITS, B, BLANKS, S, group, one_of, spaced, words
from bookloom.functions.markup import bind
from bookloom.functions.numerals import number
from bookloom.functions.titles import TITLE_LIMIT, fits_length, strip_body

# Fixed values of the text format -------------------------------------
END_WORDS = ("完結", "完结", "完本", "結束", "结束", "終了", "终了", "完", "終", "终")
_END_NUMERALS = FIGURES + "一二兩两三四五六七八九十百千萬万〇零"
#: Signs that don't count in an end mark.
_END_NOISE = "【】[]（）()「」『』〔〕《》〈〉<>·・:：-—~～!！。．.…*＊=＝"
END_LIMIT, NAMED_END_LIMIT, END_LINE_LIMIT, PERIOD_NAME_LIMIT = 16, 30, 40, 20
_NOT_NAMES = ("完結", "完结", "結束", "结束")
# ---------------------------------------------------------------------------------------
_END_NUMBER, _END_WORD = f"[{_END_NUMERALS}]+", f"(?:{words(*END_WORDS)})"
_ALL_UNITS = VOLUME_UNITS + CHAPTER_UNITS
_NAMED_END = (rf"^[【\[（(〔「『]?" + B + f"(?:{spaced('第', group(_END_NUMBER), group(f'[{VOLUME_UNITS}]'))}|{spaced(f'([{BARE_VOLUME_UNITS}])', group(_END_NUMBER))})"
              + BLANKS + rf"([^{S}【】\[\]（）()]{{1,12}})" + BLANKS + _END_WORD + B + r"[】\]）)〕」』]?$")
_PLAIN_END = f"^(?:第({_END_NUMBER})([{_ALL_UNITS}])|([{BARE_VOLUME_UNITS}])({_END_NUMBER})|[本全]([{VOLUME_UNITS}{BARE_CHAPTER_UNITS}])){_END_WORD}$"
#: A unit and 完 behind a name.
END_NOTE = rf"[{_ALL_UNITS}]{B}完本?[{S}】\]）)]*$"
_NOTED_NAME = rf"[（(【\[]?{B}本?[{_ALL_UNITS}]{B}完本?{B}[）)】\]]?{B}$"
_PERIOD = rf"[。.．]{B}$"
_FIRST_HEAD = "^" + spaced("第", "[1１一]", f"[{BARE_CHAPTER_UNITS}]") + r"[ \x{3000}:：\-—·、]"
_SENTENCE = "[。！？!?；;]"


def end_of(text: Column) -> Column:
    """level (volume or chapter), number (null: none is named), unit and name of a line that
    ends a volume or a chapter, such as 第一卷終, （本卷完） or 第一卷 山路 完; null elsewhere."""
    def fields(numeral, unit, name):
        value = F.when(numeral != "", number(numeral))
        whole = F.when((value > 0) & (value == F.floor(value)), value)
        return F.struct(F.when(F.lit(VOLUME_UNITS).contains(unit), "volume").otherwise("chapter").alias("level"), whole.alias("number"), unit.alias("unit"), name.alias("name"))

    def part(pattern, i):
        return lambda t: F.regexp_extract(t, pattern, i)

    def named(t):
        x = [part(_NAMED_END, i)(t) for i in range(1, 6)]
        return F.when((F.length(t) <= NAMED_END_LIMIT) & t.rlike(_NAMED_END), fields(F.concat(x[0], x[3]), F.concat(x[1], x[2]), x[4]))

    def plain(t):
        x = [part(_PLAIN_END, i)(t) for i in range(1, 6)]
        return F.when((F.length(t) <= END_LIMIT) & t.rlike(_PLAIN_END), fields(F.concat(x[0], x[3]), F.concat(x[1], x[2], x[4]), F.lit("")))

    bare = F.regexp_replace(text, rf"[{S}{one_of(_END_NOISE)[1:-1]}]", "")
    gate = text.rlike("[完結结終终]") & (F.length(text) <= END_LINE_LIMIT)
    return F.when(gate, F.coalesce(named(text), bind(bare, plain)))


def only_noted(text: Column, chapter: Column) -> Column:
    """Ends in a unit and 完 and has no name besides: no title. chapter: its parse, or null."""
    rest = clean(F.regexp_replace(F.regexp_replace(chapter["name"], _NOTED_NAME, ""), rf"^[{S}:：\-—·]+|[{S}:：\-—·]+$", ""))
    named = F.coalesce((chapter["kind"] == "numbered") & (F.length(rest) >= 2) & ~rest.isin(*_NOT_NAMES), F.lit(False))
    return text.rlike(END_NOTE) & ~named


def ends_in_period(text: Column, chapter: Column, limit: int = TITLE_LIMIT) -> Column:
    """follows: a title of 第, a number and a short name with a full stop behind, which is
    one only where its number follows on; first: it has number 1 and a sign before its
    name, and begins a count. Null for other lines."""
    name = F.regexp_replace(strip_body(chapter["name"]), rf"[{S}。.．]+$", "")
    short = (F.length(name) <= PERIOD_NAME_LIMIT) & ~name.rlike(_SENTENCE)
    candidate = (F.substring(text, 1, 4).contains("第") & text.rlike(_PERIOD) & fits_length(text, limit) & (chapter["kind"] == "numbered") & (chapter["number"] > 0) & short)
    first = (chapter["number"] == 1) & text.rlike(_FIRST_HEAD) & ~name.rlike("[，,]")
    return F.when(chapter.isNotNull() & candidate, F.when(first, "first").otherwise("follows"))
