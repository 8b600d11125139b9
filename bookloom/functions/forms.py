"""Parts that the patterns of title lines are put together from. Patterns keep to what
Java's and RE2's regular expressions read alike."""

from __future__ import annotations

import re

# Fixed values of the text format -------------------------------
FIGURES = "0-9０-９"
NUMERALS = FIGURES + "一二兩两三四五六七八九十百千萬万億亿兆〇零壹貳贰參叁肆伍陸陆柒捌玖拾佰仟"
CHAPTER_UNITS, VOLUME_UNITS = "章回節节折幕", "部卷篇集季"
#: Units that titles without 第 go by as well.
BARE_CHAPTER_UNITS, BARE_VOLUME_UNITS = "章回節节", "卷部篇集"
HAN = r"\x{4E00}-\x{9FFF}"
# ---------------------------------------------------------------------------------------

#: Blanks inside a line.
S = r" \t\x{00A0}\x{3000}"
#: Blanks that may be missing; blanks that must be there.
B, BLANKS = f"[{S}]*", f"[{S}]+"


def spaced(*parts: str) -> str:
    """One behind the other, with or without blanks between."""
    return B.join(parts)


def group(part: str) -> str:
    return f"({part})"


def maybe(*choices: str) -> str:
    return f"(?:{'|'.join(choices)})?"


def one_of(signs: str) -> str:
    """A class of signs written plainly; ranges are not meant."""
    return "[" + "".join("\\" + c if c in r"\]^-[" else c for c in signs) + "]"


def words(*some: str) -> str:
    """Any of some words, the longest first."""
    return "|".join(re.escape(w) for w in sorted(dict.fromkeys(some), key=lambda w: (-len(w), some.index(w))))


def upto(chars: str, most: int) -> str:
    return f"[{chars}]{{1,{most}}}"


def ordinal(units: str, number: str) -> str:
    """第, a number and a unit, the last two as groups."""
    return spaced("第", group(number), group(f"[{units}]"))


def name(most: int, first_not: str = "") -> str:
    """A name of at most so many characters that begins and ends with no blank."""
    return rf"[^{first_not}{S}](?:.{{0,{most - 2}}}[^{S}])?"


def line(*parts: str, blanks: bool = False) -> str:
    """A whole line; blanks: also with blanks around."""
    return f"^{B if blanks else ''}{''.join(parts)}{B if blanks else ''}$"
