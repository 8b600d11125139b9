"""Character references, tags and forum codes in lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Named references that are decoded; others stay as they are.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&hellip;", "…"), ("&mdash;", "—"),
            ("&ndash;", "–"), ("&ldquo;", "“"), ("&rdquo;", "”"), ("&lsquo;", "‘"), ("&rsquo;", "’"), ("&middot;", "·"), ("&bull;", "•"), ("&laquo;", "«"), ("&raquo;", "»"),
            ("&emsp;", " "), ("&ensp;", " "), ("&thinsp;", " "), ("&amp;", "&"))
#: A reference by number, or one of those by name.
REFERENCE = "&#(?:[0-9]{2,7}|[xX][0-9a-fA-F]{2,6});|&(?:" + "|".join(name[1:-1] for name, _ in ENTITIES) + ");"
#: Codes of spaces that become plain ones.
SPACES = (0xA0, 0x2002, 0x2003, 0x2009)
#: What Windows means by 128 to 159; codes that it leaves undefined stand for themselves.
WINDOWS = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(0x80, 0xA0))
BLOCK_TAG = r"(?i)</?(p|div|br)( [^<>]*)?/?>"
INLINE_TAG = r"(?i)</?(b|i|u|em|strong|font|span|a|sup|sub|center)( [^<>]*)?/?>"


def _char(code: Column) -> Column:
    """The character of a code point; of 128 to 159 what Windows means by them, of what is no
    character U+FFFD, of control characters none."""
    windows = F.substr(F.lit(WINDOWS), code.cast("int") - 0x7F, F.lit(1))
    plain = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    control = code.between(1, 8) | code.between(14, 31) | (code == 11) | (code == 127) | code.between(0xFDD0, 0xFDEF) | (code.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    return F.when((code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF), F.lit("\ufffd")).when(
        code.between(0x80, 0x9F), windows).when(control, F.lit("")).when(code.isin(*SPACES), F.lit(" ")).otherwise(plain)


def _reference(found: Column) -> Column:
    named = F.create_map(*[F.lit(x) for pair in ENTITIES for x in pair])
    number = F.when(F.lower(F.left(found, F.lit(3))) == "&#x", F.conv(F.regexp_extract(found, "[0-9a-fA-F]+", 0), 16, 10)).when(found.startswith("&#"), F.regexp_extract(found, "[0-9]+", 0))
    return F.coalesce(F.try_element_at(named, found), bind(number.cast("long"), _char))


def decoded(text: Column) -> Column:
    """Named and numeric character references as characters, once: what a reference gives is
    read no further. Spaces of any width are plain ones; other references stay."""
    plain = text
    for name, char in ENTITIES:
        plain = F.replace(plain, F.lit(name), F.lit(char))

    def both(t):
        pieces, found = F.split(t, REFERENCE, -1), F.regexp_extract_all(t, F.lit(REFERENCE), 0)
        return F.array_join(F.zip_with(pieces, found, lambda piece, ref: F.concat(piece, F.when(ref.isNull(), "").otherwise(_reference(ref)))), "")

    return F.when(text.contains("&#"), bind(text, both)).otherwise(plain)


def bind(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def untagged(text: Column) -> Column:
    """Known tags taken out; a block tag or br between texts breaks the line, and pieces
    without text go."""
    broken = F.regexp_replace(F.regexp_replace(text, INLINE_TAG, ""), BLOCK_TAG, "\n")
    return F.array_join(F.filter(F.split(broken, "\n"), lambda x: F.regexp_replace(x, "[ \t]+", "") != ""), "\n")


def without_forum_codes(text: Column) -> Column:
    """[b]..[/b] and the like taken out where both ends are on the line."""
    out = text
    for code in ("b", "i", "u", "quote", "color", "size", "url"):
        start, end = rf"(?i)\[{code}(=[^\[\]]*)?\]", rf"(?i)\[/{code}\]"
        out = bind(out, lambda x: F.when(x.rlike(start) & x.rlike(end), F.regexp_replace(x, rf"(?i)\[/?{code}(=[^\[\]]*)?\]", "")).otherwise(x))  # noqa: B023
    return F.when(text.contains("[/"), out).otherwise(text)


def html_lines(html: Column) -> Column:
    """array<string>: the visible text of a page, a line per block, by expressions only."""
    shown = F.regexp_replace(html, r"(?is)<(script|style|head|title)[ >].*?</(script|style|head|title)>|<!--.*?-->", " ")
    blocks = F.regexp_replace(shown, r"(?i)</?(p|div|br|h[1-6]|li|ul|ol|article|nav|footer|section|tr|table|blockquote)( [^<>]*)?/?>", "\n")
    plain = decoded(F.regexp_replace(blocks, "<[^<>]*>", ""))
    return F.filter(F.transform(F.split(plain, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t]+", " "))), lambda x: x != "")
