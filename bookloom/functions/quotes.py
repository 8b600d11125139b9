"""Quote styles of a line, by a stack of what is open."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the text format: outer pair, inner pair ---------------------
STYLES = {"corner": "「」『』", "curly": "“”‘’"}
OUTER_OPEN, OUTER_CLOSE, INNER_OPEN, INNER_CLOSE = "「“", "」”", "『‘", "』’"
# ---------------------------------------------------------------------------------------
_CJK = r"[\x{3400}-\x{9FFF}\x{20000}-\x{3134F}]"
#: Stand-ins while a line is worked on: straight marks that are quotes, apostrophes.
_DOUBLE, _SINGLE, _BENT, _STRAIGHT = "\ue000", "\ue001", "\ue002", "\ue003"


def _paired(text: Column, mark: str, stand_in: str) -> Column:
    """Straight marks that come in pairs with Chinese between as stand-ins; an odd number of
    them stays."""
    parts = F.split(text, mark, -1)
    sign = lambda i: F.when(F.get(parts, i).rlike(_CJK), stand_in).otherwise(mark)
    # part i stands behind mark i; marks 1 and 2 are around part 1, marks 3 and 4 around part 3
    joined = F.array_join(F.transform(parts, lambda p, i: F.concat(F.when(i == 0, "").when(i % 2 == 1, sign(i)).otherwise(sign(i - 1)), p)), "")
    return F.when((F.size(parts) > 1) & (F.size(parts) % 2 == 1), joined).otherwise(text)


def in_style(text: Column, style: str) -> Column:
    """The quotes of a line in another style. Quotes with a direction keep their level, but an
    outer one that opens inside an outer one is inner; straight ones count in pairs around
    Chinese; apostrophes inside Latin words and lines without Chinese stay."""
    outer_open, outer_close, inner_open, inner_close = STYLES[style]
    t = F.regexp_replace(F.regexp_replace(text, "(?<=[A-Za-z])’(?=[A-Za-z])", _BENT), "(?<=[A-Za-z])'(?=[A-Za-z])", _STRAIGHT)
    t = _paired(_paired(t, '"', _DOUBLE), "'", _SINGLE)
    marks = OUTER_OPEN + OUTER_CLOSE + INNER_OPEN + INNER_CLOSE + _DOUBLE + _SINGLE
    tokens = F.regexp_extract_all(t, F.lit(f"[{marks}]|[^{marks}]+"), 0)

    def state(stack, out):
        return F.struct(stack.alias("stack"), out.alias("out"))

    def step(acc, c):
        # a letter for what is open: O and I by marks with a direction, D and d, S and s by straight ones
        top = F.right(acc["stack"], F.lit(1))
        outer_on_top = top.isin("O", "D", "S")
        push = lambda sign, inner, o, i: F.when(inner, state(F.concat(acc["stack"], F.lit(i)), F.concat(acc["out"], F.lit(inner_open)))).otherwise(
            state(F.concat(acc["stack"], F.lit(o)), F.concat(acc["out"], F.lit(outer_open))))
        rest = F.left(acc["stack"], F.greatest(F.length(acc["stack"]) - 1, F.lit(0)))
        closed = state(rest, F.concat(acc["out"], F.when(outer_on_top, outer_close).otherwise(inner_close)))
        lone = lambda sign: state(acc["stack"], F.concat(acc["out"], F.lit(sign)))
        open_ = acc["stack"] != ""
        return (F.when(c == _DOUBLE, F.when(top.isin("D", "d"), closed).otherwise(push(c, open_ & outer_on_top, "D", "d")))
                .when(c == _SINGLE, F.when(top.isin("S", "s"), closed).otherwise(push(c, open_ & outer_on_top, "S", "s")))
                .when(c.isin(*OUTER_OPEN), push(c, open_ & outer_on_top, "O", "I"))
                .when(c.isin(*INNER_OPEN), state(F.concat(acc["stack"], F.lit("I")), F.concat(acc["out"], F.lit(inner_open))))
                .when(c.isin(*OUTER_CLOSE), F.when(open_, closed).otherwise(lone(outer_close)))
                .when(c.isin(*INNER_CLOSE), F.when(open_, closed).otherwise(lone(inner_close)))
                .otherwise(state(acc["stack"], F.concat(acc["out"], c))))

    turned = F.aggregate(tokens, state(F.lit(""), F.lit("")), step)["out"]
    return F.when(text.rlike(_CJK), F.translate(turned, _BENT + _STRAIGHT, "’'")).otherwise(text)
