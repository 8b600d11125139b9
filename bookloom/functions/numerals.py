"""Chinese numerals as columns: reading numbers below 10^8 and writing them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bookloom.functions.chars import half_width_digits
from bookloom.functions.markup import bind

#: Numeral forms folded before reading: financial, simplified and variant forms.
FOLD_FROM = "〇壹貳參肆伍陸柒捌玖貮叁弍兩两拾佰仟万"
FOLD_TO = "零一二三四五六七八九二三二二二十百千萬"
#: Numbers above this count as no number.
MOST = 10 ** 9


def _with_units(text: Column) -> Column:
    """Value of a numeral with units such as 三千零五十 or 一億二千萬; bare 十 counts as one
    ten. One pass: what is closed by 萬 or 億, the section since, the last digit (-1: none)."""
    def state(total, section, digit):
        return F.struct(total.cast("long").alias("total"), section.cast("long").alias("section"), digit.cast("long").alias("digit"))

    def step(acc, c):
        unit = F.when(c == "十", 10).when(c == "百", 100).when(c == "千", 1000)
        large = F.when(c == "萬", 10_000).when(c == "億", 100_000_000)
        open_ = acc["section"] + F.greatest(acc["digit"], F.lit(0))
        return F.when(unit.isNotNull(), state(acc["total"], acc["section"] + F.when(acc["digit"] < 0, 1).otherwise(acc["digit"]) * unit, F.lit(-1))).when(
            large.isNotNull(), state(acc["total"] + open_ * large, F.lit(0), F.lit(-1))).when(
            c == "零", state(acc["total"], acc["section"], F.lit(-1))).otherwise(state(acc["total"], acc["section"], F.instr(F.lit("一二三四五六七八九"), c)))

    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(chars, state(F.lit(0), F.lit(0), F.lit(-1)), step, lambda acc: (acc["total"] + acc["section"] + F.greatest(acc["digit"], F.lit(0))).cast("double"))


def number(text: Column) -> Column:
    """Number that a numeral means, or 0 (Arabic of either width with decimals, digit by
    digit as 二〇一, or with units up to 萬 and 億); over MOST: 0."""
    def value(t):
        return F.when(t.rlike(r"^[0-9]{1,15}(\.[0-9]+)?$"), t.try_cast("double")).when(
            t.rlike("^[零一二三四五六七八九]+$"), F.translate(t, "零一二三四五六七八九", "0123456789").try_cast("double")).when(
            t.rlike("^[零一二三四五六七八九十百千萬億]{1,30}$"), _with_units(t))

    # bound, as each stands more than once
    return bind(bind(F.translate(half_width_digits(text), FOLD_FROM, FOLD_TO), value), lambda v: F.when(v <= MOST, v).otherwise(F.lit(0.0)))


def _four(n: Column) -> Column:
    """Numeral of 1..9999 with zeros between, without leading zeros."""
    out = []
    for place, unit in ((1000, "千"), (100, "百"), (10, "十"), (1, "")):
        digit = F.floor(n / place) % 10
        gap = F.when((n >= place * 10) & (F.floor(n / (place * 10)) % 10 == 0), F.lit("零")).otherwise("")
        out.append(F.when(digit == 0, "").otherwise(F.concat(gap, _numeral(digit), F.lit(unit))))
    return F.concat(*out)


def _numeral(d: Column) -> Column:
    return F.substring(F.lit("零一二三四五六七八九"), d.cast("int") + 1, F.lit(1))


def chinese(n: Column) -> Column:
    """Traditional numeral of 0 <= n < 10^8; 10..19 begin with 十."""
    def below(low):
        return bind(_four(low), lambda four: bind(F.floor(n / 10_000), lambda high: F.when(high == 0, four).otherwise(
            F.concat(_four(high), F.lit("萬"), F.when((low > 0) & (low < 1000), F.lit("零")).otherwise(""), four))))

    return F.when(n == 0, F.lit("零")).otherwise(F.regexp_replace(bind(n % 10_000, below), "^一十", "十"))
