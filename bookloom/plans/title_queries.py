"""Queries over the title grammar and rules. Lines are made from the orders: forms of titles
and near misses, filled with the orders' numbers and words; the SQL parses them anew."""

from __future__ import annotations

from pyspark.sql import functions as F

from bookloom.functions import rules, titles
from bookloom.operators import contents
from bookloom.plans.derived import table

_CN = "translate(CAST(n AS STRING), '0123456789', '〇一二三四五六七八九')"
_FORMS = (
    "concat('第', n, '章 ', p)", f"concat('第', {_CN}, '回：', p)", "concat('第', n, '-', n + k % 14, '章 ', p)", "concat('第', n, '、', n % 7 + 1, '章 ', p)", "concat('第', n, '.5章 ', p)",
    f"concat(s, '青雲 第', {_CN}, '章')", f"concat('第', {_CN}, '卷 ', s, '山 第', n, '章 ', p)", "concat('番外', n, ' ', p)", f"concat('第', {_CN}, '卷 ', p)", "concat('外傳之', p)",
    "concat('第', n, '部分是', p)", "concat('#', n, ' ', p)", "concat('(', n, ') ', p)", "concat(n, '、', p)", "concat(n % 9 + 1, '-', n, ' ', p)", "concat('正文 第', n, '章 ', p)",
    "concat('第.', n, '章 ', p)", "concat('第', n % 9 + 1, 'oO章 ', p)", "concat('序章 ', p)", "concat('後記。', p)", "concat('序幕拉開', p)", "concat('Chapter ', n, ': ', p)", "concat('Sec. ', n)",
    "concat(n, '章 ', p)", f"concat('卷', {_CN}, ' ', p)", "concat('上卷：', p)", "concat(s, '青雲篇')", "concat('第一季', p)", "concat('PS：第', n, '章 ', p)", "concat('第', n, '章會晚一點，', p)",
    "concat(p, '，他說。')", "concat('第', n, '章 ', repeat(p, CAST(n % 12 AS INT)))", "concat('第', n, '章「', p, '」')", "concat('第', n, '章：')", "concat('第', n, '章 ', p, '。')",
    f"concat('【第', {_CN}, '集·第', n, '章】')", f"concat('第', {_CN}, '卷（', n % 9 + 1, '、', s, '）')", "concat('第', n, '章 ', p, '...')", "concat('第', n, '章 ', p, '.')",
    "concat(n, '③〇④', n % 100, '⑤ ', s)", "concat('第', n, '章  ', p, '   ', s)", "concat('第', n, '章', chr(9), p)", "concat('　　', p, '。', s)", "concat('第572章 番外之', n, '：第', n, '章 ', p)")
_TEXT = "CASE " + " ".join(f"WHEN k % {len(_FORMS)} = {i} THEN {form}" for i, form in enumerate(_FORMS)) + " END"
ROWS = 400


def title_lines(spark, sf_dir):
    """(doc_id, row, text)"""
    orders = table(spark, sf_dir, "orders").selectExpr(
        f"o_orderkey % {ROWS} AS row", f"CAST(floor(o_orderkey / {ROWS}) AS BIGINT) AS doc_id", "o_orderkey * 7 % 997 + 1 AS n", "o_orderkey + o_custkey % 5 AS k", "o_orderpriority AS p", "o_orderstatus AS s")
    # dealt by book before they are parsed, as the windows behind need them
    return orders.selectExpr("doc_id", "row", f"{_TEXT} AS text").repartition(spark.sparkContext.defaultParallelism, "doc_id")


LINES = f"""tl AS (
  SELECT doc_id, row, {_TEXT.replace('AS STRING', 'AS VARCHAR')} AS text
  FROM (SELECT o_orderkey % {ROWS} AS row, CAST(floor(o_orderkey / {ROWS}) AS BIGINT) AS doc_id, o_orderkey * 7 % 997 + 1 AS n, o_orderkey + o_custkey % 5 AS k, o_orderpriority AS p, o_orderstatus AS s FROM orders))"""
S = titles.S


def _x(pattern: str, i: int, text: str = "text") -> str:
    return f"regexp_extract({text}, '{pattern}', {i})"


def _is(pattern: str, text: str = "text") -> str:
    return f"regexp_matches({text}, '{pattern}')"


def _value(text: str) -> str:
    """Figures of either width with decimals, or Chinese ones digit by digit; 十 alone."""
    return f"coalesce(CASE WHEN {text} = '十' THEN 10.0 END, try_cast(translate({text}, '０１２３４５６７８９．〇零一二三四五六七八九', '0123456789.00123456789') AS DOUBLE), 0.0)"


def _columns(spark, sf_dir, name, column, *fields):
    rows = title_lines(spark, sf_dir).select("doc_id", "row", column.alias("x")).where("x IS NOT NULL")
    return rows.select("doc_id", "row", *[F.col(f"x.{f}").alias(f) for f in fields])


def _cleaned(body: str) -> str:
    return f"regexp_replace(regexp_replace({body}, '^[{S}，,、:：．.\\-—·]+', ''), '[{S}。、]+$', '')"


_REPAIRED = f"""fixed AS (
  SELECT doc_id, row, CASE WHEN regexp_matches(d, '[oO]') THEN concat(substring(t, 1, strpos(t, d) - 1), translate(d, 'oO', '00'), substring(t, strpos(t, d) + length(d))) ELSE t END AS text
  FROM (SELECT *, regexp_extract(t, '第[{S}]*([0-9][0-9oO]*)[{S}]*[章回節节]', 1) AS d
        FROM (SELECT doc_id, row, regexp_replace(text, '第([{S}]*)[.．][{S}]*([0-9０-９])', '第\\1\\2') AS t FROM tl)))"""
_NOISE_SQL = ", ".join(f"'{w.lower()}'" for w in titles.NOISE)
_OUTER = f"({_x(titles.CHAPTER, 1)} <> '' AND {_is(titles.OUTER_CHAPTER)} AND {_x(titles.OUTER_CHAPTER, 2)} = {_x(titles.CHAPTER, 6)})"
F03 = f"""WITH {LINES}, {_REPAIRED},
parsed AS (
  SELECT doc_id, row, {_is(titles.CHAPTER)} AS formal, {_OUTER} AS o, {_x(titles.CHAPTER, 1)} AS w, {_x(titles.CHAPTER, 2)} AS v, {_x(titles.CHAPTER, 3)} AS n, {_x(titles.CHAPTER, 4)} AS also,
         {_x(titles.CHAPTER, 5)} AS last, {_x(titles.CHAPTER, 6)} AS u, {_x(titles.CHAPTER, 7)} AS b, {_x(titles.OUTER_CHAPTER, 1)} AS on_, {_x(titles.OUTER_CHAPTER, 2)} AS ou, {_x(titles.OUTER_CHAPTER, 3)} AS ob,
         {_is(titles.SIDE_STORY)} AS side, {_x(titles.SIDE_STORY, 1)} AS sw, {_x(titles.SIDE_STORY, 2)} AS sv, {_x(titles.SIDE_STORY, 3)} AS sn, {_x(titles.SIDE_STORY, 4)} AS su, {_x(titles.SIDE_STORY, 5)} AS sb FROM fixed),
rows AS (
  SELECT doc_id, row, CASE WHEN o THEN '' ELSE w END AS work, CASE WHEN o THEN '' ELSE v END AS volume, 'numbered' AS kind, CASE WHEN o THEN on_ ELSE n END AS number_text,
         CASE WHEN o THEN '' ELSE also END AS also, CASE WHEN o THEN '' ELSE last END AS range_end_text, CASE WHEN o THEN ou ELSE u END AS unit, CASE WHEN o THEN ob ELSE b END AS name
  FROM parsed WHERE formal AND (o OR last = '' OR ({_value('n')} = floor({_value('n')}) AND {_value('n')} < {_value('last')} AND {_value('last')} <= {_value('n')} + 10))
  UNION ALL SELECT doc_id, row, sw, sv, 'side', sn, '', '', su, sb FROM parsed WHERE side AND NOT formal)
SELECT doc_id, row, CASE WHEN lower(trim(work)) IN ({_NOISE_SQL}) THEN '' ELSE work END AS work, volume, kind, {_value('number_text')} AS number, number_text, also, range_end_text, unit, name FROM rows"""


def f03_chapters(spark, sf_dir):
    return _columns(spark, sf_dir, "c", titles.chapter(F.col("text")), "work", "volume", "kind", "number", "number_text", "also", "range_end_text", "unit", "name")


_V, _NV = titles.VOLUME, titles.NAMED_VOLUME
F04 = f"""WITH {LINES},
p AS (SELECT doc_id, row, {_is(_V)} AS numbered, {_is(_NV)} AS named, {_x(_V, 1)} AS w, {_x(_V, 2)} AS n, {_x(_V, 3)} AS u, {_x(_V, 4)} AS b, {_x(_NV, 1)} AS nw, {_x(_NV, 2)} AS nu,
         regexp_replace(concat({_x(_NV, 3)}, {_x(_NV, 4)}, {_x(_NV, 5)}), '^[{S}】\\])-]*', '') AS nb FROM tl),
rows AS (SELECT doc_id, row, w AS work, n AS number_text, u AS unit, b AS name FROM p WHERE numbered AND NOT {_is(titles.CHAPTER_INSIDE, 'w')}
  UNION ALL SELECT doc_id, row, nw, '', nu, nb FROM p WHERE named AND NOT numbered AND NOT {_is(titles.CHAPTER_INSIDE, 'nw')})
SELECT doc_id, row, CASE WHEN lower(trim(work)) IN ({_NOISE_SQL}) THEN '' ELSE work END AS work, {_value('number_text')} AS number, number_text, unit, name FROM rows"""


def f04_volumes(spark, sf_dir):
    return _columns(spark, sf_dir, "v", titles.volume(F.col("text")), "work", "number", "number_text", "unit", "name")


F05 = f"""WITH {LINES} SELECT doc_id, row, CASE WHEN lower(trim({_x(titles.SPECIAL, 1)})) IN ({_NOISE_SQL}) THEN '' ELSE {_x(titles.SPECIAL, 1)} END AS work,
  {_x(titles.SPECIAL, 2)} AS volume, {_x(titles.SPECIAL, 3)} AS word, regexp_replace({_x(titles.SPECIAL, 4)}, '^[{S}】\\])-]*', '') AS name FROM tl WHERE {_is(titles.SPECIAL)}"""


def f05_specials(spark, sf_dir):
    return _columns(spark, sf_dir, "s", titles.special(F.col("text")), "work", "volume", "word", "name")


_M, _P, _SHORT = titles.MIXED, titles.MIXED_PAREN, titles.MIXED_SHORT
_MIXED_FIELDS = ("volume", "volume_number_text", "volume_unit", "volume_note", "volume_name", "number_text", "unit", "name")


def _mixed_row(pattern, order):
    raw = [_x(pattern, i, "inner_") if i else "''" for i in order]
    out = [f"regexp_replace({raw[0]}, '[{S}]', '', 'g')", *raw[1:4], f"regexp_replace(regexp_replace({raw[4]}, '^[{S}:：\\-—·・•▪]+', ''), '[{S}:：\\-—·・•▪]+$', '')", raw[5], raw[6] if order[6] else "'章'",
           f"regexp_replace({raw[7]}, '[{S}]*[（(][{S}]*(修|修改|校對|校对|補|补)[{S}]*[）)][{S}]*$', '')"]
    return ", ".join(f"{x} AS {f}" for x, f in zip(out, _MIXED_FIELDS))


F06 = f"""WITH {LINES},
i AS (SELECT doc_id, row, text, CASE WHEN {_is(titles.WHOLE_BRACKET)} THEN {_x(titles.WHOLE_BRACKET, 1)} ELSE text END AS inner_ FROM tl WHERE length(text) <= 120 AND text LIKE '%第%')
SELECT doc_id, row, {_mixed_row(_P, (1, 2, 3, 0, 0, 4, 0, 5))} FROM i WHERE {_is(_P)}
UNION ALL SELECT doc_id, row, {_mixed_row(_M, (1, 2, 3, 4, 5, 6, 7, 8))} FROM i WHERE NOT {_is(_P)} AND {_is(_M, 'inner_')}
UNION ALL SELECT doc_id, row, {_mixed_row(_SHORT, (1, 3, 2, 4, 5, 6, 7, 8))} FROM i WHERE NOT {_is(_P)} AND NOT {_is(_M, 'inner_')} AND {_is(_SHORT, 'inner_')}"""


def f06_mixed_headers(spark, sf_dir):
    return _columns(spark, sf_dir, "m", titles.mixed(F.col("text"), short_volume=True), *_MIXED_FIELDS)


_W = titles.WEAK
F07 = f"""WITH {LINES}, w AS (
  SELECT doc_id, row, CASE WHEN {_is(_W['volume-chapter'])} THEN 'volume-chapter' WHEN {_is(_W['hash'])} THEN 'hash' WHEN {_is(_W['bracket'])} THEN 'bracket' WHEN {_is(_W['plain'])} THEN 'plain' END AS style, text FROM tl),
f AS (SELECT doc_id, row, style,
  CASE style WHEN 'volume-chapter' THEN {_x(_W['volume-chapter'], 2)} WHEN 'hash' THEN {_x(_W['hash'], 1)} WHEN 'bracket' THEN {_x(_W['bracket'], 1)} ELSE {_x(_W['plain'], 1)} END AS number_text,
  CASE style WHEN 'volume-chapter' THEN {_x(_W['volume-chapter'], 3)} WHEN 'hash' THEN {_x(_W['hash'], 2)} WHEN 'bracket' THEN {_x(_W['bracket'], 2)} ELSE {_x(_W['plain'], 3)} END AS name,
  CASE style WHEN 'volume-chapter' THEN {_x(_W['volume-chapter'], 1)} ELSE '' END AS volume_text,
  CASE style WHEN 'plain' THEN translate(regexp_replace({_x(_W['plain'], 2)}, '[{S}]', '', 'g'), '．，：', '.,:') ELSE '' END AS sign FROM w WHERE style IS NOT NULL)
SELECT doc_id, row, style, CAST({_value('number_text')} AS BIGINT) AS number, number_text, volume_text, CASE WHEN style = 'plain' AND sign = '' THEN ' ' ELSE sign END AS sign, name
FROM f WHERE {_value('number_text')} > 0 AND (style = 'volume-chapter' OR name <> '') AND (style <> 'volume-chapter' OR {_value('volume_text')} > 0)"""


def f07_weak_forms(spark, sf_dir):
    return _columns(spark, sf_dir, "w", titles.weak(F.col("text")), "style", "number", "number_text", "volume_text", "sign", "name")


def f08_range_ends(spark, sf_dir):
    return title_lines(spark, sf_dir).select("doc_id", "row", titles.range_end(F.col("text")).alias("range_end")).where("range_end IS NOT NULL")


F08 = f"""WITH {LINES}, r AS (SELECT doc_id, row, {_value(_x(titles.RANGE, 1))} AS a, {_value(_x(titles.RANGE, 2))} AS b FROM tl WHERE {_is(titles.RANGE)})
SELECT doc_id, row, CAST(b AS BIGINT) AS range_end FROM r WHERE a = floor(a) AND a < b AND b <= a + 10"""

_BLOCKED = "，,。：:；;、”’"
_TAIL = f"right(regexp_replace(text, '[{S}]+$', ''), 3)"
_FORBIDDEN = f"(regexp_matches({_TAIL}, '[{_BLOCKED}]$') OR ({_TAIL} LIKE '%.' AND NOT regexp_matches({_TAIL}, '\\.[ \\x{{3000}}]?\\.$')))"
_LENGTH = "length(" + "regexp_replace(" * 4 + "text" + "".join(f", '{b}+', '{b}', 'g')" for b in (" ", "\t", "　", " ")) + ")"
_HEAD = rf"^第[{S}]*{titles.N}[{S}]*[章回節节][{S}:：\-—·、]+([^{S}].*)$"


def _closes(a, b):
    return f"length(regexp_replace({_x(_HEAD, 1)}, '[^{a}]', '', 'g')) <= length(regexp_replace({_x(_HEAD, 1)}, '[^{b}]', '', 'g'))"


_FITS = f"({_LENGTH} <= 40 OR ({_is(_HEAD)} AND {_LENGTH} <= 100 AND {_x(_HEAD, 1)} NOT LIKE '%。%' AND {_closes('“', '”')} AND {_closes('「', '」')} AND {_closes('『', '』')}))"


def f09_f10_limits(spark, sf_dir):
    t = F.col("text")
    return title_lines(spark, sf_dir).select(
        "doc_id", "row", titles.forbidden_tail(t).alias("forbidden_tail"), titles.forbidden_tail(t, "？?。.", "」").alias("forbidden_by_choice"), titles.title_length(t).alias("title_length"), titles.fits_length(t).alias("fits"))


F09 = f"""WITH {LINES} SELECT doc_id, row, {_FORBIDDEN} AS forbidden_tail,
  (regexp_matches({_TAIL}, '[！!…～~，,：:；;、”’」]$') OR regexp_matches({_TAIL}, '\\.[ \\x{{3000}}]?\\.$')) AS forbidden_by_choice, CAST({_LENGTH} AS INT) AS title_length, {_FITS} AS fits FROM tl"""


def f12_no_headings(spark, sf_dir):
    return title_lines(spark, sf_dir).select("doc_id", "row", titles.no_heading(F.col("text")).alias("reason")).where("reason IN ('note', 'end_sentence', 'unit_word', 'sentence', 'name')")


F12 = f"""WITH {LINES}, r AS (SELECT doc_id, row, CASE {' '.join(f"WHEN {_is(p)}{f' AND NOT {_is(but)}' if but else ''} THEN '{n}'" for n, (p, but) in titles.NO_HEADING.items())} END AS reason FROM tl)
SELECT doc_id, row, reason FROM r WHERE reason IS NOT NULL"""

_PLACE = rf"^(.*?第[{S}]*)({titles.DECIMAL})[{S}]*(?:(?:[、，,]|{titles.RANGE_MARK})[{S}]*{titles.N}[{S}]*)?[{titles.CHAPTER_UNITS}]"
_VPLACE = rf"^(.*?第[{S}]*)({titles.N})[{S}]*[{titles.VOLUME_UNITS}]"


def f14_renumbered(spark, sf_dir):
    """Titles with figures, 1000 higher."""
    rows = title_lines(spark, sf_dir).withColumn("x", titles.number_place(F.col("text"))).where(F.col("x.number_text").rlike("^[0-9]+$"))
    n = F.col("x.number_text").cast("long") + 1000
    return rows.select("doc_id", "row", F.col("x.number_text").alias("number_text"), F.col("x.place").alias("place"), titles.renumbered(F.col("text"), n).alias("renumbered"))


F14 = f"""WITH {LINES}, p AS (SELECT *, CASE WHEN {_is(_PLACE)} THEN {_x(_PLACE, 2)} WHEN {_is(_VPLACE)} THEN {_x(_VPLACE, 2)} END AS number_text,
  CASE WHEN {_is(_PLACE)} THEN length({_x(_PLACE, 1)}) + 1 ELSE length({_x(_VPLACE, 1)}) + 1 END AS place FROM tl)
SELECT doc_id, row, number_text, CAST(place AS INT) AS place, concat(substring(text, 1, place - 1), CAST(CAST(number_text AS BIGINT) + 1000 AS VARCHAR), substring(text, place + length(number_text))) AS renumbered
FROM p WHERE regexp_matches(number_text, '^[0-9]+$')"""


def f15_settled_numbers(spark, sf_dir):
    """Numbers of lines with a dot, or digit by digit, settled by the one before."""
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_orderkey % 900 + 100 AS n").withColumn("form", F.col("o_orderkey") % 3)
    text = F.when(F.col("form") == 0, F.concat(F.floor(F.col("n") / 100).cast("string"), F.lit("."), F.lpad((F.col("n") % 100).cast("string"), 2, "0"))).when(
        F.col("form") == 1, F.expr("concat(translate(CAST(floor(n / 10) AS STRING), '0123456789', '零一二三四五六七八九'), '零', substring('一二三四五六七八九', CAST(n % 9 AS INT) + 1, 1))")).otherwise(F.col("n").cast("string"))
    from bookloom.functions.numerals import number

    return rows.withColumn("number_text", text).select("o_orderkey", "number_text", titles.resolved_number(number(F.col("number_text")), F.col("number_text"), (F.col("n") - 1).cast("double")).alias("settled"))


_CNV = "try_cast(translate({}, '零一二三四五六七八九', '0123456789') AS DOUBLE)"
F15 = f"""WITH t AS (SELECT o_orderkey, o_orderkey % 900 + 100 AS n, o_orderkey % 3 AS form FROM orders),
x AS (SELECT *, CASE form WHEN 0 THEN concat(CAST(floor(n / 100) AS BIGINT), '.', lpad(CAST(n % 100 AS VARCHAR), 2, '0'))
  WHEN 1 THEN concat(translate(CAST(CAST(floor(n / 10) AS BIGINT) AS VARCHAR), '0123456789', '零一二三四五六七八九'), '零', substring('一二三四五六七八九', CAST(n % 9 AS INT) + 1, 1)) ELSE CAST(n AS VARCHAR) END AS number_text FROM t),
v AS (SELECT *, coalesce(try_cast(number_text AS DOUBLE), {_CNV.format('number_text')}) AS value,
  CASE WHEN regexp_matches(number_text, '^[零一二三四五六七八九]+零[一二三四五六七八九]$') THEN {_CNV.format('substring(number_text, 1, length(number_text) - 2)')} * 10 + {_CNV.format('right(number_text, 1)')} END AS other FROM x)
SELECT o_orderkey, number_text, CASE WHEN value <> floor(value) AND CAST(replace(number_text, '.', '') AS DOUBLE) = n THEN CAST(n AS DOUBLE)
  WHEN other IS NOT NULL AND abs(other - n) < abs(value - n) THEN other ELSE value END AS settled FROM v"""


def f16_clean_titles(spark, sf_dir):
    t = F.col("text")
    return title_lines(spark, sf_dir).select("doc_id", "row", titles.strip_body(t).alias("body"), titles.without_noise_lead(t).alias("bare"), titles.toc_label(t).alias("label"))


_NOISE_LEAD = "(?i)^[{0}]*(?:{1})[{0}:：、·\\-—]+([^{0}])".format(S, "|".join(sorted(titles.NOISE, key=len, reverse=True)))
F16 = f"""WITH {LINES},
j AS (SELECT doc_id, row, text AS own, regexp_replace(regexp_replace(regexp_replace(text, '[{S}]+', ' ', 'g'), '^ ', ''), ' $', '') AS text FROM tl),
i AS (SELECT *, CASE WHEN {_is(titles.WHOLE_BRACKET)} THEN {_x(titles.WHOLE_BRACKET, 1)} ELSE text END AS inner_, regexp_extract(text, '(第[{S}]*{titles.DECIMAL}[{S}]*[{titles.CHAPTER_UNITS}].*)$', 1) AS tail FROM j)
SELECT doc_id, row, {_cleaned('own')} AS body, regexp_replace(own, '{_NOISE_LEAD}', '\\1') AS bare,
  CASE WHEN text LIKE '%第%' AND {_is(_P)} THEN trim(concat('第', {_x(_P, 4)}, '章 ', trim({_x(_P, 5)}))) WHEN text LIKE '%第%' AND {_is(_M, 'inner_')}
    THEN trim(concat('第', {_x(_M, 6, 'inner_')}, {_x(_M, 7, 'inner_')}, ' ', {_x(_M, 8, 'inner_')})) WHEN tail <> '' THEN trim(tail) ELSE text END AS label FROM i"""


def f18_suggested_numbers(spark, sf_dir):
    """A number for a title behind each order of a customer."""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 50 + 1).alias("n"))
    order = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return rows.select("o_orderkey", titles.suggested_number(F.col("n"), F.lead("n").over(order)).alias("suggested"))


F18 = """SELECT o_orderkey, CASE WHEN f IS NULL THEN n + 1 WHEN n + 1 < f THEN n + 1 WHEN f > 1 THEN f - 1 ELSE n + 1 END AS suggested
FROM (SELECT o_orderkey, o_orderkey % 50 + 1 AS n, lead(o_orderkey % 50 + 1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS f FROM orders)"""


def f27_f31_widths(spark, sf_dir):
    t = F.col("text")
    return title_lines(spark, sf_dir).select("doc_id", "row", titles.display_width(t).alias("width"), titles.obfuscated_number(t).alias("in_disguise"))


_WIDE = "[^\\x{1100}-\\x{115F}\\x{2E80}-\\x{303E}\\x{3041}-\\x{33FF}\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{A000}-\\x{A4CF}\\x{AC00}-\\x{D7A3}\\x{F900}-\\x{FAFF}\\x{FE30}-\\x{FE6F}\\x{FF00}-\\x{FF60}\\x{FFE0}-\\x{FFE6}\\x{20000}-\\x{3FFFD}]"


def _width(text):
    return f"(length({text}) + length(regexp_replace({text}, '{_WIDE}', '', 'g')))"


_CIRCLED = "[^\\x{2460}-\\x{247C}\\x{2488}-\\x{2490}\\x{24EA}\\x{2776}-\\x{277E}\\x{2780}-\\x{2788}\\x{3280}-\\x{3289}]"
F27 = f"""WITH {LINES}, p AS (SELECT *, strpos(text, chr(9)) AS tab, trim(text, ' 　' || chr(9)) AS t FROM tl),
c AS (SELECT *, length(regexp_replace(t, '[^0-9０-９]', '', 'g')) AS a, length(regexp_replace(t, '{_CIRCLED}', '', 'g')) AS b, length(regexp_replace(t, '[^〇零一二三四五六七八九]', '', 'g')) AS d FROM p)
SELECT doc_id, row, CAST(CASE WHEN tab = 0 THEN {_width('text')} ELSE (floor({_width('substring(text, 1, tab - 1)')} / 4) + 1) * 4 + {_width('substring(text, tab + 1)')} END AS INT) AS width,
  (length(t) <= 30 AND a + b + d >= 7 AND CAST(a > 0 AS INT) + CAST(b > 0 AS INT) + CAST(d > 0 AS INT) >= 2 AND (b > 0 OR t LIKE '%〇%')) AS in_disguise FROM c"""


def t02_t03_preset_matches(spark, sf_dir):
    rows = title_lines(spark, sf_dir).select("doc_id", "row", rules.matched(F.col("text")).alias("x")).where("x IS NOT NULL")
    return rows.select("doc_id", "row", "x.*")


def _preset_rows():
    out = []
    for i, r in enumerate(rules.PRESETS):
        pattern, n, name, volume = r.patterns[0]
        number_text = _x(pattern, n, "t") if n else "''"
        never = f" AND NOT {_is(r.never, 't')}" if r.never else ""
        out.append(f"""SELECT doc_id, row, again, {i} AS i, '{r.name}' AS rule, {r.level} AS level, {number_text} AS number_text, trim({_x(pattern, name, 't')}, ' 　' || chr(9)) AS title,
  {_x(pattern, volume, 't') if volume else "''"} AS volume_text FROM c WHERE {_is(pattern, 't')}{never}""")
    return " UNION ALL ".join(out)


T02 = f"""WITH {LINES},
c AS (SELECT doc_id, row, 0 AS again, text AS t FROM tl WHERE {_LENGTH} <= 40 AND (NOT {_FORBIDDEN} OR regexp_matches(text, '[”’」』][{S}]*$'))
  UNION ALL SELECT doc_id, row, 1, regexp_replace(text, '{_NOISE_LEAD}', '\\1') FROM tl WHERE {_LENGTH} <= 40 AND NOT {_FORBIDDEN} AND {_is(_NOISE_LEAD)}),
m AS ({_preset_rows()}),
ok AS (SELECT *, {_value('number_text')} AS v FROM m WHERE CASE WHEN number_text <> '' THEN {_value('number_text')} > 0 AND {_value('number_text')} = floor({_value('number_text')}) ELSE title <> '' END)
SELECT doc_id, row, rule, level, CASE WHEN number_text <> '' THEN CAST(v AS BIGINT) ELSE 0 END AS number, number_text, title, volume_text
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, row ORDER BY again, i) AS r FROM ok) WHERE r = 1"""


def t01_titles(spark, sf_dir):
    """Titles by rule and grammar, with their parents; no SQL, tests have small books."""
    lines = title_lines(spark, sf_dir)
    return contents.with_parents(contents.titles(lines, rules.PRESETS), lines)


def t09_t10_merged_titles(spark, sf_dir):
    lines = title_lines(spark, sf_dir)
    return contents.with_subtitles(contents.without_repeats(contents.titles(lines), lines), lines)


def t12_settled_records(spark, sf_dir):
    lines = title_lines(spark, sf_dir)
    return contents.volume_summary(contents.with_parents(contents.titles(lines), lines))


def t14_suspects(spark, sf_dir):
    lines = title_lines(spark, sf_dir)
    return contents.suspects(lines, contents.titles(lines))


QUERIES = {
    "f03_chapters": (f03_chapters, F03), "f04_volumes": (f04_volumes, F04), "f05_specials": (f05_specials, F05), "f06_mixed_headers": (f06_mixed_headers, F06), "f07_weak_forms": (f07_weak_forms, F07),
    "f08_range_ends": (f08_range_ends, F08), "f09_f10_limits": (f09_f10_limits, F09), "f12_no_headings": (f12_no_headings, F12), "f14_renumbered": (f14_renumbered, F14), "f15_settled_numbers": (f15_settled_numbers, F15),
    "f16_clean_titles": (f16_clean_titles, F16), "f18_suggested_numbers": (f18_suggested_numbers, F18), "f27_f31_widths": (f27_f31_widths, F27), "t02_t03_preset_matches": (t02_t03_preset_matches, T02),
    "t01_titles": (t01_titles, None), "t09_t10_merged_titles": (t09_t10_merged_titles, None), "t12_settled_records": (t12_settled_records, None), "t14_suspects": (t14_suspects, None),
}
