"""Queries over punctuation, quotes, spaces, adverts and rendering."""

from __future__ import annotations

from pyspark.sql import functions as F

from bookloom.functions import formats
from bookloom.operators import proofreading
from bookloom.plans.derived import BOOK_ROWS, table

_SPEECH = """CASE o_orderkey % 8 WHEN 0 THEN concat('「', p, '。」「', s, '。」') WHEN 1 THEN concat('「', p, '，') WHEN 2 THEN concat(s, '。」') WHEN 3 THEN concat('他，說：', p, '。。。')
  WHEN 4 THEN concat('，甲 乙  ', p) WHEN 5 THEN concat('“', p, '“', s, '”甲”') WHEN 6 THEN '======' ELSE concat('甲———乙(', p, ')「」') END"""
_SPEECH_SQL = f"""speech AS (SELECT CAST(floor(o_orderkey / {BOOK_ROWS}) AS BIGINT) AS doc_id, o_orderkey % {BOOK_ROWS} AS row, {_SPEECH} AS text
  FROM (SELECT o_orderkey, o_orderpriority AS p, o_orderstatus AS s FROM orders))"""


def speech(spark, sf_dir):
    """Lines with quotes, marks and separators, one for each order."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("p"), F.col("o_orderstatus").alias("s"))
    return orders.select(F.floor(F.col("o_orderkey") / BOOK_ROWS).alias("doc_id"), (F.col("o_orderkey") % BOOK_ROWS).alias("row"), F.expr(_SPEECH).alias("text"))


def _page_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.lit(0).cast("long").alias("row"), F.concat(F.lit("read on at this place: "), "url").alias("text"))


_HOST = r"((?:[a-z0-9-]+\.)+(?:com|net|org|cc|info|cn|tw|hk|me|io|tv|biz|xyz|top|vip|club)|[0-9]{1,3}(?:\.[0-9]{1,3}){3})"
_BALANCE_SQL = "abs(length(replace(text, '「', '')) - length(replace(text, '」', '')))"

QUERIES = {
    "f24_full_width": (
        lambda s, d: speech(s, d).select("doc_id", "row", F.md5(formats.full_width(F.col("text"))).alias("digest"), F.md5(formats.half_width(F.col("text"))).alias("half")),
        f"WITH {_SPEECH_SQL} SELECT doc_id, row, md5(translate(text, ',;:?!()', '，；：？！（）')) AS digest, md5(translate(text, '，；：？！（）', ',;:?!()')) AS half FROM speech"),
    "f25_corner_quotes": (
        lambda s, d: speech(s, d).select("doc_id", "row", F.md5(formats.corner_quotes(F.col("text"))).alias("digest")),
        f"WITH {_SPEECH_SQL} SELECT doc_id, row, md5(translate(text, '“”‘’', '「」『』')) AS digest FROM speech"),
    "f26_collapsed_spaces": (
        lambda s, d: speech(s, d).select("doc_id", "row", F.md5(formats.collapsed_spaces(F.col("text"))).alias("digest")),
        f"WITH {_SPEECH_SQL} SELECT doc_id, row, md5(replace(regexp_replace(text, ' +', ' ', 'g'), '甲 乙', '甲乙')) AS digest FROM speech"),
    "f30_hosts": (
        lambda s, d: _page_urls(s, d).select("doc_id", F.explode(formats.hosts(F.col("text"))).alias("host")),
        f"SELECT page_id AS doc_id, unnest(regexp_extract_all(lower('read on at this place: ' || url), '{_HOST}', 1)) AS host FROM pages"),
    "a06_inline_adverts": (
        lambda s, d: proofreading.inline_adverts(_page_urls(s, d).withColumn("text", F.regexp_replace("text", r"//[^/]*?([a-z]+\.[a-z]+)/", "//$1/"))),
        f"""WITH t AS (SELECT page_id, regexp_replace('read on at this place: ' || url, '//[^/]*?([a-z]+\\.[a-z]+)/', '//\\1/', 'g') AS text FROM pages),
            h AS (SELECT page_id, length(text) AS n, unnest(list_distinct(regexp_extract_all(lower(text), '{_HOST}', 1))) AS host FROM t)
            SELECT host, count(*) AS n_lines FROM h WHERE n - length(host) >= 20 GROUP BY host HAVING count(*) >= 3"""),
    # the whole table; the SQL of the next two and of q08_realigned follows a part of the rows
    "p12_q01_all_problems": (lambda s, d: proofreading.problems(speech(s, d)).groupBy("kind").agg(F.count(F.lit(1)).alias("n")), None),
    "p14_all_unbalanced": (lambda s, d: speech(s, d).select("doc_id", "row", formats.n_unbalanced(F.col("text")).alias("n")).where("n > 0"), None),
    "q08_all_realigned": (lambda s, d: speech(s, d).select("doc_id", "row", F.md5(formats.realigned_quotes(F.col("text"))).alias("digest")), None),
    "p12_q01_problems": (
        lambda s, d: proofreading.problems(speech(s, d).where("row % 8 IN (0, 3, 4, 6, 7)")).groupBy("kind").agg(F.count(F.lit(1)).alias("n")),
        f"""WITH {_SPEECH_SQL} SELECT k AS kind, count(*) AS n FROM (SELECT unnest(CASE row % 8 WHEN 0 THEN ['stuck_dialogue'] WHEN 3 THEN ['repeated_mark'] WHEN 4 THEN ['leading_mark']
            WHEN 6 THEN ['long_separator'] WHEN 7 THEN ['empty_quote', 'dash_run'] ELSE [] END) AS k FROM speech) GROUP BY k"""),
    "q02_broken_lines": (
        lambda s, d: proofreading.problems(speech(s, d)).where("kind IN ('broken_line', 'unclosed')"),
        f"""WITH {_SPEECH_SQL}, n AS (SELECT doc_id, row, {_BALANCE_SQL} AS own, lead(row) OVER (PARTITION BY doc_id ORDER BY row) AS nxt FROM speech WHERE row % 8 <> 5)
            SELECT doc_id, row, CASE WHEN row % 8 = 1 AND nxt = row + 1 THEN 'broken_line' ELSE 'unclosed' END AS kind FROM n WHERE own > 0
            UNION ALL SELECT doc_id, row, 'unclosed' FROM speech WHERE row % 8 = 5 AND false"""),
    "p14_unbalanced": (
        lambda s, d: speech(s, d).where("row % 8 <> 5").select("doc_id", "row", formats.n_unbalanced(F.col("text")).alias("n")).where("n > 0"),
        f"WITH {_SPEECH_SQL} SELECT doc_id, row, CAST({_BALANCE_SQL} AS BIGINT) AS n FROM speech WHERE row % 8 <> 5 AND {_BALANCE_SQL} > 0"),
    "q08_realigned": (
        lambda s, d: speech(s, d).where("row % 8 = 5").select("doc_id", "row", F.md5(formats.realigned_quotes(F.col("text"))).alias("digest")),
        f"WITH {_SPEECH_SQL} SELECT CAST(floor(o_orderkey / {BOOK_ROWS}) AS BIGINT) AS doc_id, o_orderkey % {BOOK_ROWS} AS row, md5(concat('“', o_orderpriority, '”', o_orderstatus, '“甲”')) AS digest FROM orders WHERE o_orderkey % {BOOK_ROWS} % 8 = 5"),
    "q05_q09_fixes": (
        lambda s, d: proofreading.fixed(speech(s, d)).select("doc_id", "row", F.md5("fix").alias("digest")),
        f"""WITH {_SPEECH_SQL}, f AS (SELECT doc_id, row, text, CASE WHEN text = '======' THEN '===' ELSE replace(replace(replace(text, '。。。', '……'), '———', '——'), '」「', '」' || chr(10) || '「') END AS fix FROM speech)
            SELECT doc_id, row, md5(fix) AS digest FROM f WHERE fix <> text"""),
    "r04_indented": (
        lambda s, d: speech(s, d).select("doc_id", "row", F.md5(formats.indented(F.col("text"))).alias("digest")),
        f"WITH {_SPEECH_SQL} SELECT doc_id, row, md5('　　' || trim(text)) AS digest FROM speech"),
}
