"""Queries over adverts, work information and notes, on lines made from orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from bookloom.operators import ad_blocks, adverts, forum
from bookloom.plans.derived import BOOK_ROWS, table

_TEXT = """CASE o_orderkey % 25 WHEN 0 THEN '第1章 名' WHEN 3 THEN concat('請記住 www.', lower(s), 'book.com 本書來自網路') WHEN 4 THEN '加群 12345678' WHEN 9 THEN '作者：甲' WHEN 10 THEN '2024-01-02'
  WHEN 14 THEN '（求推薦票，求月票）' WHEN 19 THEN 'PS：明天請假，後天更新' WHEN 21 THEN concat('　　', repeat('他說起公眾號的事，', 6)) ELSE concat('　　', p, '。') END"""
_SQL = f"""notes AS (SELECT CAST(floor(o_orderkey / {BOOK_ROWS}) AS BIGINT) AS doc_id, o_orderkey % {BOOK_ROWS} AS row, o_orderkey % 25 AS m, {_TEXT} AS text
  FROM (SELECT o_orderkey, o_orderpriority AS p, o_orderstatus AS s FROM orders))"""


def lines(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("p"), F.col("o_orderstatus").alias("s"))
    return orders.select(F.floor(F.col("o_orderkey") / BOOK_ROWS).alias("doc_id"), (F.col("o_orderkey") % BOOK_ROWS).alias("row"), F.expr(_TEXT).alias("text"))


#: Lines with a site's name and address at their end, or framed in the middle, of two sites each.
_SITES = """SELECT CAST(floor(o_orderkey / 40) AS BIGINT) AS doc_id, o_orderkey % 40 AS row, o_custkey % 3 AS k, CAST(o_orderkey % 7 AS INT) AS n, lower(o_orderstatus) AS s, o_orderpriority AS p FROM orders"""
_SITE_TEXT = """CASE k WHEN 0 THEN concat(repeat('山', 20 + n), '。書屋www.', s, 'x.com') WHEN 1 THEN concat(repeat('水', 20), '☆城のwww.', s, 'y.net★', repeat('河', n + 5)) ELSE concat('　　', p) END"""


def _site_lines(spark, sf_dir):
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    return spark.sql(f"SELECT doc_id, row, {_SITE_TEXT} AS text FROM ({_SITES})")


def _grown(spark, sf_dir):
    """Candidates of the books of lines() grown to the rows of signs that stand around them."""
    rows = lines(spark, sf_dir).withColumn("text", F.when(F.col("row") % 5 == 2, "----").otherwise(F.col("text")))
    heads = rows.where(F.col("text").startswith("第")).select("doc_id", "row")
    return ad_blocks.between_separators(rows, adverts.candidates(rows).select("doc_id", "start", "end", "types"), heads)


#: Pages of a forum by k: a header with a line above and below, profiles, names between them, text.
_POSTS = ("concat(p, ' 2018-01-24 23:49 舉報')", "concat('書名 ', translate(p, '12345', '甲乙丙丁戊'))", "concat('大家好', p)", "'帖子'", "'3062 枚'", "'TOP 放入宝箱'", "'UID'", "'Rank: 6'", "p", "'金币 +100'",
          "'2018-01-24'", "''", "concat('求月票，求打賞', p)", "'LEVEL 7'", "'2071'", "concat('　　', p, repeat('他走了過去，', 4))")
_POST_TEXT = "CASE k " + " ".join(f"WHEN {i} THEN {form}" for i, form in enumerate(_POSTS)) + " END"
_POST = f"SELECT CAST(floor(o_orderkey / {BOOK_ROWS}) AS BIGINT) AS doc_id, o_orderkey % {BOOK_ROWS} AS row, o_custkey % {len(_POSTS)} AS k, o_orderpriority AS p FROM orders"
#: The books' rows may have gaps: rows are numbered anew.
_POST_ROWS = f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY row) - 1 AS row, k, p FROM ({_POST})"


def _posts(spark, sf_dir):
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    return spark.sql(f"SELECT doc_id, CAST(row AS BIGINT) AS row, {_POST_TEXT} AS text FROM ({_POST_ROWS})")


def _headers(spark, sf_dir):
    lines = _posts(spark, sf_dir)
    return forum.header_blocks(lines, lines.where("false"))


def _post_notes(spark, sf_dir):
    lines = _posts(spark, sf_dir)
    return forum.post_notes(lines, forum.header_blocks(lines, lines.where("false")), lines.where("false"))


def _profiles(spark, sf_dir):
    lines = _posts(spark, sf_dir)
    return forum.profile_blocks(lines, lines.where("false"))


_P = f"p AS ({_POST_ROWS}), q AS (SELECT *, lag(k) OVER w AS k0, lead(k) OVER w AS k1, lead(k, 2) OVER w AS k2 FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY row))"
#: What goes on below a header: a greeting; the writer's name, the priority, is in 2, 8, 12, 15 and 0 where it is the same.
A08_HEADERS = f"""WITH {_P},
n AS (SELECT *, lead(p) OVER w AS p1, lead(p, 2) OVER w AS p2 FROM q WINDOW w AS (PARTITION BY doc_id ORDER BY row)),
h AS (SELECT *, coalesce(k1 = 2 OR (k1 IN (0, 8, 12, 15) AND p1 = p), false) AS one, coalesce(k2 = 2 OR (k2 IN (0, 8, 12, 15) AND p2 = p), false) AS two FROM n WHERE k = 0)
SELECT doc_id, CAST(row AS BIGINT) AS row, CAST(CASE WHEN k0 IN (1, 3, 5, 6) THEN row - 1 ELSE row END AS BIGINT) AS start,
  CAST(CASE WHEN two AND (one OR k1 = 11) THEN row + 2 WHEN one THEN row + 1 ELSE row END AS BIGINT) AS "end" FROM h"""
A08_PROFILES = f"""WITH p AS ({_POST_ROWS}),
f AS (SELECT doc_id, row, CASE WHEN k IN (3, 5, 6, 7, 9, 13) THEN 2 WHEN k IN (4, 10, 14) THEN 1 ELSE 0 END AS s, length({_POST_TEXT}) > 16 AS wide FROM p WHERE k <> 11),
c AS (SELECT *, row_number() OVER w AS nth, sum(CASE WHEN s = 0 AND wide THEN 1 ELSE 0 END) OVER w AS stops FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY row)),
m AS (SELECT *, CASE WHEN stops = lag(stops) OVER w AND nth - lag(nth) OVER w <= 4 THEN 0 ELSE 1 END AS first FROM c WHERE s > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY row)),
r AS (SELECT *, sum(first) OVER (PARTITION BY doc_id ORDER BY row) AS run FROM m)
SELECT doc_id, CAST(min(row) AS BIGINT) AS start, CAST(max(row) AS BIGINT) AS "end", count(*) AS n, count(*) FILTER (s = 2) AS n_strong FROM r GROUP BY doc_id, run HAVING count(*) >= 6 AND n_strong >= 2"""

QUERIES = {
    "a08_forum_headers": (_headers, A08_HEADERS),
    "a08_post_notes": (_post_notes, None),
    "a08_forum_profiles": (_profiles, A08_PROFILES),
    "p09_forum_lines": (
        lambda s, d: _posts(s, d).select("doc_id", "row", forum.is_header(F.col("text")).alias("header"), forum.strength(F.col("text")).alias("strength")).where("header OR strength > 0"),
        f"""SELECT doc_id, CAST(row AS BIGINT) AS row, k = 0 AS header, CAST(CASE WHEN k IN (3, 5, 6, 7, 9, 13) THEN 2 WHEN k IN (4, 10, 14) THEN 1 ELSE 0 END AS INT) AS strength
        FROM ({_POST_ROWS}) WHERE k IN (0, 3, 4, 5, 6, 7, 9, 10, 13, 14)"""),
    "a05_blocks_between_separators": (_grown, None),
    "a06_inline_fragments": (
        lambda s, d: ad_blocks.inline_fragments(_site_lines(s, d)),
        f"""WITH b AS (SELECT *, count(*) OVER (PARTITION BY doc_id, k, s) AS c FROM ({_SITES}))
        SELECT doc_id, row, CASE k WHEN 0 THEN concat(repeat('山', 20 + n), '。') ELSE concat(repeat('水', 20), repeat('河', n + 5)) END AS fix, CASE WHEN c >= 5 THEN 'high' ELSE 'medium' END AS confidence
        FROM b WHERE k < 2 AND c >= 3"""),
    "p01_a03_features": (
        lambda s, d: lines(s, d).select("doc_id", "row", *[c.alias(n) for n, c in adverts.features(F.col("text")).items()]).where("publish OR source OR chat OR `group` OR url"),
        f"""WITH {_SQL}, k AS (SELECT doc_id, row, text LIKE '%請記住%' AS publish, text LIKE '%本書來自%' OR text LIKE '%求推薦%' AS source, text LIKE '%公眾號%' AS chat,
            text LIKE '%加群%' AND length(regexp_replace(text, '[^0-9]', '', 'g')) >= 4 AS "group", text LIKE '%www.%' AS url FROM notes)
        SELECT * FROM k WHERE publish OR source OR chat OR "group" OR url"""),
    "p03_work_info": (
        lambda s, d: lines(s, d).select("doc_id", "row", adverts.work_info(F.col("text")).alias("confidence")).where("confidence IS NOT NULL"),
        f"WITH {_SQL} SELECT doc_id, row, CASE m WHEN 9 THEN 'high' ELSE 'medium' END AS confidence FROM notes WHERE m IN (9, 10)"),
    "p05_narrative": (
        lambda s, d: lines(s, d).where(adverts.narrative(F.col("text"))).select("doc_id", "row"),
        f"WITH {_SQL} SELECT doc_id, row FROM notes WHERE m = 21"),
    "p07_p08_notes": (
        lambda s, d: lines(s, d).select("doc_id", "row", adverts.note_trigger(F.col("text")).alias("trigger"), adverts.n_note_words(F.col("text")).alias("n")).where("trigger IS NOT NULL OR n > 0"),
        f"WITH {_SQL} SELECT doc_id, row, CASE m WHEN 14 THEN 'paren' WHEN 19 THEN 'ps' END AS trigger, CAST(CASE WHEN m IN (3, 9) THEN 1 ELSE 2 END AS BIGINT) AS n FROM notes WHERE m IN (3, 9, 14, 19)"),
    "a04_candidates": (
        lambda s, d: adverts.candidates(lines(s, d)).select("doc_id", "start", "end", F.array_join("types", ",").alias("types"), "score", "confidence"),
        f"""WITH {_SQL}, b AS (SELECT doc_id, row, m FROM notes WHERE m IN (3, 9, 14, 21))
            SELECT doc_id, row AS start, CASE WHEN m IN (14, 21) THEN row ELSE row + 1 END AS "end", CASE m WHEN 3 THEN 'group,publish,source,url' WHEN 9 THEN 'work_info' WHEN 14 THEN 'source' ELSE 'chat' END AS types,
            CAST(CASE m WHEN 3 THEN 11 WHEN 9 THEN 3 WHEN 14 THEN 5 ELSE 2 END AS BIGINT) AS score, CASE WHEN m IN (3, 14) THEN 'high' WHEN m = 9 THEN 'medium' ELSE 'low' END AS confidence FROM b"""),
    "a07_note_blocks": (
        lambda s, d: adverts.note_blocks(lines(s, d), lines(s, d).where("row % 25 = 0").select("doc_id", "row")),
        f"""WITH {_SQL} SELECT doc_id, row AS start, least(row + 10, max(row) OVER (PARTITION BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS "end", 'paren' AS trigger
            FROM notes QUALIFY m = 14"""),
}
