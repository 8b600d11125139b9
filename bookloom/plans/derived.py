"""Book-like tables derived from the given ones, for Spark and, as SQL, for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookloom.sources.lines import lines_of

BOOK_ROWS = 200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_lines(spark, sf_dir) -> DataFrame:
    return lines_of(table(spark, sf_dir, "documents").select("doc_id", "text"))


LINES_SQL = """lines AS (
  SELECT doc_id, unnest(range(len(s))) AS row, unnest(s) AS text
  FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))"""

#: Text of a book's row k: volumes every 50 rows, chapters every 10, an end mark, side
#: stories, excluded headings, separators and body lines.
_TEXT = """CASE
    WHEN k % 50 = 0 THEN concat('第', substring('一二三四', CAST(floor(k / 50) AS INT) + 1, 1), '卷 ', p)
    WHEN k % 100 = 48 THEN concat('第', substring('一二三四', CAST(floor(k / 50) AS INT) + 1, 1), '卷終')
    WHEN k % 20 = 1 THEN concat('第', CAST(floor(k / 10) AS INT) + 1, '章 ', p)
    WHEN k % 20 = 11 THEN concat('第', CAST(floor(k / 10) AS INT) + 1, '章 ', p, CASE WHEN o_orderkey % 7 = 0 THEN ' [::X]' ELSE '' END)
    WHEN k % 40 = 15 THEN concat('番外 ', p)
    WHEN k % 40 = 16 THEN '第二部分是' WHEN k % 40 = 17 THEN '----------' WHEN k % 40 = 18 THEN concat(o_orderstatus, '  ', p)
    ELSE concat('　　', p, '。', o_orderstatus) END"""


def books(spark, sf_dir) -> DataFrame:
    """(doc_id, row, text): a book of BOOK_ROWS lines for every BOOK_ROWS orders."""
    orders = table(spark, sf_dir, "orders").withColumns({
        "doc_id": F.floor(F.col("o_orderkey") / BOOK_ROWS), "row": F.col("o_orderkey") % BOOK_ROWS, "k": F.col("o_orderkey") % BOOK_ROWS, "p": F.col("o_orderpriority")})
    return orders.select("doc_id", "row", F.expr(_TEXT).alias("text"))


BOOKS_SQL = f"""books AS (
  SELECT doc_id, k AS row, {_TEXT} AS text
  FROM (SELECT *, CAST(floor(o_orderkey / {BOOK_ROWS}) AS BIGINT) AS doc_id, o_orderkey % {BOOK_ROWS} AS k, o_orderpriority AS p FROM orders))"""

_NUM = "[0-9０-９零〇一二三四五六七八九兩两十百千萬万]+"
#: Headings of books by SQL: kind, number and name of every row.
PARSED_SQL = BOOKS_SQL + f""",
parsed AS (
  SELECT doc_id, row, text, t, regexp_extract(t, '^第({_NUM})([章回節折幕卷部篇集季])(?:[ :：、　]+(.*))?$', 1) AS number_text,
         regexp_extract(t, '^第({_NUM})([章回節折幕卷部篇集季])(?:[ :：、　]+(.*))?$', 2) AS unit,
         regexp_extract(t, '^第({_NUM})([章回節折幕卷部篇集季])(?:[ :：、　]+(.*))?$', 3) AS name,
         NOT (length(t) > 40 OR regexp_matches(t, '[。，、；,;]$') OR regexp_matches(t, '^第[^ 　]{{1,8}}?(部分|季度|回合|節課|集團|部門)') OR text LIKE '%[::X]') AS fits
  FROM (SELECT *, regexp_replace(regexp_replace(regexp_replace(text, '[ 　]*\\[::[xXwWtT]?\\][ 　]*$', ''), '^[ 　]+', ''), '[ 　]+$', '') AS t FROM books)),
headed AS (
  SELECT *, CASE WHEN NOT fits THEN 'body' WHEN unit IN ('卷', '部', '篇', '集', '季') THEN 'volume' WHEN unit <> '' THEN 'chapter'
                 WHEN regexp_matches(t, '^(序章|楔子|引子|前言|序|後記|尾聲|終章|番外|外傳|簡介|附錄)([ :：　]+.*)?$') THEN 'special' ELSE 'body' END AS kind,
         CASE WHEN unit <> '' THEN coalesce(try_cast(number_text AS DOUBLE), CAST(strpos('一二三四五六七八九', number_text) AS DOUBLE)) END AS number,
         regexp_matches(t, '^[（(【]?(第{_NUM}|本)[卷部篇集季][ 　]*(終|完|結束)[)）】]?$') AS ends
  FROM parsed)"""


def orders_numbers(spark, sf_dir) -> DataFrame:
    """Number sequences with gaps: the order keys of every customer."""
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("grp"), F.col("o_orderkey").alias("number"))


def restarting_numbers(spark, sf_dir) -> DataFrame:
    """Line numbers of each part in a fixed order: they restart often."""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    order = Window.partitionBy("l_partkey").orderBy(*rows.columns[1:])
    return rows.select(F.col("l_partkey").alias("grp"), F.row_number().over(order).cast("long").alias("idx"), F.col("l_linenumber").cast("long").alias("number"))


RESTARTS_SQL = """numbers AS (
  SELECT l_partkey AS grp, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS idx,
         CAST(l_linenumber AS BIGINT) AS number FROM lineitem)"""
