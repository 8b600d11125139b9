"""Queries over lines, strings, markup, spans and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from bookloom.functions import chars, markup, numerals
from bookloom.operators import boilerplate, spans
from bookloom.plans.derived import BOOKS_SQL, LINES_SQL, books, document_lines, table
from bookloom.sources import lines as source

_FORMS_SQL = LINES_SQL + """,
forms AS (SELECT *, lower(regexp_replace(text, '[ \\t\\n\\r\\f]+', '', 'g')) AS form FROM lines)"""
_REPEATED_SQL = _FORMS_SQL + """,
wanted AS (SELECT * FROM forms WHERE length(form) BETWEEN 12 AND 180 AND NOT (form[1] IN ('"', '“', '「', '『') AND form[-1] IN ('"', '”', '」', '』')) AND NOT regexp_matches(form, '^[^:：“「『"]{1,8}[:：][“「『"]') AND NOT regexp_matches(form, '^[【\\[][^】\\]]{1,40}[】\\]]$')
  AND len(list_distinct(regexp_extract_all(form, '[\\p{L}\\p{N}]'))) > 0 AND NOT (len(list_distinct(regexp_extract_all(form, '[\\p{L}\\p{N}]'))) <= 3 AND list_max(list_transform(regexp_extract_all(form, '[\\p{L}\\p{N}]'), lambda c: len(list_filter(regexp_extract_all(form, '[\\p{L}\\p{N}]'), lambda d: d = c)))) >= 3)),
found AS (SELECT doc_id, form, count(*) AS n, min(row) AS first_row FROM wanted GROUP BY ALL HAVING count(*) >= 3)"""
_KEPT_SQL = _REPEATED_SQL + """,
marked AS (SELECT f.doc_id, f.form, f.row, d.form IS NOT NULL AS hit FROM forms f LEFT JOIN found d USING (doc_id, form) WHERE f.form <> ''),
runs AS (SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY row) AS run FROM marked),
sized AS (SELECT *, count(*) OVER (PARTITION BY doc_id, run) AS size FROM runs WHERE hit),
inside AS (SELECT doc_id, form, count(*) FILTER (size >= 6) AS n_inside FROM sized GROUP BY ALL),
kept AS (SELECT found.* FROM found JOIN inside USING (doc_id, form) WHERE 2 * n_inside < n)"""


def flagship(spark, sf_dir):
    """Per document: how many lines repeat as boilerplate, and what is left of the text
    without them."""
    lines = document_lines(spark, sf_dir)
    found = boilerplate.without_passages(lines, boilerplate.repeated_lines(lines))
    left = spans.without_rows(lines, boilerplate.rows_of_forms(lines, found))
    return left.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_left"), F.sum(F.length("text")).alias("n_chars_left"), F.sum(F.col("src_row") - F.col("row")).alias("shifted"))


FLAGSHIP_SQL = f"""WITH {_KEPT_SQL},
gone AS (SELECT DISTINCT doc_id, row FROM forms SEMI JOIN kept USING (doc_id, form)),
rest AS (SELECT doc_id, row, text, row_number() OVER (PARTITION BY doc_id ORDER BY row) - 1 AS new FROM lines ANTI JOIN gone USING (doc_id, row))
SELECT doc_id, count(*) AS n_left, CAST(sum(length(text)) AS BIGINT) AS n_chars_left, CAST(sum(row - new) AS BIGINT) AS shifted FROM rest GROUP BY doc_id"""

_ENTITY_SQL = "text"
for _name, _char in markup.ENTITIES:
    _ENTITY_SQL = "replace({}, '{}', '{}')".format(_ENTITY_SQL, _name, _char.replace("'", "''"))


def _page_lines(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.posexplode(F.split("html", "(?=<p>)")).alias("row", "text"))


_PAGE_SQL = """pl AS (SELECT page_id AS doc_id, unnest(range(len(s))) AS row, unnest(s) AS text FROM (
  SELECT page_id, list_filter(list_transform(string_split(html, '<p>'), lambda x, i: CASE WHEN i = 1 THEN x ELSE '<p>' || x END), lambda x, i: i > 1 OR x <> '') AS s FROM pages))"""
_UNTAGGED_SQL = r"""array_to_string(list_filter(string_split(regexp_replace(regexp_replace({0}, '(?i)</?(b|i|u|em|strong|font|span|a|sup|sub|center)( [^<>]*)?/?>', '', 'g'),
  '(?i)</?(p|div|br)( [^<>]*)?/?>', chr(10), 'g'), chr(10)), lambda x: regexp_replace(x, '[ \t]+', '', 'g') <> ''), chr(10))"""


def _spans(spark, sf_dir):
    """A span of rows for every line item of a part."""
    rows = table(spark, sf_dir, "lineitem")
    start = F.col("l_orderkey") % 1000
    return rows.select(F.col("l_suppkey").alias("doc_id"), start.alias("start"), (start + F.col("l_linenumber") * 2).alias("end")).distinct()


_SPANS_SQL = "spans AS (SELECT DISTINCT l_suppkey AS doc_id, l_orderkey % 1000 AS start, l_orderkey % 1000 + l_linenumber * 2 AS \"end\" FROM lineitem)"


def _ranges(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier")
    return rows.select(F.col("s_suppkey").alias("doc_id"), F.explode(F.array(*[F.lit(x).cast("long") for x in (0, 300, 620)])).alias("start")).withColumn("end", F.col("start") + 99 + F.col("doc_id") % 7)


_RANGES_SQL = "ranges AS (SELECT s_suppkey AS doc_id, x AS start, x + 99 + s_suppkey % 7 AS \"end\" FROM (SELECT s_suppkey, unnest([0, 300, 620]) AS x FROM supplier))"

QUERIES = {
    "s07_line_breaks": (
        lambda s, d: table(s, d, "documents").select("doc_id", F.replace("text", F.lit("e\n"), F.lit("e\r\n")).alias("t")).select(
            "doc_id", F.md5(source.with_plain_breaks(F.col("t"))).alias("digest"), source.n_changed_breaks(F.replace("t", F.lit("s\n"), F.lit("s\r"))).alias("n_changed")),
        """SELECT doc_id, md5(replace(replace(text, chr(13), chr(10)), chr(160), ' ')) AS digest,
                  CAST((length(text) - length(replace(text, 's' || chr(10), 's'))) AS BIGINT) AS n_changed FROM documents"""),
    "s08_lines": (
        lambda s, d: document_lines(s, d).select("doc_id", "row", F.md5("text").alias("digest")),
        f"WITH {LINES_SQL} SELECT doc_id, row, md5(text) AS digest FROM lines"),
    "s06_invisible": (
        lambda s, d: table(s, d, "documents").select("doc_id", F.replace("text", F.lit("th"), F.lit("t​h﻿")).alias("t")).select(
            "doc_id", source.n_invisible(F.col("t")).alias("n"), F.md5(source.without_invisible(F.col("t"))).alias("digest")),
        "SELECT doc_id, CAST(length(text) - length(replace(text, 'th', '')) AS BIGINT) AS n, md5(text) AS digest FROM documents"),
    "s04_misdecoded": (
        lambda s, d: table(s, d, "documents").select("doc_id", source.looks_misdecoded(F.translate("text", "éä", "��")).alias("damaged")),
        "SELECT doc_id, (length(x) - length(regexp_replace(x, '[éä]', '', 'g'))) * 100 > length(x) AS damaged FROM (SELECT doc_id, left(text, 200000) AS x FROM documents)"),
    "s12_file_kinds": (
        lambda s, d: table(s, d, "pages").groupBy(source.file_kind(F.concat("url", F.element_at(F.array(F.lit(".TXT"), F.lit(".docx"), F.lit(".epub"), F.lit("")), (F.col("page_id") % 4 + 1).cast("int")))).alias("kind")).agg(F.count(F.lit(1)).alias("n")),
        "SELECT CASE page_id % 4 WHEN 0 THEN 'txt' WHEN 1 THEN 'docx' WHEN 2 THEN 'epub' ELSE 'other' END AS kind, count(*) AS n FROM pages GROUP BY 1"),
    "s15_file_names": (
        lambda s, d: table(s, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("《"), "p_name", F.lit("》作者："), "p_brand", F.lit("（完）.txt"))).when(
            F.col("p_partkey") % 3 == 1, F.concat(F.lit("【"), "p_name", F.lit("】連載.txt"))).otherwise(F.concat("p_name", F.lit(".txt"))).alias("f")).select("p_partkey", *[c.alias(n) for n, c in source.book_meta(F.col("f")).items()]),
        """SELECT p_partkey, p_name AS title, CASE WHEN p_partkey % 3 = 0 THEN regexp_extract(p_brand, '^[^（(《【\\[\\] ]+') ELSE '' END AS author,
                  CASE p_partkey % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'ongoing' ELSE 'unspecified' END AS status FROM part"""),
    "f01_f02_numerals": (
        lambda s, d: table(s, d, "orders").select("o_orderkey", numerals.chinese(F.col("o_orderkey")).alias("numeral")).select(
            "o_orderkey", numerals.number(F.col("numeral")).cast("long").alias("value"), F.length(F.regexp_replace("numeral", "[零十百千萬]", "")).cast("long").alias("n_digits")),
        """SELECT o_orderkey, o_orderkey AS value, CAST(length(replace(CAST(o_orderkey AS VARCHAR), '0', '')) - CASE WHEN o_orderkey % 100000 BETWEEN 10 AND 19 AND o_orderkey < 100 THEN 1
                  WHEN floor(o_orderkey / 10000) BETWEEN 10 AND 19 THEN 1 ELSE 0 END AS BIGINT) AS n_digits FROM orders"""),
    "f21_char_counts": (
        lambda s, d: document_lines(s, d).groupBy("doc_id").agg(F.sum(chars.char_count(F.col("text"))).alias("n_chars")),
        f"WITH {LINES_SQL} SELECT doc_id, CAST(sum(length(replace(replace(text, ' ', ''), chr(9), ''))) AS BIGINT) AS n_chars FROM lines GROUP BY doc_id"),
    "f22_han_counts": (
        lambda s, d: books(s, d).groupBy("doc_id").agg(F.sum(chars.han_count(F.col("text"))).alias("n_han")),
        f"WITH {BOOKS_SQL} SELECT doc_id, CAST(sum(length(regexp_replace(text, '[^一-龥]', '', 'g'))) AS BIGINT) AS n_han FROM books GROUP BY doc_id"),
    "f23_compact_forms": (
        lambda s, d: document_lines(s, d).groupBy(chars.compact(F.col("text")).alias("form")).agg(F.count(F.lit(1)).alias("n")).where("n > 2").select(F.md5("form").alias("digest"), "n"),
        f"WITH {_FORMS_SQL} SELECT md5(form) AS digest, count(*) AS n FROM forms GROUP BY form HAVING count(*) > 2"),
    "f28_entities": (
        lambda s, d: table(s, d, "pages").select("page_id", F.md5(markup.decoded(F.col("html"))).alias("digest")),
        f"SELECT page_id, md5({_ENTITY_SQL.replace('text', 'html')}) AS digest FROM pages"),
    "f29_tags": (
        lambda s, d: _page_lines(s, d).select("doc_id", F.col("row").cast("long").alias("row"), F.md5(markup.untagged(F.col("text"))).alias("digest")),
        f"WITH {_PAGE_SQL} SELECT doc_id, row, md5({_UNTAGGED_SQL.format('text')}) AS digest FROM pl"),
    "a09_markup_fixes": (
        lambda s, d: boilerplate.markup_fixes(_page_lines(s, d)).select("doc_id", F.col("row").cast("long").alias("row"), F.md5("fix").alias("digest")),
        f"WITH {_PAGE_SQL}, fixed AS (SELECT doc_id, row, text, {_UNTAGGED_SQL.format(_ENTITY_SQL)} AS fix FROM pl) SELECT doc_id, row, md5(fix) AS digest FROM fixed WHERE fix <> text"),
    "s11_html_lines": (
        lambda s, d: table(s, d, "pages").select("page_id", F.posexplode(markup.html_lines(F.col("html"))).alias("row", "line")).select("page_id", F.col("row").cast("long").alias("row"), F.md5("line").alias("digest")),
        rf"""SELECT page_id, unnest(range(len(l))) AS row, unnest(list_transform(l, lambda x: md5(x))) AS digest FROM (SELECT page_id, list_filter(list_transform(string_split({_ENTITY_SQL.replace('text', 'plain')}, chr(10)),
              lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'))), lambda x: x <> '') AS l FROM (
              SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style|head|title)[ >].*?</(script|style|head|title)>|<!--.*?-->', ' ', 'g'),
                '(?i)</?(p|div|br|h[1-6]|li|ul|ol|article|nav|footer|section|tr|table|blockquote)( [^<>]*)?/?>', chr(10), 'g'), '<[^<>]*>', '', 'g') AS plain FROM pages))"""),
    "p04_q04_separators": (
        lambda s, d: boilerplate.separator_styles(books(s, d)),
        f"""WITH {BOOKS_SQL} SELECT left(trim(text), 1) AS symbol, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM books
            WHERE length(trim(text)) >= 3 AND regexp_matches(trim(text), '^[-=*_~#+.]+$') AND replace(trim(text), left(trim(text), 1), '') = '' GROUP BY 1"""),
    "a01_repeated_lines": (
        lambda s, d: boilerplate.repeated_lines(document_lines(s, d)).withColumn("form", F.md5("form")),
        f"WITH {_REPEATED_SQL} SELECT doc_id, md5(form) AS form, n, first_row FROM found"),
    "a01_repeated_lines_corpus": (
        lambda s, d: boilerplate.repeated_lines(document_lines(s, d), "corpus").withColumn("form", F.md5("form")),
        f"WITH {_REPEATED_SQL} SELECT md5(form) AS form, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM wanted GROUP BY wanted.form HAVING count(*) >= 3"),
    "a02_without_passages": (
        lambda s, d: boilerplate.without_passages(lines := document_lines(s, d), boilerplate.repeated_lines(lines)).withColumn("form", F.md5("form")),
        f"WITH {_KEPT_SQL} SELECT doc_id, md5(form) AS form, n, first_row FROM kept"),
    "a14_boilerplate_removed": (flagship, FLAGSHIP_SQL),
    "e02_merged_spans": (
        lambda s, d: spans.merged(_spans(s, d), touching=False),
        f"""WITH {_SPANS_SQL}, m AS (SELECT *, CASE WHEN start > coalesce(max("end") OVER (PARTITION BY doc_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -2) THEN 1 ELSE 0 END AS new FROM spans),
            i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM m)
            SELECT doc_id, min(start) AS start, max("end") AS "end" FROM i GROUP BY doc_id, island"""),
    "a13_clipped_spans": (
        lambda s, d: spans.clipped(_spans(s, d), _ranges(s, d)),
        f"""WITH {_SPANS_SQL}, {_RANGES_SQL} SELECT s.doc_id, greatest(s.start, r.start) AS start, least(s."end", r."end") AS "end" FROM spans s JOIN ranges r
            ON s.doc_id = r.doc_id AND s.start <= r."end" AND s."end" >= r.start"""),
    "a14_rows_deleted": (
        lambda s, d: spans.without_rows(books(s, d), books(s, d).where("row % 40 = 17").select("doc_id", (F.col("row") - 1).alias("start"), F.col("row").alias("end"))).select("doc_id", "row", "src_row"),
        f"WITH {BOOKS_SQL} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY row) - 1 AS row, row AS src_row FROM books WHERE row % 40 NOT IN (16, 17)"),
    "a14_rows_replaced": (
        lambda s, d: spans.replaced(books(s, d), books(s, d).where("row % 40 = 18").select("doc_id", "row", F.col("text").alias("before"), F.replace("text", F.lit("  "), F.lit("\n")).alias("fix"))).select("doc_id", "row", "src_row", F.md5("text").alias("digest")),
        f"""WITH {BOOKS_SQL}, p AS (SELECT doc_id, row AS src_row, unnest(s) AS text, unnest(range(len(s))) AS part FROM (SELECT doc_id, row, CASE WHEN row % 40 = 18 THEN string_split(text, '  ') ELSE [text] END AS s FROM books))
            SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY src_row, part) - 1 AS row, src_row, md5(text) AS digest FROM p"""),
    "n08_e03_moved_blocks": (
        lambda s, d: spans.moved(books(s, d), books(s, d).where("row = 100").select("doc_id", F.lit(100).cast("long").alias("start"), F.lit(109).cast("long").alias("end"), F.lit(20).cast("long").alias("before"))).select("doc_id", "row", "src_row"),
        f"""WITH {BOOKS_SQL}, b AS (SELECT *, bool_or(row = 100) OVER (PARTITION BY doc_id) AS has FROM books)
            SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN has AND row BETWEEN 100 AND 109 THEN 20 ELSE row END, CASE WHEN has AND row BETWEEN 100 AND 109 THEN 0 ELSE 1 END, row) - 1 AS row, row AS src_row FROM b"""),
    "x01_found_words": (
        lambda s, d: document_lines(s, d).select("doc_id", "row", F.regexp_count("text", F.lit("th[aei]")).cast("long").alias("n")).where("n > 0"),
        f"WITH {LINES_SQL} SELECT * FROM (SELECT doc_id, row, CAST(len(regexp_extract_all(text, 'th[aei]')) AS BIGINT) AS n FROM lines) WHERE n > 0"),
    "x02_replaced_words": (
        lambda s, d: document_lines(s, d).select("doc_id", "row", F.md5(F.regexp_replace("text", "([a-z]+)tion", "$1-tion")).alias("digest")),
        f"WITH {LINES_SQL} SELECT doc_id, row, md5(regexp_replace(text, '([a-z]+)tion', '\\1-tion', 'g')) AS digest FROM lines"),
    "x03_top_candidates": (
        lambda s, d: boilerplate.top_by_confidence(document_lines(s, d).where("length(text) >= 200").select("doc_id", "row", F.when(F.length("text") >= 500, "high").when(F.length("text") >= 300, "medium").otherwise("low").alias("confidence"))),
        f"""WITH {LINES_SQL} SELECT doc_id, row, CASE r WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence FROM (
            SELECT doc_id, row, CASE WHEN length(text) >= 500 THEN 0 WHEN length(text) >= 300 THEN 1 ELSE 2 END AS r FROM lines WHERE length(text) >= 200 ORDER BY r, doc_id, row LIMIT 2000)"""),
    "r03_long_paragraphs": (
        lambda s, d: document_lines(s, d).select("doc_id", F.when(F.length("text") >= 500, "high").when(F.length("text") >= 300, "medium").alias("confidence")).where("confidence IS NOT NULL").groupBy("doc_id", "confidence").agg(F.count(F.lit(1)).alias("n")),
        f"WITH {LINES_SQL} SELECT doc_id, CASE WHEN length(text) >= 500 THEN 'high' ELSE 'medium' END AS confidence, count(*) AS n FROM lines WHERE length(text) >= 300 GROUP BY 1, 2"),
}
