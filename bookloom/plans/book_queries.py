"""Queries over numbers, headings, contents, duplicates and updates."""

from __future__ import annotations

from pyspark.sql import functions as F

from bookloom.functions import headings
from bookloom.operators import duplicates, numbering, structure, update
from bookloom.plans.derived import BOOKS_SQL, LINES_SQL, PARSED_SQL, RESTARTS_SQL, books, document_lines, orders_numbers, restarting_numbers, table

_TOC_SQL = PARSED_SQL + """,
vol AS (SELECT *, last_value(CASE WHEN kind = 'volume' THEN row WHEN ends THEN -1 END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY row) AS v FROM headed),
toc AS (SELECT doc_id, row, kind, unit, number, name, CASE WHEN kind <> 'volume' AND v >= 0 THEN v END AS parent_row,
               row_number() OVER (PARTITION BY doc_id ORDER BY row) - 1 AS ord FROM vol WHERE kind <> 'body' AND NOT ends)"""
_SECTIONS_SQL = _TOC_SQL + """,
sec AS (SELECT b.doc_id, b.row, b.text, t.row IS NOT NULL AS is_title, CAST(greatest(count(t.row) OVER (PARTITION BY b.doc_id ORDER BY b.row) - 1, 0) AS BIGINT) AS section
        FROM books b LEFT JOIN toc t ON b.doc_id = t.doc_id AND b.row = t.row)"""
_SEGMENTS_SQL = RESTARTS_SQL + """,
near AS (SELECT *, lag(number) OVER (PARTITION BY grp ORDER BY idx) AS back, lead(number) OVER (PARTITION BY grp ORDER BY idx) AS ahead FROM numbers),
seg AS (SELECT grp, idx, number, CAST(sum(CASE WHEN number <= 2 AND back >= number + 3 AND (ahead IS NULL OR ahead = number + 1) THEN 1 ELSE 0 END) OVER (PARTITION BY grp ORDER BY idx) AS BIGINT) AS segment FROM near)"""
_SENTENCES_SQL = r"""sent AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(regexp_split_to_array(regexp_replace(text, '[ \t\r\f]+', '', 'g'), '[.!?。！？…\n]+')) AS s FROM documents) WHERE length(s) >= 10)"""
_PAIRS_SQL = _SENTENCES_SQL + """,
size AS (SELECT doc_id, count(*) AS n FROM sent GROUP BY 1),
rare AS (SELECT s FROM sent GROUP BY s HAVING count(*) BETWEEN 2 AND 20),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_shared FROM sent a JOIN sent b ON a.s = b.s AND a.doc_id < b.doc_id WHERE a.s IN (SELECT s FROM rare) GROUP BY ALL),
hits AS (SELECT a, b, n_shared, least(x.n, y.n) AS n_smaller FROM pairs JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE n_shared >= 0.6 * least(x.n, y.n))"""


def _old_and_new(spark, sf_dir):
    """An edited book without every tenth chapter, some cut short, and the full one."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("idx"), F.floor("o_totalprice").cast("long").alias("n_chars"))
    keyed = orders.withColumn("number", F.col("idx"))
    old = keyed.where("idx % 10 <> 0").withColumn("n_chars", F.when(F.col("idx") % 7 == 0, F.floor(F.col("n_chars") / 2)).otherwise(F.col("n_chars")))
    return old, keyed


_UPDATE_SQL = """o AS (SELECT o_custkey AS doc_id, o_orderkey AS idx, CAST(floor(o_totalprice) AS BIGINT) AS n FROM orders),
old AS (SELECT doc_id, idx, CASE WHEN idx % 7 = 0 THEN CAST(floor(n / 2) AS BIGINT) ELSE n END AS n FROM o WHERE idx % 10 <> 0),
j AS (SELECT o.doc_id, o.idx AS new_idx, o.n AS new_chars, old.idx AS body_idx, old.n AS body_chars FROM o LEFT JOIN old ON o.doc_id = old.doc_id AND o.idx = old.idx),
w AS (SELECT *, last_value(body_idx IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY new_idx) AS position,
             first_value(body_idx IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY new_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM j),
plan AS (SELECT doc_id, new_idx, position, CASE WHEN body_idx IS NOT NULL THEN CASE WHEN new_chars >= body_chars * 1.2 AND new_chars >= body_chars + 300 THEN 'longer' ELSE 'same' END
                WHEN later IS NULL THEN 'new' ELSE 'missing' END AS status FROM w)"""


def _titles(spark, sf_dir):
    return structure.toc(books(spark, sf_dir))


def _document_sections(spark, sf_dir):
    """Lines of a document as sections with their lengths."""
    return document_lines(spark, sf_dir).select("doc_id", "row", F.length(F.regexp_replace("text", " ", "")).cast("long").alias("n_chars"))


def _members(spark, sf_dir):
    """Documents of a source in order, as chapters that may repeat."""
    return table(spark, sf_dir, "documents").select(F.col("source").alias("grp"), F.col("doc_id").alias("idx"), "text")


QUERIES = {
    "n03_missing_middle": (
        lambda s, d: numbering.missing_ranges(orders_numbers(s, d), ["grp"]),
        "SELECT grp, back + 1 AS first_missing, number - 1 AS last_missing FROM (SELECT o_custkey AS grp, o_orderkey AS number, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS back FROM orders) WHERE number - back > 1"),
    "n03_missing_from_one": (
        lambda s, d: numbering.missing_ranges(orders_numbers(s, d), ["grp"], "from_one"),
        "SELECT grp, back + 1 AS first_missing, number - 1 AS last_missing FROM (SELECT o_custkey AS grp, o_orderkey AS number, coalesce(lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 0) AS back FROM orders) WHERE number - back > 1"),
    "n03_missing_continued": (
        lambda s, d: numbering.missing_ranges(table(s, d, "orders").select((F.col("o_custkey") % 50).alias("work"), F.col("o_custkey").alias("volume"), F.col("o_orderkey").alias("number")), ["work", "volume"], "continue"),
        """WITH n AS (SELECT o_custkey % 50 AS work, o_custkey AS volume, o_orderkey AS number FROM orders),
           e AS (SELECT work, volume, lag(max(number)) OVER (PARTITION BY work ORDER BY volume) AS previous FROM n GROUP BY work, volume),
           b AS (SELECT n.*, coalesce(lag(number) OVER (PARTITION BY n.work, n.volume ORDER BY number), CASE WHEN previous < number THEN previous END) AS back FROM n JOIN e ON n.work = e.work AND n.volume = e.volume)
           SELECT work, volume, back + 1 AS first_missing, number - 1 AS last_missing FROM b WHERE number - back > 1"""),
    "n05_segments": (
        lambda s, d: numbering.segments(restarting_numbers(s, d), ["grp"]),
        f"WITH {_SEGMENTS_SQL} SELECT grp, idx, number, segment FROM seg"),
    "n04_duplicates": (
        lambda s, d: numbering.duplicates(numbering.segments(restarting_numbers(s, d), ["grp"]), ["grp"]),
        f"WITH {_SEGMENTS_SQL} SELECT grp, segment, number, count(*) AS n FROM seg GROUP BY ALL HAVING count(*) > 1"),
    "n06_isolated_typos": (
        lambda s, d: numbering.isolated_typos(restarting_numbers(s, d), ["grp"]),
        f"WITH {_SEGMENTS_SQL} SELECT grp, idx, number, back + 1 AS guess FROM near WHERE ahead = back + 2 AND number <> back + 1"),
    "n07_misplaced": (lambda s, d: numbering.misplaced(table(s, d, "orders").select(F.col("o_custkey").alias("grp"), F.col("o_orderkey").alias("idx"), F.when(F.col("o_orderkey") % 9 == 0, F.col("o_orderkey") - 4000).otherwise(F.col("o_orderkey")).alias("number")), ["grp"]), None),
    "n11_renumbered": (
        lambda s, d: numbering.renumbered(restarting_numbers(s, d), ["grp"]),
        f"WITH {RESTARTS_SQL} SELECT *, first_value(number) OVER (PARTITION BY grp ORDER BY idx) + row_number() OVER (PARTITION BY grp ORDER BY idx) - 1 AS new_number FROM numbers"),
    "f17_compact_ranges": (
        lambda s, d: numbering.compact_ranges(table(s, d, "lineitem").select(F.col("l_suppkey").alias("grp"), F.col("l_orderkey").alias("number")), ["grp"]),
        """WITH n AS (SELECT DISTINCT l_suppkey AS grp, l_orderkey AS number FROM lineitem), i AS (SELECT *, number - row_number() OVER (PARTITION BY grp ORDER BY number) AS island FROM n),
           r AS (SELECT grp, min(number) AS lo, max(number) AS hi FROM i GROUP BY grp, island)
           SELECT grp, string_agg(CASE WHEN lo = hi THEN CAST(lo AS VARCHAR) ELSE lo || '–' || hi END, '、' ORDER BY lo) AS ranges FROM r GROUP BY grp"""),
    "n10_length_report": (
        lambda s, d: numbering.length_report(_document_sections(s, d), ["doc_id"]),
        f"""WITH {LINES_SQL}, x AS (SELECT doc_id, row, length(replace(text, ' ', '')) AS n_chars FROM lines), m AS (SELECT doc_id, median(n_chars) AS m FROM x WHERE n_chars > 0 GROUP BY 1)
            SELECT doc_id, row, n_chars, CAST(m AS DOUBLE) AS median, CASE WHEN n_chars = 0 THEN 'empty' WHEN n_chars * 10 < m * 3 THEN 'short' WHEN n_chars > m * 3 THEN 'long' ELSE 'fine' END AS flag FROM x LEFT JOIN m USING (doc_id)"""),
    "f20_markers": (
        lambda s, d: books(s, d).groupBy(headings.marker(F.col("text")).alias("marker")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(headings.unmarked(F.col("text")))).alias("n_chars")),
        f"WITH {BOOKS_SQL} SELECT CASE WHEN text LIKE '%[::X]' THEN 'exclude' ELSE 'none' END AS marker, count(*) AS n, CAST(sum(length(replace(text, ' [::X]', ''))) AS BIGINT) AS n_chars FROM books GROUP BY 1"),
    "f03_f05_heading_kinds": (
        lambda s, d: structure.classified(books(s, d)).groupBy("kind", "unit").agg(F.count(F.lit(1)).alias("n"), F.sum("number").alias("sum_number")),
        f"WITH {PARSED_SQL} SELECT kind, unit, count(*) AS n, sum(number) AS sum_number FROM headed GROUP BY ALL"),
    "f07_weak_titles": (
        lambda s, d: table(s, d, "part").select("p_partkey", *[c.alias(n) for n, c in headings.weak(F.concat(F.when(F.col("p_partkey") % 2 == 0, "#").otherwise(""), F.col("p_partkey").cast("string"), F.lit(". "), F.col("p_name"))).items()]),
        "SELECT p_partkey, p_partkey AS number, CASE WHEN p_partkey % 2 = 0 THEN '#N.' ELSE 'N.' END AS style, p_name AS body FROM part"),
    "f19_end_marks": (
        lambda s, d: books(s, d).where(headings.end_mark(F.col("text"))).select("doc_id", "row"),
        f"WITH {PARSED_SQL} SELECT doc_id, row FROM headed WHERE ends"),
    "t01_t08_contents": (
        lambda s, d: _titles(s, d),
        f"WITH {_TOC_SQL} SELECT * FROM toc"),
    "t12_volume_summary": (
        lambda s, d: _titles(s, d).where("kind = 'chapter'").groupBy("doc_id", "parent_row").agg(F.count(F.lit(1)).alias("n"), F.min("number").alias("first"), F.max("number").alias("last")),
        f"WITH {_TOC_SQL} SELECT doc_id, parent_row, count(*) AS n, min(number) AS first, max(number) AS last FROM toc WHERE kind = 'chapter' GROUP BY ALL"),
    "t17_missed_titles": (
        lambda s, d: structure.missed_titles(books(s, d), _titles(s, d)),
        f"""WITH {_TOC_SQL}, c AS (SELECT * FROM headed WHERE regexp_matches(regexp_replace(text, '^[ 　]+', ''), '^第[^ 　]{{1,10}}[章回節卷部]'))
            SELECT doc_id, row, CASE WHEN text LIKE '%[::X]' THEN 'excluded' WHEN length(text) > 40 THEN 'too_long' WHEN regexp_matches(text, '[。，、；,;]$') THEN 'tail' ELSE 'unrecognised' END AS reason
            FROM c ANTI JOIN toc USING (doc_id, row)"""),
    "k03_sections": (
        lambda s, d: structure.section_texts(books(s, d), _titles(s, d)).select("doc_id", "section", F.md5("text").alias("digest")),
        f"WITH {_SECTIONS_SQL} SELECT doc_id, section, md5(rtrim(string_agg(text, chr(10) ORDER BY row), ' ' || chr(9) || chr(10) || '　')) AS digest FROM sec GROUP BY ALL"),
    "k03_section_sizes": (
        lambda s, d: structure.section_sizes(books(s, d), _titles(s, d)),
        f"WITH {_SECTIONS_SQL} SELECT doc_id, section, count(*) AS n_lines, CAST(sum(CASE WHEN is_title THEN 0 ELSE length(replace(replace(text, ' ', ''), '　', '')) END) AS BIGINT) AS n_chars FROM sec GROUP BY ALL"),
    "k04_file_names": (
        lambda s, d: structure.file_names(_titles(s, d).join(books(s, d), ["doc_id", "row"]).select("doc_id", "row", "text")).select("doc_id", "row", "file"),
        f"WITH {_TOC_SQL} SELECT doc_id, row, lpad(CAST(ord + 1 AS VARCHAR), 4, '0') || ' ' || trim(regexp_replace(b.text, '[\\\\/:*?\"<>|]', '_', 'g')) || '.txt' AS file FROM toc JOIN books b USING (doc_id, row)"),
    "e01_section_ranges": (
        lambda s, d: structure.section_ranges(_titles(s, d).select("doc_id", "row", F.when(F.col("kind") == "volume", 1).otherwise(2).alias("level"))).select("doc_id", "row", "stop"),
        f"WITH {_TOC_SQL} SELECT doc_id, row, (SELECT min(u.row) FROM toc u WHERE u.doc_id = t.doc_id AND u.row > t.row AND (t.kind <> 'volume' OR u.kind = 'volume')) AS stop FROM toc t"),
    "d03_sentences": (
        lambda s, d: duplicates.sentence_rows(table(s, d, "documents")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("sentence")).alias("n_chars")),
        f"WITH {_SENTENCES_SQL} SELECT doc_id, count(*) AS n, CAST(sum(length(s)) AS BIGINT) AS n_chars FROM sent GROUP BY 1"),
    "d06_similar_pairs": (
        lambda s, d: duplicates.similar_pairs(table(s, d, "documents"), duplicates.MAX_CHAPTERS),
        f"WITH {_PAIRS_SQL} SELECT * FROM hits"),
    "d06_similar_groups": (
        lambda s, d: duplicates.groups(duplicates.similar_pairs(table(s, d, "documents"), duplicates.MAX_CHAPTERS)),
        f"""WITH RECURSIVE {_PAIRS_SQL}, e AS (SELECT a, b FROM hits UNION SELECT b, a FROM hits),
            r AS (SELECT a AS doc_id, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id)
            SELECT doc_id, min(root) AS group_id FROM r GROUP BY 1"""),
    # without the cap that the SQL of d06_similar_pairs and d06_similar_groups has
    "d06_all_similar_pairs": (lambda s, d: duplicates.similar_pairs(table(s, d, "documents")), None),
    "d06_all_similar_groups": (lambda s, d: duplicates.similar_groups(table(s, d, "documents")), None),
    "d04_relations": (
        lambda s, d: duplicates.relations(_members(s, d), ["grp"]).select("grp", "idx", "relation"),
        r"""WITH x AS (SELECT source AS grp, doc_id AS idx, length(regexp_replace(text, '[ \t\r\n\f]+', '', 'g')) AS n,
              list_distinct(list_filter(regexp_split_to_array(regexp_replace(text, '[ \t\r\f]+', '', 'g'), '[.!?。！？…\n]+'), lambda s: length(s) >= 10)) AS s FROM documents),
            p AS (SELECT *, lag(n) OVER w AS n0, lag(s) OVER w AS s0 FROM x WINDOW w AS (PARTITION BY grp ORDER BY idx)),
            q AS (SELECT *, len(list_intersect(s, s0)) AS shared, least(len(s), len(s0)) AS small FROM p)
            SELECT grp, idx, CASE WHEN n0 IS NULL THEN NULL WHEN least(n, n0) < 100 THEN 'repost' WHEN shared * 10 >= small * 9 AND greatest(n, n0) * 10 <= least(n, n0) * 11 THEN 'same'
              WHEN shared * 10 >= small * 9 THEN CASE WHEN n > n0 THEN 'contains' ELSE 'contained' END WHEN shared * 10 >= small * 3 THEN 'partly' ELSE 'different' END AS relation FROM q"""),
    "d01_adjacent_groups": (
        lambda s, d: duplicates.adjacent_groups(table(s, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("row"), "o_orderstatus"), ["o_orderstatus"]),
        """WITH f AS (SELECT o_custkey AS doc_id, o_orderkey AS row, CASE WHEN o_orderstatus = lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) THEN 0 ELSE 1 END AS first FROM orders),
           g AS (SELECT doc_id, row, CAST(sum(first) OVER (PARTITION BY doc_id ORDER BY row) AS BIGINT) AS group_id FROM f)
           SELECT doc_id, group_id, row FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, group_id) > 1"""),
    "u03_update_plan": (
        lambda s, d: update.plan(*_old_and_new(s, d), ["doc_id", "number"]).select("doc_id", "new_idx", "position", "status"),
        f"WITH {_UPDATE_SQL} SELECT * FROM plan"),
    "u04_update_applied": (
        lambda s, d: _applied(s, d),
        f"""WITH {_UPDATE_SQL}, l AS (SELECT doc_id, idx AS place, -1 AS seq, 'old ' || idx AS text FROM old WHERE (doc_id, idx) NOT IN (SELECT doc_id, new_idx FROM plan WHERE status = 'longer')
              UNION ALL SELECT doc_id, CASE WHEN status = 'longer' THEN new_idx ELSE coalesce(position, -1) END, CASE WHEN status = 'longer' THEN -1 ELSE new_idx END, 'new ' || new_idx FROM plan WHERE status <> 'same')
            SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY place, seq) - 1 AS row, text FROM l"""),
    "u05_appended": (
        lambda s, d: update.appended(books(s, d).where("row < 50"), books(s, d).where("row >= 190").withColumn("row", F.col("row") - 190)).select("doc_id", "row", F.md5("text").alias("digest")),
        f"WITH {BOOKS_SQL}, n AS (SELECT doc_id, max(row) + 1 AS n FROM books WHERE row < 50 GROUP BY 1) SELECT doc_id, row, md5(text) AS digest FROM books WHERE row < 50 UNION ALL SELECT doc_id, row - 190 + n, md5(text) FROM books JOIN n USING (doc_id) WHERE row >= 190"),
}


def _applied(spark, sf_dir):
    old, new = _old_and_new(spark, sf_dir)
    accepted = update.plan(old, new, ["doc_id", "number"])
    line = lambda df, word: df.select("doc_id", F.col("idx").alias("chapter"), F.lit(0).cast("long").alias("row"), F.concat(F.lit(word), F.col("idx").cast("string")).alias("text"))
    return update.applied(line(old, "old "), line(new, "new "), accepted)
