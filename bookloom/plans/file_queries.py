"""Queries that encode, pack and read files made from the given tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from bookloom.operators import structure
from bookloom.plans.derived import BOOKS_SQL, books, table
from bookloom.sources import containers, decode, lines

CODECS = ("utf-8", "utf-16-le", "gb18030", "utf-8-sig")


def encoded_books(spark, sf_dir):
    """(doc_id, content): books in different encodings."""
    docs = lines.joined(books(spark, sf_dir))

    @F.pandas_udf("binary")
    def encode(doc_id: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([t.encode(CODECS[i % 4]) for i, t in zip(doc_id, text)])

    return docs.withColumn("content", encode("doc_id", "text")).select("doc_id", "content")


def _epub_round_trip(spark, sf_dir):
    rows = books(spark, sf_dir)
    texts = structure.section_texts(rows, structure.toc(rows)).withColumn("title", F.concat(F.lit("part "), F.col("section").cast("string")))
    files = containers.epubs(texts).withColumn("path", F.lit("book.epub"))
    read = containers.read_files(files)
    return read.select("doc_id", "title", F.size(F.split("text", "\n\n")).cast("long").alias("n_sections"), F.col("error").isNull().alias("readable"))


_BOOK_TEXT_SQL = BOOKS_SQL + ", docs AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY row) AS text FROM books GROUP BY 1)"

QUERIES = {
    "s01_s03_decoded": (
        lambda s, d: decode.decoded(encoded_books(s, d)).select("doc_id", "encoding", "n_damaged", F.md5("text").alias("digest")),
        f"WITH {_BOOK_TEXT_SQL} SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'utf-16-le' WHEN 2 THEN 'gb18030' ELSE 'utf-8-sig' END AS encoding, CAST(0 AS BIGINT) AS n_damaged, md5(text) AS digest FROM docs"),
    "s05_line_endings": (
        lambda s, d: table(s, d, "documents").select("doc_id", decode.line_ending(F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit("\r\n"))).otherwise(F.col("text")).cast("binary")).alias("ending")),
        "SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND strpos(text, chr(10)) > 0 THEN 'CRLF' ELSE 'LF' END AS ending FROM documents"),
    "k05_s10_epub_round_trip": (
        _epub_round_trip,
        None),
}
