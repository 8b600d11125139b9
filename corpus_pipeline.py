"""Training-corpus pipeline: quality rules, line dedup, near-duplicate documents,
benchmark decontamination, packing. Each stage takes (spark, docs, sf_dir) and returns a
DataFrame; all but the last return the columns of documents.

In every stage an empty table gives an empty one, columns may have any names beside doc_id
and text, texts of any length are read whole, and rows with a null doc_id stay: they are
judged where a row's text alone decides and take no part where documents are compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bookloom.llm import best_fit_packing, fuzzy_lines, quality_cascade, simhash_documents, template_decontamination
from bookloom.llm.shared import read, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects. Null and empty texts are rejected; rows that
    repeat are judged alike."""
    return quality_cascade.kept(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with one occurrence left of every group of near-equal lines: the first
    by doc_id and line. n_chars follows the text. Null texts stay null; rows that share a
    doc_id lose the same lines."""
    return fuzzy_lines.deduplicated(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each near-duplicate group; rows that share that
    doc_id all stay. Null and empty texts are equal texts."""
    return simhash_documents.kept(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item. Null and empty texts leak none; of rows that
    share a doc_id all stay or go."""
    return template_decontamination.clean(docs, read(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in a training sequence. Null and empty texts are
    an end sign; rows that repeat are packed each."""
    return best_fit_packing.packed(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Hash fingerprints and the tokenizer have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs)
    return docs
