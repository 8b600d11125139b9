"""Steps whose time must not grow faster than their input, and that all cores must share."""

from __future__ import annotations

import time

from bookloom.operators import duplicates, editing, numbering, review, structure
from bookloom.plans import review_queries
from bookloom.sources import containers


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def lines(spark):
    return spark.createDataFrame([(d, i, t) for d in range(3) for i, t in enumerate(["第一卷 山", "第1章 水", "　　文。", "第一卷終", "第2章 火"])], "doc_id long, row long, text string")


def test_contents_are_found_once(spark):
    rows = lines(spark)
    titles = structure.toc(rows)
    sizes = structure.section_sizes(rows, titles)
    assert plan(sizes).count("Join") == 1 and sorted(map(tuple, sizes.where("doc_id = 0").collect())) == [(0, 0, 1, 0), (0, 1, 3, 6), (0, 2, 1, 0)]
    depths = editing.depths(titles)
    assert "RLIKE" not in plan(depths) and {(x.row, x.depth) for x in depths.collect()} == {(0, 0), (1, 1), (4, 0)}


def test_books_are_packed_by_all_cores(spark):
    sections = spark.createDataFrame([(d, 0, "a", "b") for d in range(3)], "doc_id long, section long, title string, text string")
    assert containers.epubs(sections).rdd.getNumPartitions() > spark.sparkContext.defaultParallelism


def test_the_grammar_is_not_taken_by_the_scan(spark):
    found = review_queries.x06_rule_coverage(spark, "/root/testdata/sf0.001")
    below = [part.split("Relation")[0] for part in plan(found).split("RepartitionByExpression")[1:]]
    assert len(below) == 2 and not any("named_struct" in part or "transform(" in part for part in below)


def test_a_line_that_closes_nothing_is_cut_in_linear_time(spark):
    text = "「" + "山水，走過。" * 60_000
    began = time.monotonic()
    got = review.cut_paragraphs(spark.createDataFrame([(1, 0, text), (1, 1, None)], "doc_id long, row long, text string"), "medium").orderBy("row").collect()
    assert [x.text for x in got] == [text, None] and time.monotonic() - began < 60


def test_shared_sentences_are_found_once(spark):
    docs = spark.createDataFrame([(i, f"The first of all sentences. The second sentence here. Own sentence number {i}.") for i in range(6)], "doc_id long, text string")
    found = duplicates.similar_pairs(docs)
    # what the pairs are counted in is kept, without texts
    assert "regexp_replace" not in plan(found) and {tuple(x) for x in found.collect()} == {(a, b, 2, 3) for b in range(6) for a in range(b)}


def test_ranges_are_dealt_over_all_cores(spark):
    numbers = spark.createDataFrame([(g, n) for g in range(9) for n in (1, 2, 2, 4, 7, 8)], "grp long, number long")
    found = numbering.compact_ranges(numbers, ["grp"])
    assert {tuple(x) for x in found.collect()} == {(g, "1–2、4、7–8") for g in range(9)}
    assert found.rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
