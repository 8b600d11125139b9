"""Hints about a table of contents, books cut into lines."""

from __future__ import annotations

from bookloom.operators import contents, hints


def frame(spark, books):
    return spark.createDataFrame([(d, i, t) for d, texts in books.items() for i, t in enumerate(texts)], "doc_id long, row long, text string")


def test_missed(spark):
    body = ["　　" + "字" * 80] * 16
    def books_of(*titles):
        return [x for t in titles for x in ["", t, *body]]
    books = {
        1: ["卷一 山", *body, "卷二 水", *body, "卷三 河", *body], 2: ["第一卷 山", "卷一 山", "卷二 水", "卷三 河"],
        3: books_of("第1章 山", "2、水", "3、河", "4、橋", "第5章 路"), 4: books_of("第1章 山", "2、水", "3、河", "第4章 路"), 5: ["第1章 山", "2、水", "3、河", "4、橋", "第5章 路"],
        6: books_of("第1章 山", "第2章 水", "3、河", "4、橋", "5、路"), 7: books_of("第1章 山", "第2章 水"),
    }
    lines = frame(spark, books).cache()
    found = contents.titles(lines).cache()
    weak = contents.suspects(lines, found).cache()
    assert [tuple(x) for x in hints.missed_volumes(lines, found).collect()] == [(1, 3)]
    assert [tuple(x) for x in hints.missed_middle(found, weak).collect()] == [(3, "plain、", 3, 1.0)]
    assert [tuple(x) for x in hints.missed_tail(lines, found, weak).collect()] == [(6, "plain、", 3, "counts")]
    none = frame(spark, {})
    assert hints.missed_volumes(none, contents.titles(none)).count() == 0


def test_hard_wraps(spark):
    cut = ["　　他說「今天", "要走了」。", ""]
    books = {1: cut * 60, 2: cut * 40, 3: cut * 60 + ["「", "x", ""] * 200, 4: ["「好」", "第1章 山", "「走」"], 5: []}
    lines = frame(spark, books)
    titles = frame(spark, {4: ["", "第1章 山"]}).where("text <> ''")
    assert [tuple(x) for x in hints.hard_wrapped(lines, titles).collect()] == [(1, 60, 120, 120)]
    assert hints.wrapped_paragraphs(lines, titles).where("doc_id = 4").count() == 0
