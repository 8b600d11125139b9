"""Review operators that have no SQL: paragraphs, file order, front matter, levels."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from bookloom.operators import review


def brute_pieces(text):
    if len(text) < review.LONG:
        return [text]
    done, rest = [], ""
    for s in re.findall(r"[^。！？!?…]+[。！？!?…]*[”’」』）)\"]*[ ]*|[。！？!?…]+", text):
        rest += s
        opened = sum(rest.count(c) for c in "「『“（(") - sum(rest.count(c) for c in "」』”）)")
        if len(rest) >= review.PIECE and not opened and rest.count('"') % 2 == 0:
            done.append(rest)
            rest = ""
    if rest and done and len(rest) < review.MIN_PIECE:
        done[-1] += rest
    elif rest:
        done.append(rest)
    return done


def test_paragraphs(spark):
    r = random.Random(2)
    rows = [(1, i, "".join(r.choice("山水風月走來看聽") if r.random() < 0.93 else r.choice("。！？…「」，") for _ in range(r.choice([20, 299, 300, 500, 900, 2500])))) for i in range(40)]
    rows += [(1, 40, ""), (1, 41, "字" * 700), (1, 42, "「" + "字句。" * 300)]
    lines = spark.createDataFrame(rows, "doc_id long, row long, text string")
    got = {x.row: x.p for x in lines.select("row", review.paragraphs(F.col("text")).alias("p")).collect()}
    assert got == {i: brute_pieces(t) for _, i, t in rows}
    cut = review.cut_paragraphs(lines, "medium").orderBy("row").collect()
    assert [x.row for x in cut] == list(range(len(cut))) and [x.text for x in cut] == [p for _, i, t in rows for p in brute_pieces(t)]
    assert review.long_paragraphs(lines).where("confidence = 'high'").count() == sum(len(t) >= 500 and len(brute_pieces(t)) > 1 for *_, t in rows)


def test_files_and_candidates(spark):
    files = spark.createDataFrame([(1, "第10章.txt", "十"), (1, "第9章.txt", "九"), (1, "第８章.txt", "八"), (1, "第七章.txt", "七"), (1, "x.txt", None)], "book long, name string, text string")
    assert review.merged_files(files).first().text == "七\n\n八\n\n九\n\n十"
    assert review.merged_files(files, title_from_name=True).first().text.startswith("第七章\n七\n\n第８章\n八")
    candidates = spark.createDataFrame([(1, 0, 1, ["note"]), (1, 0, 1, ["note", "advert"]), (1, 2, 6, ["note"]), (2, 0, 1, ["note"])], "doc_id long, start long, end long, types array<string>")
    titles = spark.createDataFrame([(1, 5), (1, 9)], "doc_id long, row long")
    left = sorted((x.doc_id, x.start, len(x.types)) for x in review.without_front_matter(candidates, titles).collect())
    assert left == [(1, 0, 2), (1, 2, 1), (2, 0, 1)]


def test_file_names_by_the_value_of_their_numbers(spark):
    from bookloom.operators import review

    names = ["第九章.txt", "第十章.txt", "第11章.txt", "第十二章.txt", "第２０章.txt", "第九十九章.txt", "第100章.txt", "第一百零一章.txt", "第一千章.txt"]
    rows = spark.createDataFrame([(f"dir/9/{n}",) for n in reversed(names)], "name string")
    assert [r.name[6:] for r in rows.orderBy(review.name_key(F.col("name"))).collect()] == names


def test_same_books_in_pieces(spark, monkeypatch):
    """Many files of a title meet in pieces: no row has all of them, every pair is found."""
    monkeypatch.setattr(review, "SAME_PIECE", 4)
    r = random.Random(3)
    rows = [(i if i % 40 else None, r.choice(["Red Bolt", "red　bolt", "REDBOLT", "blue", None]), r.choice(["", "A a", "aa", "B", None])) for i in range(120)] + [(7, "blue", "B")]
    files = spark.createDataFrame(rows, "path long, title string, author string")
    fold = lambda x: None if x is None else re.sub("[ 　]", "", x).lower()
    want = [(p, q, bool(fold(a)) and fold(a) == fold(b)) for p, t, a in rows for q, u, b in rows
            if None not in (p, q, t, u) and p != q and fold(t) == fold(u) and (not a or not b or fold(a) == fold(b))]
    assert sorted(tuple(x) for x in review.same_book(files, files).collect()) == sorted(want)
    keyed = files.selectExpr("path", "lower(title) AS _t", "coalesce(author, '') AS _a")
    assert review._pieces(keyed, "path", "_a").selectExpr("max(size(path)) AS n").first().n <= 12
