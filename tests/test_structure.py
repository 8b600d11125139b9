"""Titles that depend on others: the pass over books against a direct one."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from bookloom.functions import context, titles
from bookloom.operators import acceptance, contents

EVENTS = "doc_id long, row long, part int, number double, number_text string, range_end double, accepts string, note string"


def lines(spark, texts, doc=1):
    return spark.createDataFrame([(doc, i, t) for i, t in enumerate(texts)], "doc_id long, row long, text string")


def direct(events):
    out, last = [], {}
    for doc, row, part, number, text, ends, accepts, _ in sorted(events, key=lambda e: (e[0] is not None, e[0] or 0, e[1], e[2])):
        before, settled = last.get(doc), number
        digits = text.replace(".", "")
        ten = int(text[:-2]) * 10 + int(text[-1]) if text.isdigit() and len(text) > 2 and text[-2] == "0" and text[-1] != "0" and text.startswith("x") else None
        if before and number % 1 and digits.isdigit() and int(digits) == before + 1:
            settled = float(digits)
        elif before and ten and abs(ten - before - 1) < abs(number - before - 1):
            settled = float(ten)
        ok = accepts == "always" or (accepts == "follows" and before is not None and before == number - 1) or (accepts == "unless_same" and before is not None and before != number)
        if ok:
            out.append((doc, row, part, settled if number > 0 else None))
            if number > 0:
                last[doc] = ends or settled
    return out


@pytest.mark.parametrize("block", [2000, 7, 1])
def test_settled_against_a_direct_pass(spark, block):
    r = random.Random(block)
    events = []
    for doc in (1, 2, 3, None):
        n = 0
        for row in range(0, 120, 1 if doc == 2 else 2):
            n += r.random() < 0.8
            number, text = float(n), str(n)
            if r.random() < 0.3 and n > 10 and n % 10:
                number, text = n / 10, f"{n // 10}.{n % 10}"
            events.append((doc, row, 0, number, text, float(n + 1) if r.random() < 0.1 else None, r.choice(["always", "follows", "follows", "unless_same"]), "x"))
    events += [(4, i, 0, 1 + i / 10, f"1.{i}", None, "follows", "") for i in range(1, 9)]  # nothing sets the state
    df = spark.createDataFrame(events, EVENTS).repartition(3)
    got = sorted(((x.doc_id, x.row, x.part, x.settled) for x in acceptance.settle(df, block_rows=block).collect()), key=str)
    assert got == sorted(direct(events), key=str)


def test_consecutive_ambiguous_numbers(spark):
    rows = lines(spark, ["第1816章 山", "第1.817章 水", "第1.818章 河", "第1.5章 橋", "第一一零一章 路", "第110章 茶", "第一一零一章 路", "第一一零二章 燈"])
    got = [(x.row, x.settled) for x in contents.records(contents.with_parents(contents.titles(rows), rows)).orderBy("row").collect()]
    assert got == [(0, 1816.0), (1, 1817.0), (2, 1818.0), (3, 1.5), (4, 111.0), (5, 110.0), (6, 111.0), (7, 112.0)]


def test_accepted(spark):
    rows = lines(spark, ["第1章 渡船。", "第2章 燈塔。", "第4章 走遠了。", "第3章 霧。", "他說。第5章 不是。", "第4章 山。他走。", "第4章 橋上（本卷完）", "本章完", "第4章完", "第100章 終", "第一卷 山路 完",
                         "第101章 " + "長" * 50, "第101章 " + "長" * 50 + "又說一遍", "第二卷 " + "山" * 25 + " 第102章 " + "水" * 25, "第103章完", "第1章：又一次。", "第1章 又，一次。"])
    got = [(x.row, x.part, x.kind, x.number) for x in acceptance.accepted(rows).orderBy("row", "part").collect()]
    assert got == [(0, 0, "chapter", 1.0), (1, 0, "chapter", 2.0), (3, 0, "chapter", 3.0), (6, 0, "chapter", 4.0), (9, 0, "chapter", 100.0), (11, 0, "chapter", 101.0),
                   (13, 0, "volume", 2.0), (13, 1, "chapter", 102.0), (14, 0, "chapter", 103.0), (15, 0, "chapter", 1.0)]
    assert acceptance.accepted(lines(spark, [])).count() == 0


def test_end_marks(spark):
    texts = ["第一卷終", "【第二卷终】", "（本卷完）", "卷三結束", "第一卷 山路 完", "第十章 完", "第十章 終章", "第三卷 完結篇", "全篇完", "完", "第一卷 " + "山" * 13 + " 完", "他說完"]
    got = {x.text: x.e and (x.e.level, x.e.number, x.e.unit, x.e.name) for x in lines(spark, texts).select("text", context.end_of(F.col("text")).alias("e")).collect()}
    assert got == {texts[0]: ("volume", 1.0, "卷", ""), texts[1]: ("volume", 2.0, "卷", ""), texts[2]: ("volume", None, "卷", ""), texts[3]: ("volume", 3.0, "卷", ""), texts[4]: ("volume", 1.0, "卷", "山路"),
                   texts[5]: ("chapter", 10.0, "章", ""), texts[6]: None, texts[7]: None, texts[8]: ("volume", None, "篇", ""), texts[9]: None, texts[10]: None, texts[11]: None}


def test_absorbed(spark):
    body = "字" * 120
    rows = lines(spark, ["第1章", "第1章 渡船", body, "第40章", "第32章 過河", body, "第7-9章 渡口", "站務", "第7章 渡口", body, "第10章 山", "短文", "第10章 山", body, "第10章 山", body,
                         "第11章 水", "第11章", "第11章 水路", body, "第12章 風起", "第12章 雲湧", body, "第13章 [::]", "第13章 門", body, "第14章", "第二卷 河", "第15章", body])
    found = contents.titles(rows, contextual=True)
    got = {(x.row, x.into_row, x.reason) for x in acceptance.absorbed(found, rows).collect()}
    assert got == {(0, 1, "phantom"), (3, 4, "bare"), (6, 8, "range"), (12, 10, "repeat"), (17, 18, "phantom")}
    same = lines(spark, ["第1章 山", "第1章 山 ", "第1章 山，", body, "第2章 水", "第2章 水", body, "第3章", "後記", "第3章 河"])
    got = {(x.row, x.into_row, x.reason) for x in acceptance.absorbed(contents.titles(same, contextual=True), same).collect()}
    assert got == {(1, 0, "adjacent"), (5, 4, "adjacent")}


def test_readings(spark):
    rows = spark.createDataFrame([("1.817", 1816.0), ("一一零一", 110.0), ("一一零一", 1100.0), ("1.5", 1.0), ("一零零", 5.0)], "t string, before double")
    from bookloom.functions.numerals import number

    got = [x.s for x in rows.select(titles.resolved_number(number(F.col("t")), F.col("t"), F.col("before")).alias("s")).collect()]
    assert got == [1817.0, 111.0, 1101.0, 1.5, 100.0]
