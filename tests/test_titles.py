"""The title grammar, rules from blocks, and contents of small books."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from bookloom.functions import rules, titles
from bookloom.operators import contents

BOOK = ["雲港夜話", "第一卷 潮聲", "第1章 渡船", "　　他把纜繩丟上岸。", "第2章", "燈塔", "第一卷終", "第3章 霧[::X]", "番外 茶館", "後記", "第二部分是碼頭的倉庫",
        "第二卷 山 第4章 橋", "　　走過去。", "第二卷 山 第5章 河", "第5章", "　　走回來。", "PS：第6章 晚點", "別冊 [::w]", "第.7章 路", "第8-9章 雙", "Chapter 10 End"]


def lines(spark, texts, doc=1):
    return spark.createDataFrame([(doc, i, t) for i, t in enumerate(texts)], "doc_id long, row long, text string")


def test_contents_of_a_book(spark):
    rows = lines(spark, BOOK)
    found = contents.with_parents(contents.titles(rows), rows).orderBy("row", "part").collect()
    got = [(r.row, r.part, r.kind, r.unit, r.number, r.name, r.parent_row) for r in found]
    assert got == [
        (1, 0, "volume", "卷", 1.0, "潮聲", None), (2, 0, "chapter", "章", 1.0, "渡船", 1), (4, 0, "chapter", "章", 2.0, "", 1), (8, 0, "side", "", 0.0, "茶館", None), (9, 0, "special", "後記", 0.0, "", None),
        (11, 0, "volume", "卷", 2.0, "山", None), (11, 1, "chapter", "章", 4.0, "橋", 11), (13, 1, "chapter", "章", 5.0, "河", 11), (14, 0, "chapter", "章", 5.0, "", 11),
        (17, 0, "work", "", 0.0, "別冊", None), (18, 0, "chapter", "章", 7.0, "路", 11), (19, 0, "chapter", "章", 8.0, "雙", 11)]
    by_rule = contents.titles(rows, rules.PRESETS).where("source = 'rule'").collect()
    assert [(r.row, r.kind, r.number, r.name) for r in by_rule] == [(20, "chapter", 10.0, "End")]
    assert contents.titles(lines(spark, [])).count() == 0


def test_names_on_the_next_line_and_repeats(spark):
    rows = lines(spark, ["第2章", "", "燈塔", "第3章", "　　縮排的正文", "第4章", "「對話」", "第5章", "一句話。", "第6章 門", "第6章", "正文", "第7章", "7、河"])
    found = contents.titles(rows)
    named = contents.with_subtitles(found, rows).where("subtitle IS NOT NULL").orderBy("row").collect()
    assert [(r.row, r.subtitle, r.subtitle_row) for r in named] == [(0, "燈塔", 2), (10, "正文", 11), (12, "河", 13)]
    kept = contents.without_repeats(found, rows).orderBy("row").collect()
    assert [(r.row, r.number, r.name) for r in kept] == [(0, 2.0, ""), (3, 3.0, ""), (5, 4.0, ""), (7, 5.0, ""), (10, 6.0, "門"), (12, 7.0, "")]


def test_suspects(spark):
    body = "字" * 220
    rows = lines(spark, ["", "1、山", body, "", "2、水", body, "", "3、河", body, "12 隻羊走過，又走回"])
    got = {r.row: (r.style, r.score, r.confidence) for r in contents.suspects(rows, contents.titles(rows)).collect()}
    assert got == {1: ("plain、", 7, "high"), 4: ("plain、", 9, "high"), 7: ("plain、", 7, "high")} | {9: got[9]} and got[9][2] == "low"


def test_limits(spark):
    texts = ["第1章 山。", "第1章 山...", "第1章 山.", "第1章「山」", "第1章：", "第1章 " + "山" * 60, "第1章 " + "山" * 60 + "。水", "山" * 41, "山 " + " " * 30 + "水" * 12]
    rows = lines(spark, texts).select("row", titles.valid_title(F.col("text")).alias("ok")).orderBy("row").collect()
    assert [r.ok for r in rows] == [False, True, False, True, True, True, False, False, True]


def test_blocks():
    formal = rules.TEMPLATES["formal_chapter"]
    assert rules.confidence(formal) == "high" and rules.confidence(rules.TEMPLATES["dot_number"]) == "medium" and rules.confidence(rules.TEMPLATES["space_number"]) == "low"
    assert rules.block_name(rules.Blocks(("第",), units=("章",))) == "第N章 title" and rules.block_name(rules.TEMPLATES["bare_number"]) == "N"
    with pytest.raises(ValueError, match="block"):
        rules.Blocks(numbers=("roman",))

    def fits(blocks, text):
        for pattern, n, name, _ in rules.compiled(blocks):
            if found := re.match(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: "\\u" + m[1], pattern), text):
                return found[n], found[name]
        return None

    assert fits(formal, "第12章 山") == ("12", "山") and fits(formal, "【第三回】山") == ("三", "山") and fits(formal, "第12章") == ("12", "") and fits(formal, "12章 山") is None
    assert fits(rules.TEMPLATES["dot_number"], "12. 山") == ("12", "山") and fits(rules.TEMPLATES["bare_number"], "123") == ("123", "") and fits(rules.TEMPLATES["bare_number"], "123x") is None
    for sample, other in (("#1 山", "#22 水"), ("(3) 山", "(14) 水"), ("第1回：山", "第9回：水"), ("Part 3 - a", "Part 4 - b")):
        rule = rules.rule_of_sample(sample)
        assert rule and any(re.match(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: "\\u" + m[1], p[0]), other) for p in rule.patterns), sample
    assert rules.rule_of_sample("no number here") is None


def test_user_rules_come_in_order(spark):
    mine = (rules.Rule("mine", ((r"^-- ([0-9]+) --(.*)$", 1, 2, 0),), 1, checked=False), rules.word_rule("幕間"), rules.Rule("off", (("^.*$", 0, 0, 0),), enabled=False), *rules.PRESETS)
    rows = lines(spark, ["-- 3 --", "幕間：茶", "幕間茶", "正文 12. 山", "12. 山。", "-- 0 --"])
    got = {r.row: (r.x.rule, r.x.level, r.x.number, r.x.title) for r in rows.select("row", rules.matched(F.col("text"), mine).alias("x")).where("x IS NOT NULL").collect()}
    assert got == {0: ("mine", 1, 3, ""), 1: ("幕間", 2, 0, "幕間：茶"), 3: ("dot_number", 2, 12, "山")}


def test_equal_lines_are_parsed_once(spark):
    from bookloom.operators import contents

    rows = [(d, r, t) for d in (1, 2) for r, t in enumerate(["第1章 山", "x", "第1章 山", None, "序章", "第一卷 水"])]
    found = contents.titles(spark.createDataFrame(rows, "doc_id long, row long, text string"))
    assert sorted((x.doc_id, x.row, x.kind, x.name) for x in found.collect()) == [(d, *x) for d in (1, 2) for x in ((0, "chapter", "山"), (2, "chapter", "山"), (4, "special", ""), (5, "volume", "水"))]
    assert "Aggregate [text" in found._jdf.queryExecution().optimizedPlan().toString()
