"""Operators on small tables, and every registered query against its SQL."""

from __future__ import annotations

import glob
import html
import os
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from bookloom.functions import headings, markup, numerals
from bookloom.operators import boilerplate, duplicates, numbering, spans, structure, update
from bookloom.plans import registry
from bookloom.sources import lines as source

DATA = "/root/testdata/sf0.001"


def one(spark, value, build):
    return spark.createDataFrame([(value,)], "x string").select(build(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("text", "want"), [
    ("#123456. red bolt", (123456, "#N.", "red bolt")), ("1200000. red bolt", (1200000, "N.", "red bolt")), ("99999. x", (99999, "N.", "x")), ("9" * 20 + ". x", (None, "N.", "x"))])
def test_weak_numbers_of_any_length(spark, text, want):
    assert tuple(spark.createDataFrame([(text,)], "x string").select(*[c.alias(n) for n, c in headings.weak(F.col("x")).items()]).first()) == want


@pytest.mark.parametrize(("text", "want"), [
    ("十二", 12), ("一百零五", 105), ("二〇一", 201), ("壹拾貳", 12), ("兩萬三千", 23000), ("１２.5", 12.5), ("99999999999", 0), ("十", 10), ("", 0), ("abc", 0),
    ("三億零五", 300000005), ("一千零一十", 1010)])
def test_numeral_values(spark, text, want):
    assert one(spark, text, numerals.number) == want


def test_numerals_round_trip(spark):
    got = spark.range(0, 120_000, 7).select("id", numerals.number(numerals.chinese(F.col("id"))).alias("back")).where("id <> back")
    assert got.count() == 0
    shown = spark.createDataFrame([(0,), (10,), (105,), (20010,), (110,)], "n long").select(numerals.chinese(F.col("n")).alias("t"))
    assert [r.t for r in shown.collect()] == ["零", "十", "一百零五", "二萬零一十", "一百一十"]


@pytest.mark.parametrize(("text", "kind", "number"), [
    ("第一卷 潮聲", "volume", 1), ("第2章 渡船", "chapter", 2), ("　　他把纜繩丟上岸。", "body", None), ("第3章 霧[::X]", "body", 3), ("番外 茶館", "special", None),
    ("後記", "special", None), ("第二部分是碼頭的倉庫", "body", None), ("第１０章：名", "chapter", 10), ("第4章 句子。", "body", 4), ("", "body", None)])
def test_headings(spark, text, kind, number):
    row = spark.createDataFrame([(text,)], "text string").select(*[c.alias(n) for n, c in headings.parts(F.col("text")).items()]).first()
    assert (row.kind, row.number) == (kind, number)


def test_contents_end_with_the_volume(spark):
    rows = ["第一卷 潮", "第1章 甲", "正文", "第一卷終", "第2章 乙", "第二卷 夜", "番外 丙"]
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(rows)], "doc_id long, row long, text string")
    got = [(r.row, r.kind, r.parent_row, r.ord) for r in structure.toc(lines).orderBy("row").collect()]
    assert got == [(0, "volume", None, 0), (1, "chapter", 0, 1), (4, "chapter", None, 2), (5, "volume", None, 3), (6, "special", 5, 4)]
    whole = structure.section_texts(lines, structure.toc(lines)).orderBy("section").collect()
    assert "\n".join(r.text for r in whole) == "\n".join(rows)


@pytest.mark.parametrize(("text", "want"), [
    ("<p>甲<br>乙</p>", "甲\n乙"), ("甲&nbsp;乙&amp;丙", "甲&nbsp;乙&amp;丙"), ("<article>x</article>", "<article>x</article>"), ("a<b>b</b>", "ab")])
def test_untagged(spark, text, want):
    assert one(spark, text, markup.untagged) == want


def test_markup_details(spark):
    assert one(spark, "甲&nbsp;乙&amp;丙&copy;", markup.decoded) == "甲 乙&丙&copy;"
    assert one(spark, "[b]甲[/b]", markup.without_forum_codes) == "甲"
    assert one(spark, "[b]甲", markup.without_forum_codes) == "[b]甲"


def test_breaks_and_marks(spark):
    assert one(spark, "a\r\nb\rc d e", source.with_plain_breaks) == "a\nb\nc\nd e"
    assert one(spark, "a﻿b​c", source.without_invisible) == "abc"
    assert one(spark, "山門 [::x]  ", headings.marker) == "exclude" and one(spark, "[::W] 山門", headings.marker) == "none"
    assert one(spark, "山門[::]", headings.unmarked) == "山門"


def test_whole_texts_and_tables(spark, tmp_path):
    from bookloom.sources import decode

    late = spark.createDataFrame([("x" * 100_000 + "\r\n", "y" * 300_000 + "\ue000" * 30_000), ("x\n\r", "y")], "a string, b string")
    got = late.select(decode.line_ending(F.col("a").cast("binary")).alias("e"), source.looks_misdecoded(F.col("b")).alias("m")).collect()
    assert [tuple(r) for r in got] == [("CRLF", True), ("LF", False)]
    # one order of each kind of line, in different books
    orders = spark.createDataFrame([(1000 * k + k, "P", "S") for k in range(8)], "o_orderkey long, o_orderpriority string, o_orderstatus string")
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    found = lambda name: registry.queries()[name](spark, str(tmp_path)).collect()
    assert {r.row: r.n for r in found("p14_all_unbalanced")} == {1: 1, 2: 1}
    assert {r.row for r in found("q08_all_realigned")} == set(range(8))
    kinds = {r.kind: r.n for r in found("p12_q01_all_problems")}
    assert kinds["unclosed"] == 2 and kinds["stuck_dialogue"] == 1


def brute_merge(some, touching):
    out = []
    for s, e in sorted(some):
        if out and s <= out[-1][1] + (1 if touching else 0):
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return sorted(map(tuple, out))


def test_spans(spark):
    r = random.Random(2)
    some = {(s, s + r.randrange(4)) for s in (r.randrange(60) for _ in range(25))}
    frame = spark.createDataFrame([(1, *x) for x in some], "doc_id long, start long, end long")
    for touching in (True, False):
        got = sorted((x.start, x.end) for x in spans.merged(frame, touching).collect())
        assert got == brute_merge(some, touching)
    lines = spark.createDataFrame([(1, i, str(i)) for i in range(70)], "doc_id long, row long, text string")
    left = [x.text for x in spans.without_rows(lines, frame).orderBy("row").collect()]
    assert left == [str(i) for i in range(70) if not any(s <= i <= e for s, e in some)]
    assert spans.without_rows(lines, frame.limit(0)).where("row <> src_row").count() == 0


def test_number_sequences(spark):
    def rows(numbers):
        return spark.createDataFrame([("b", i, n) for i, n in enumerate(numbers)], "g string, idx long, number long")

    gaps = lambda n, mode: sorted((r.first_missing, r.last_missing) for r in numbering.missing_ranges(rows(n), ["g"], mode).collect())
    assert gaps([1, 2, 3, 5, 6], "middle") == [(4, 4)] and gaps([3, 4, 6], "middle") == [(5, 5)] and gaps([3, 4, 6], "from_one") == [(1, 2), (5, 5)]
    assert [r.segment for r in numbering.segments(rows([1, 2, 3, 10, 1, 2, 3]), ["g"]).orderBy("idx").collect()] == [0, 0, 0, 0, 1, 1, 1]
    assert [(r.idx, r.guess) for r in numbering.isolated_typos(rows([1, 2, 225, 4]), ["g"]).collect()] == [(2, 3)]
    assert [r.idx for r in numbering.misplaced(rows([1, 2, 4, 3, 5]), ["g"]).collect()] in ([2], [3])
    assert numbering.compact_ranges(rows([1, 3, 2, 7]), ["g"]).first().ranges == "1–3、7"


def test_duplicates(spark):
    a = "The first sentence is here. Another one follows it. And a third sentence stands."
    docs = spark.createDataFrame([(1, a), (2, a + " More text is added here."), (3, "Something else entirely is said."), (4, None), (5, "")], "doc_id long, text string")
    pairs = duplicates.similar_pairs(docs)
    assert [(r.a, r.b) for r in pairs.collect()] == [(1, 2)]
    assert {(r.doc_id, r.group_id) for r in duplicates.groups(pairs).collect()} == {(1, 1), (2, 1)}


def test_many_copies_and_long_chains(spark):
    """More copies than any cap, shared common sentences, and a chain of 90 links."""
    r = random.Random(4)
    common = [f"common sentence number {i} of all" for i in range(8)]
    texts = {i: common[:3] + ["only the copies have this one"] for i in range(30)}
    texts |= {100 + i: r.sample(common, r.randrange(2, 7)) + [f"own sentence {i} and {k} here" for k in range(r.randrange(3))] for i in range(30)}
    sets = {i: set(x) for i, x in texts.items()}
    want = {(a, b, len(sets[a] & sets[b]), min(len(sets[a]), len(sets[b]))) for a in sets for b in sets
            if a < b and len(sets[a] & sets[b]) >= 0.6 * min(len(sets[a]), len(sets[b]))}
    docs = spark.createDataFrame([(i, ". ".join(x)) for i, x in texts.items()], "doc_id long, text string")
    assert {tuple(x) for x in duplicates.similar_pairs(docs).collect()} == want
    copies = docs.where("doc_id < 30")
    assert {tuple(x) for x in duplicates.similar_groups(copies).collect()} == {(i, 0) for i in range(30)}
    chain = spark.createDataFrame([(i, i + 1) for i in range(90)], "a long, b long")
    assert {tuple(x) for x in duplicates.groups(chain).collect()} == {(i, 0) for i in range(91)}


def test_passages_are_no_boilerplate(spark):
    block = [f"a line of the passage number {i}" for i in range(7)]
    text = [*block, "unique words stand here", *block, "another unique line here", *block, "buy at our shop today", "x", "buy at our shop today", "y", "buy at our shop today"]
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(text)], "doc_id long, row long, text string")
    found = boilerplate.repeated_lines(lines)
    assert found.count() == 8
    assert [r.form for r in boilerplate.without_passages(lines, found).collect()] == ["buyatourshoptoday"]


def test_update(spark):
    old = spark.createDataFrame([("b", 1, 0, 500), ("b", 2, 1, 500), ("b", 4, 2, 500)], "doc string, number long, idx long, n_chars long")
    new = spark.createDataFrame([("b", n, i, c) for i, (n, c) in enumerate([(1, 500), (2, 900), (3, 500), (4, 510), (5, 500)])], "doc string, number long, idx long, n_chars long")
    got = [(r.new_idx, r.status, r.position) for r in update.plan(old, new, ["doc", "number"]).orderBy("new_idx").collect()]
    assert got == [(0, "same", 0), (1, "longer", 1), (2, "missing", 1), (3, "same", 2), (4, "new", 2)]


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, oracle, name):
    out = registry.queries()[name](spark, DATA)
    want = oracle.sql(registry.oracle_sql()[name])
    columns = sorted(out.columns)
    assert columns == sorted(want.columns)
    got = sorted(repr(tuple(r)) for r in out.select(*columns).collect())
    assert got == sorted(map(repr, want.select(*[f'"{c}"' for c in columns]).fetchall()))


def direct_story(form):
    """P-06 as a loop over characters."""
    letters = [c for c in form if c.isalnum()]
    if not letters or re.match('^[^:：“「『"]{1,8}[:：][“「『"]', form) or re.match(r"^[【\[][^】\]]{1,40}[】\]]$", form):
        return True
    if len(set(letters)) <= 3 and max(letters.count(c) for c in letters) >= 3:
        return True
    return form[0] in "“「『\"" and form[-1] in "”」』\""


def test_story_lines(spark):
    r = random.Random(9)
    forms = ["啪啪啪！！！", "噗滋……噗滋……噗滋……", "（本章完）", "【系統】升級", "【系統升級】", "名字：「你好」他說", "「你好」", "「你好」他說", "!!!", "a", "aab", "aaab", "abcabcabc", "abcdabcabc"]
    forms += ["".join(r.choice("aabbcd!「」【】:") for _ in range(r.randrange(1, 12))) for _ in range(500)]
    rows = spark.createDataFrame([(f, direct_story(f)) for f in forms], "form string, want boolean")
    assert rows.where(boilerplate.is_dialogue_or_marks(F.col("form")) != F.col("want")).collect() == []


def test_references(spark):
    told = {"a&#65;b&#x4E2D;&amp;lt;": "aAb中&lt;", "&#38;lt;": "&lt;", "&amp;#65;": "&#65;", "&#0000065;": "A", "&#1;x": "&#1;x", "&#11;x": "x", "&#55296;": "\ufffd", "&#x110000;": "\ufffd", "&#147;q&#148;": "“q”",
            "&#160;&emsp;&thinsp;|&#8195;": "   | ", "&#128512;": "😀", "&copy;&#65": "&copy;&#65", "&middot;&laquo;": "·«", "&#x3c;p&#62;": "<p>", "": "", "&#64976;": "", "&#129;": "\x81"}
    rows = spark.createDataFrame([*told.items(), (None, None)], "text string, want string")
    assert rows.select(markup.decoded(F.col("text")).alias("got"), "want", "text").where("NOT got <=> want").collect() == []
    # as the standard library reads them, spaces apart
    codes = [c for c in range(10, 0x3000) if c not in (0xA0, 0x2002, 0x2003, 0x2009)]
    got = spark.createDataFrame([(c, f"&#{c};") for c in codes], "c int, text string").select("c", markup.decoded(F.col("text")).alias("t")).collect()
    assert [x.c for x in got if x.t != html.unescape(f"&#{x.c};")] == []
