"""Reflow against a direct pass over the lines."""

from __future__ import annotations

import random
import re
import unicodedata
from statistics import median

from pyspark.sql import functions as F

from bookloom.operators import reflow

BLANKS = " \t　\u00a0"


def width(text):
    n = 0
    for c in text:
        n += 0 if unicodedata.combining(c) else 4 - n % 4 if c == "\t" else 2 if unicodedata.east_asian_width(c) in "WF" else 1
    return n


def stacked(stack, text):
    for c in text:
        if c in reflow.PAIRS:
            stack = stack + reflow.PAIRS[c]
        elif stack and c in reflow.PAIRS.values() and stack[-1] == c:
            stack = stack[:-1]
    return stack


def direct(texts, fixed):
    java = lambda p: re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: "\\u" + m[1], p))
    guarded, indent, terminal, closers = (java(p) for p in (reflow.PROTECTED, reflow.INDENT, reflow.TERMINAL, reflow.ONLY_CLOSERS))
    is_fixed = lambda i: i in fixed or bool(guarded.search(texts[i]))

    def repeated(i):
        low, high = i, i
        while low > 0 and low > i - 10 and low not in fixed and low - 1 not in fixed:
            low -= 1
        while high + 1 < len(texts) and high < i + 10 and high + 1 not in fixed:
            high += 1
        w, alike = width(texts[i].strip(BLANKS)), []
        for j in range(low, high + 1):
            t = texts[j].strip(BLANKS)
            if t and not is_fixed(j) and 24 <= width(t) <= 180 and abs(width(t) - w) <= max(4, w * 0.08):
                alike.append((width(t), bool(terminal.search(texts[j].rstrip(BLANKS)))))
        m = median(x for x, _ in alike) if alike else 0
        return len(alike) >= 3 and sum(not t for _, t in alike) >= 2 and abs(w - m) <= max(4, m * 0.08)

    out, open_, stack, indented = [], False, "", False
    for i, text in enumerate(texts):
        if not open_:
            stack, indented = "", bool(indent.search(text))
        stack = stacked(stack, text)
        joins = False
        if i + 1 < len(texts):
            left, right = text.rstrip(BLANKS), texts[i + 1].strip(BLANKS)
            if left.strip(BLANKS) and right and not is_fixed(i) and not is_fixed(i + 1) and not indent.search(texts[i + 1]):
                w = width(left.strip(BLANKS))
                marks = "".join(c for c in right if c in reflow.PAIRS.values())
                if closers.search(right) and stack.endswith(marks[::-1]):
                    joins = True
                elif not terminal.search(left) and not (re.match("[0-9A-Za-z]", left[-1]) and re.match("[0-9A-Za-z]", right[0])):
                    cut = stacked("", text) and left[-1].isalnum() and right[0] not in reflow.PAIRS
                    joins = bool(cut) or (24 <= w <= 180 and (repeated(i) or indented))
        out.append(joins)
        open_ = joins
    paragraphs, rows = [], []
    for i, text in enumerate(texts):
        if i and out[i - 1]:
            paragraphs[-1] = paragraphs[-1].rstrip(" \t") + text.lstrip(" \t")
        else:
            paragraphs.append(text)
        rows.append(len(paragraphs) - 1)
    return paragraphs, rows


def test_against_a_direct_pass(spark):
    r = random.Random(3)
    part = lambda n: "".join(r.choice("山水河橋路燈塔霧abc") for _ in range(n))
    books, fixed = {}, {}
    for doc in range(12):
        texts = []
        for _ in range(60):
            kind = r.randrange(12)
            body = part(r.choice([20, 20, 20, 21, 19, 33]))
            texts.append(["", "第3章 " + part(4), "　　" + body, body, body, body, body + "。", "「" + part(9), "」", "」。", "”", "“" + part(20)][kind] + r.choice(["", "", " ", "。", "，"]))
        books[doc], fixed[doc] = texts, {r.randrange(60) for _ in range(3)}
    books[99] = ["a" * 30, "b" * 30, "山" * 20, "水" * 20, "河" * 20, "- item", "12. x", "作者：某", None or ""]
    fixed[99] = set()
    df = spark.createDataFrame([(d, i, t) for d, texts in books.items() for i, t in enumerate(texts)], "doc_id long, row long, text string").repartition(3)
    keep = spark.createDataFrame([(d, i) for d, some in fixed.items() for i in some], "doc_id long, row long")
    paragraphs, rows = reflow.reflowed(df, keep)
    got, where = {}, {}
    for x in paragraphs.orderBy("doc_id", "row").collect():
        got.setdefault(x.doc_id, []).append(x.text)
    for x in rows.orderBy("doc_id", "row").collect():
        where.setdefault(x.doc_id, []).append(x.new_row)
    for doc, texts in books.items():
        want = direct(texts, fixed[doc])
        assert got[doc] == want[0], doc
        assert where[doc] == want[1], doc
    assert sum(len(v) for v in got.values()) < sum(len(v) for v in books.values()) - 50


def test_maps_compose(spark):
    one = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (1, 2, 1)], "doc_id long, row long, new_row long")
    two = spark.createDataFrame([(1, 0, 0), (1, 0, 1), (1, 1, 2)], "doc_id long, row long, new_row long")
    assert sorted((x.row, x.new_row) for x in reflow.composed(one, two).collect()) == [(0, 0), (1, 0), (2, 2)]
    none = spark.createDataFrame([], "doc_id long, row long, text string")
    assert [x.count() for x in reflow.reflowed(none)] == [0, 0]


def test_spaces(spark):
    cases = {"　　他 說 了  話 。 ": "　　他說了話 。", "我用 Notepad  排版 的": "我用 Notepad 排版的", "第1章  山": "第1章  山", "a　b": "a b", "  x  y ": "  x y", "": "", "  ": "  "}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", reflow.even_spaces(F.col("t")).alias("e")).collect()
    assert {x.t: x.e for x in rows} == cases
