"""Fix plans by example, their application against a direct one."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from bookloom.operators import fixes


def frame(spark, books):
    return spark.createDataFrame([(d, i, t) for d, texts in books.items() for i, t in enumerate(texts)], "doc_id long, row long, text string")


def test_text_fixes(spark):
    cases = {
        "repeated_punct": {"走了。。。。": "走了……", "…………": "……", "他說...好吧": "他說……好吧", "Wait... what": "Wait... what", "嗯 ... 好": "嗯……好", "...": "……", "… …": "……", "啊. . . 好": "啊. . . 好"},
        "dash_run": {"蹄聲—————": "蹄聲——", "嘎吱——-": "嘎吱——", "啊~~~~": "啊～", "a--b": "a--b", "2020--2021": "2020--2021", "他--走": "他——走", "————分割線————": "————分割線————", "好——": "好——", "x~~y": "x~~y", "-----": "-----"},
        "separator_line": {"----------": "---", "===": "===", "== ==": "== ==", "★★★★": "★★★"},
        "noise_dot": {"山.路": "山路", "一．山路": "一．山路", "第.18章": "第18章", "第1.817章": "第1817章", "第1.5章": "第1.5章", "他走.了": "他走了"},
        "homoglyph": {"Вook": "Book", "книга": "книга"},
    }
    rows = spark.createDataFrame([(k, t, w) for k, some in cases.items() for t, w in some.items()], "kind string, t string, want string")
    for x in rows.select("kind", "t", "want", fixes.local_fix(F.col("t"), F.col("kind")).alias("got")).collect():
        assert x.got == x.want, (x.kind, x.t, x.got)


def test_plans(spark):
    books = {
        1: ["「你說什麼？」「走吧。」"], 2: ["他走了", "，不回來。"], 3: ["「今天", "要走」了"], 4: ["」你好「"], 5: ["\"真的？”"], 6: ["他笑：“今天要去哪？", "他走了。"], 7: ["他笑：“今天要去哪？", "", "“明天”"],
        8: ["好啊。」他回答。"], 9: ["「他走", "了。」"], 10: ["　　----------"], 11: ["「」"], 12: ["", "，不回來。"], 13: ["說是“天”“路”"], 14: ["一眼。”你今天”"],
    }
    got = {}
    for x in fixes.plans(frame(spark, books)).collect():
        got.setdefault(x.doc_id, []).append((x.kind, x.start, x.end, x.after))
    assert {k: sorted(v) for k, v in got.items()} == {
        1: [("missing_separator", 0, 1, ["「你說什麼？」", "「走吧。」"])], 2: [("leading_punct", 0, 2, ["他走了，不回來。"])],
        3: [("unclosed", 0, 2, ["「今天要走」了"]), ("unpaired", 0, 2, ["「今天要走」了"])], 4: [("unpaired", 0, 1, ["「你好」"])], 5: [("unpaired", 0, 1, ["“真的？”"])],
        6: [("unpaired", 0, 1, ["他笑：“今天要去哪？”"])], 8: [("unpaired", 0, 1, ["「好啊。」他回答。"])],
        9: [("unclosed", 0, 2, ["「他走了。」"]), ("unpaired", 0, 2, ["「他走了。」"])], 10: [("separator_line", 0, 1, ["　　---"])], 14: [("unpaired", 0, 1, ["一眼。“你今天”"])]}


def direct(texts, plans):
    """Greedy by place, from the bottom up, without the second try."""
    taken, end = [], -1
    for p in sorted(plans, key=lambda p: (p[1], p[2], p[0], fixes.KINDS.index(p[3]))):
        if p[1] >= end:
            taken.append(p)
            end = p[2]
    out = list(texts)
    for p in reversed(taken):
        out[p[1]:p[2]] = p[4]
    return out, len(taken)


def test_applied_against_a_direct_pass(spark):
    r = random.Random(4)
    words = ["山路", "水。", "「", "」", "，", "……", "走吧。", "“", "”", "河"]
    books = {d: ["".join(r.choice(words) for _ in range(r.randrange(6))) for _ in range(30)] for d in range(20)}
    lines = frame(spark, books)
    found = fixes.plans(lines).where(~F.col("kind").isin(*fixes.LOCAL))
    plans = {}
    for x in found.collect():
        plans.setdefault(x.doc_id, []).append((x.row, x.start, x.end, x.kind, x.after))
    new, where = fixes.applied(lines, found)
    got = {}
    for x in new.orderBy("doc_id", "row").collect():
        got.setdefault(x.doc_id, []).append(x.text)
    for d, texts in books.items():
        assert got[d] == direct(texts, plans.get(d, []))[0], d
    assert where.select("doc_id", "row").distinct().count() == 600 and sum(len(p) for p in plans.values()) > 100


def test_skipped_fixes_are_done_again(spark):
    books = {1: ["他走了", "，山。。。好", "山"], 2: ["x"], 3: ["「好？」「走。。。。」"]}
    lines = frame(spark, books)
    new, where = fixes.applied(lines, fixes.plans(lines))
    got = {}
    for x in new.orderBy("doc_id", "row").collect():
        got.setdefault(x.doc_id, []).append(x.text)
    assert got == {1: ["他走了，山……好", "山"], 2: ["x"], 3: ["「好？」", "「走……」"]}
    assert sorted((x.row, x.new_row) for x in where.where("doc_id = 1").collect()) == [(0, 0), (1, 0), (2, 1)]
    none = frame(spark, {1: []})
    assert [x.count() for x in fixes.applied(none, fixes.plans(none))] == [0, 0]


def test_plans_are_made_once(spark):
    lines = frame(spark, {1: ["他說", "，好。。。。", "「走！」「吧」"]})
    found = fixes.plans(lines)
    new, where = fixes.applied(lines, found)
    # what follows reads the chosen plans and makes none again; plans spread over all cores
    assert all("lead(" not in x._jdf.queryExecution().optimizedPlan().toString() for x in (new, where))
    assert found.rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
