"""What forums leave in books, against a direct version."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from bookloom.operators import forum

MEMBERS = ["帖子", "UID", "3062 枚", "2018-01-24", "Rank: 6", "2071", "某人 金币 +100 感谢", "TOP 放入宝箱", "12.5 小时", "LEVEL 7"]
OTHERS = ["", "　", "小明", "一個名字", "他走了過去，看著遠方的山，什麼也沒有說出口。", "第3章 名", "帖子很多"]
STRONG = {"帖子", "UID", "Rank: 6", "某人 金币 +100 感谢", "TOP 放入宝箱", "LEVEL 7"}


def power(text):
    t = text.strip()
    return 2 if t in STRONG else 1 if re.fullmatch(r"\d+(\.\d+)?( (枚|小时))?|\d{4}-\d\d-\d\d", t) else 0


def direct_profiles(texts, titles):
    rows = [(i, 0 if i in titles and power(t) == 2 else power(t), t.strip()) for i, t in enumerate(texts) if t.strip()]
    out, run, between = [], [], []
    for i, p, t in [*rows, (len(texts), 0, "x" * 99)]:
        if p:
            if run and (len(between) > 3 or any(len(b) > 16 or j in titles for j, b in between)):
                out.append(run)
                run = []
            run.append((i, p))
            between = []
        else:
            between.append((i, t))
    out.append(run)
    return {(r[0][0], r[-1][0], len(r), sum(p == 2 for _, p in r)) for r in out if len(r) >= 6 and sum(p == 2 for _, p in r) >= 2}


def frame(spark, books):
    return spark.createDataFrame([(d, i, t) for d, texts in books.items() for i, t in enumerate(texts)], "doc_id long, row long, text string")


def rows_of(spark, titles):
    return spark.createDataFrame([(d, i) for d, rows in titles.items() for i in rows] or [(-1, -1)], "doc_id long, row long")


def test_profile_blocks(spark):
    r = random.Random(5)
    books = {d: [r.choice(MEMBERS) if r.random() < 0.75 else r.choice(OTHERS) for _ in range(80)] for d in range(12)}
    titles = {d: {i for i, t in enumerate(texts) if t.startswith("第") or (t == "UID" and r.random() < 0.3)} for d, texts in books.items()}
    got = {(x.doc_id, x.start, x.end, x.n, x.n_strong) for x in forum.profile_blocks(frame(spark, books), rows_of(spark, titles)).collect()}
    want = {(d, *b) for d, texts in books.items() for b in direct_profiles(texts, titles[d])}
    assert got == want and len(want) > 10


def test_strength(spark):
    wide = "勋章" * 3 + "x" * 90
    told = {"帖子": 2, "帖子很多": 0, "level 7": 2, "12 枚": 1, "12枚枚": 0, "2018-01-24 23:49": 1, wide: 2, "勋章" * 2 + "x" * 90: 0, wide + "x" * 1000: 0, "": 0, " 版主 ": 2, "版主說": 0}
    rows = spark.createDataFrame([*told.items(), (None, 0)], "text string, want int")
    assert rows.where(forum.strength(F.col("text")) != F.col("want")).count() == 0


HEAD = "甲乙 2018-01-24 23:49:45 舉報 閱讀數：24116"
AROUND = ["", "書名 續", "書名 續章330", "他走了。", "甲乙說：好", "大家好，我是作者", "??", "??正文開始", "第3章 名", "求月票，求打賞", "今天先更這本", HEAD, "（包月10）"]


def direct_header(texts, i, titles):
    at = lambda k: texts[k].strip() if 0 <= k < len(texts) else None
    start = end = i
    above = at(i - 1)
    if above and len(above) <= 40 and above[-1] not in "。！？!?…」』”" and i - 1 not in titles and not re.search("[0-9]", above):
        start = i - 1
    for k in (i + 1, i + 2):
        t = at(k)
        if t == "":
            continue
        if t is None or k in titles or len(t) > 60 or not ("甲乙" in t or t.startswith("大家好") or not t.strip("?")):
            break
        end = k
    return start, end


def direct_note(texts, end, titles):
    near = lambda k: next((j for j in range(k + 1, min(len(texts), k + 4)) if texts[j].strip()), None)
    row = near(end)
    if row is None or row in titles or texts[row][0] in "“「『\"‘?" or len(texts[row]) > 80:
        return None
    after = near(row)
    words = {"求月票，求打賞": 2, "今天先更這本": 0, "大家好，我是作者": 1}.get(texts[row], 0)
    if after is not None and texts[after].startswith("?"):
        return row, "high" if words else "medium"
    return (row, "medium") if words >= 2 else None


def test_headers_and_notes(spark):
    r = random.Random(7)
    books = {d: [HEAD if r.random() < 0.2 else r.choice(AROUND) for _ in range(40)] for d in range(30)}
    titles = {d: {i for i, t in enumerate(texts) if t.startswith("第")} for d, texts in books.items()}
    lines, heads = frame(spark, books), rows_of(spark, titles)
    blocks = forum.header_blocks(lines, heads)
    want = {(d, i, *direct_header(texts, i, titles[d])) for d, texts in books.items() for i, t in enumerate(texts) if t == HEAD}
    assert {tuple(x) for x in blocks.collect()} == want and len({(s - i, e - i) for _, i, s, e in want}) >= 5
    notes = {tuple(x) for x in forum.post_notes(lines, blocks, heads).collect()}
    assert notes == {(d, *n) for d, _, _, e in want if (n := direct_note(books[d], e, titles[d]))} and {c for _, _, c in notes} == {"high", "medium"}


def test_nothing_to_find(spark):
    lines = spark.createDataFrame([(1, 0, None), (1, 1, "")], "doc_id long, row long, text string")
    heads = rows_of(spark, {})
    for found in (forum.header_blocks(lines, heads), forum.profile_blocks(lines, heads), forum.profile_blocks(lines.where("false"), heads)):
        assert found.count() == 0
