"""Rows of edited texts, against direct versions."""

from __future__ import annotations

import random

from bookloom.operators import lineage
from bookloom.operators.alignment import common, longest_rise


def frame(spark, books):
    return spark.createDataFrame([(d, i, t) for d, texts in books.items() for i, t in enumerate(texts)] or [(-1, 0, "x")], "doc_id long, row long, text string")


def direct(old, new):
    """The map of one text, the alignment of the middle as the library has it."""
    head = 0
    while head < min(len(old), len(new)) and old[head] == new[head]:
        head += 1
    tail = 0
    while tail < min(len(old), len(new)) - head and old[-1 - tail] == new[-1 - tail]:
        tail += 1
    to = {i: i for i in range(head)} | {len(old) - 1 - k: len(new) - 1 - k for k in range(tail)}
    a = [(i, t) for i, t in enumerate(old) if head <= i < len(old) - tail and t.strip()]
    b = [(i, t) for i, t in enumerate(new) if head <= i < len(new) - tail and t.strip()]
    la, lb = [t for _, t in a], [t for _, t in b]
    anchors = longest_rise(sorted((j, i) for i, t in enumerate(la) for j, u in enumerate(lb) if t == u and la.count(t) == lb.count(t) == 1))
    before = (-1, -1)
    for j1, i1 in [*anchors, (len(lb), len(la))]:
        j0, i0 = before
        for j, i in common(lb[j0 + 1:j1], la[i0 + 1:i1]):
            to[a[i0 + 1 + i][0]] = b[j0 + 1 + j][0]
        if i1 < len(la):
            to[a[i1][0]] = b[j1][0]
        before = (j1, i1)
    out = {}
    for i in range(len(old)):
        if i in to:
            out[i] = (to[i], "same")
            continue
        p = max((k for k in to if k < i), default=-1)
        n = min((k for k in to if k > i), default=len(old))
        q, m = to.get(p, -1), to.get(n, len(new))
        there = q + i - p
        if there < m and not any(t.strip() for t in old[p + 1:i + 1]) and not any(t.strip() for t in new[q + 1:there + 1]):
            out[i] = (there, "same")
        elif n - p == m - q:
            out[i] = (there, "replaced")
        else:
            out[i] = (q, "gone")
    return out


def edited(r, texts):
    out = list(texts)
    for _ in range(r.randrange(0, 6)):
        at = r.randrange(0, len(out) + 1)
        what = r.random()
        if what < 0.4:
            del out[at:at + r.randrange(1, 4)]
        elif what < 0.7:
            out[at:at] = [r.choice(["", "新", "新行", f"n{r.randrange(100)}"]) for _ in range(r.randrange(1, 3))]
        elif at < len(out):
            out[at] = f"改{r.randrange(100)}"
    return out


def test_changed_rows(spark):
    r = random.Random(3)
    old = {d: [r.choice(["", "", "他說", "好", f"t{r.randrange(40)}"]) for _ in range(r.randrange(1, 40))] for d in range(40)}
    new = {d: edited(r, t) for d, t in old.items()}
    new[41] = ["only new"]
    old[42] = ["only old", ""]
    got = {(x.doc_id, x.old_row): (x.new_row, x.how) for x in lineage.changed_rows(frame(spark, old), frame(spark, new)).collect()}
    want = {(d, i): v for d, t in old.items() for i, v in direct(t, new.get(d, [])).items()}
    want |= {(42, 0): (-1, "gone"), (42, 1): (-1, "gone")}
    assert got == want
    assert all(old[d][i] == new[d][j] for (d, i), (j, how) in got.items() if how == "same") and len({how for _, how in got.values()}) == 3


def test_maps_compose(spark):
    r = random.Random(4)
    a = {d: [f"t{i}" if i % 3 else "" for i in range(30)] for d in range(8)}
    b = {d: edited(r, t) for d, t in a.items()}
    c = {d: edited(r, t) for d, t in b.items()}
    one, two = lineage.changed_rows(frame(spark, a), frame(spark, b)), lineage.changed_rows(frame(spark, b), frame(spark, c))
    first, second = ({(x.doc_id, x.old_row): (x.new_row, x.how) for x in m.collect()} for m in (one, two))
    rank = ["same", "replaced", "gone"]
    got = {(x.doc_id, x.old_row): (x.new_row, x.how) for x in lineage.composed(one, two).collect()}
    want = {}
    for key, (mid, how) in first.items():
        to, then = second.get((key[0], mid), (-1, "gone"))
        want[key] = (to, max(how, then, key=rank.index))
    assert got == want
    state = spark.createDataFrame([(d, i, "x") for d in a for i in range(0, 30, 4)], "doc_id long, row long, mark string")
    kept = {(x.doc_id, x.row) for x in lineage.carried(state, one).collect()}
    assert kept == {(d, first[d, i][0]) for d in a for i in range(0, 30, 4) if first[d, i][1] != "gone"}
    assert lineage.carried(state, one, moved_on=True).count() == sum(first[d, i][0] >= 0 for d in a for i in range(0, 30, 4))


def test_chapters_and_texts(spark):
    old = {1: ["前", "第1章", "一", "二", "", "三", "第2章", "四", "五", "六", ""]}
    new = {1: ["第1章", "", "一", "", "二", "", "三", "", "第2章", "", "四五", "六"]}
    titles = spark.createDataFrame([(1, 1, 0), (1, 6, 8)], "doc_id long, old_row long, new_row long")
    rows = frame(spark, old).select("doc_id", "row")
    assert [x.new_row for x in lineage.by_chapters(rows, titles).orderBy("old_row").collect()] == [0, 0, 0, 0, 0, 0, 8, 8, 8, 8, 8]
    got = [x.new_row for x in lineage.by_texts(frame(spark, old), frame(spark, new), titles).orderBy("old_row").collect()]
    # 六 is the third line of a chapter that has two left: its last row
    assert got == [0, 0, 2, 4, 4, 6, 8, 10, 11, 11, 11]


def test_what_is_kept_of_rows_is_small(spark, monkeypatch):
    """Checkpoints aren't compressed: of a row no more is kept than the map asks for."""
    from bookloom.operators import lineage

    kept, keep = [], lineage.checkpointed
    monkeypatch.setattr(lineage, "checkpointed", lambda df: (kept.append(df), keep(df))[1])
    old = spark.createDataFrame([(1, i, t) for i, t in enumerate(["a", "", "b", "c"])], "doc_id long, row long, text string")
    new = spark.createDataFrame([(1, i, t) for i, t in enumerate(["a", "", "x", "c"])], "doc_id long, row long, text string")
    got = {tuple(x) for x in lineage.changed_rows(old, new).collect()}
    assert got == {(1, 0, 0, "same"), (1, 1, 1, "same"), (1, 2, 2, "replaced"), (1, 3, 3, "same")}
    assert len(kept) == 4 and not any("struct" in kind for df in kept for _, kind in df.dtypes)
    assert {len(x._key) for x in kept[0].collect()} == {20}
