"""Alignment of versions and volumes that a book does not write."""

from __future__ import annotations

import random

from bookloom.operators import alignment, contents, editing, numbering, volumes

ROWS = "doc_id long, idx long, key string, loose string"


def lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_common_subsequence():
    r = random.Random(1)
    for _ in range(300):
        a, b = ([r.choice("abcd") for _ in range(r.randrange(9))] for _ in range(2))
        got = alignment.common(a, b)
        assert len(got) == lcs(a, b) and all(a[i] == b[j] for i, j in got)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:], strict=False))


def direct(old, new):
    """Anchors, then the common subsequence of each gap, then loose keys: over whole lists."""
    keys = lambda rows: [k for k, _ in rows]
    only = lambda rows: {k for k in keys(rows) if k is not None and keys(rows).count(k) == 1}
    both = only(old) & only(new)
    anchors = alignment.longest_rise([(i, keys(old).index(k)) for i, k in enumerate(keys(new)) if k in both])
    out, before = [(i, j, "same") for i, j in anchors], (-1, -1)
    for i1, j1 in [*anchors, (len(new), len(old))]:
        i0, j0 = before[0] + 1, before[1] + 1
        part = [(k if k is not None else ("n", i), x) for i, (k, x) in enumerate(new[i0:i1])], [(k if k is not None else ("o", i), x) for i, (k, x) in enumerate(old[j0:j1])]
        out += [(i0 + i, j0 + j, how) for i, j, how in alignment.paired(*part)]
        before = (i1, j1)
    return sorted(out)


def test_aligned(spark):
    r = random.Random(2)
    books = {}
    for doc in range(15):
        names = [f"k{r.randrange(25)}" for _ in range(14)]
        old = [(n if r.random() < 0.95 else None, n[1:2] if r.random() < 0.9 else None) for n in names]
        new = [x for x in old if r.random() < 0.8]
        for _ in range(3):
            new.insert(r.randrange(len(new) + 1), (f"n{r.randrange(99)}", str(r.randrange(3))))
        if doc % 3 == 0 and len(new) > 4:
            new[1], new[3] = new[3], new[1]
        books[doc] = old, new
    books[50], books[51] = ([], [("a", "b")]), ([("a", "b")], [])
    frame = lambda side: spark.createDataFrame([(d, i, k, x) for d, b in books.items() for i, (k, x) in enumerate(b[side])], ROWS).repartition(2)
    got = {}
    for x in alignment.aligned(frame(0), frame(1)).collect():
        got.setdefault(x.doc_id, []).append((x.new_idx, x.old_idx, x.how))
    for doc, (old, new) in books.items():
        assert sorted(got.get(doc, [])) == direct(old, new), doc
    none = spark.createDataFrame([], ROWS)
    assert alignment.aligned(none, none).count() == 0


def test_renamed_and_moved(spark):
    old = [(1, i, k, x) for i, (k, x) in enumerate([("1 山", "1"), ("2 水", "2"), ("3 河", "3"), ("4 橋", "4")])]
    new = [(1, i, k, x) for i, (k, x) in enumerate([("0 序", None), ("1 山", "1"), ("2 江", "2"), ("4 橋", "4"), ("3 河", "3"), ("5 路", "5")])]
    pairs = alignment.aligned(spark.createDataFrame(old, ROWS), spark.createDataFrame(new, ROWS))
    assert {(x.new_idx, x.old_idx, x.how) for x in pairs.collect()} in ({(1, 0, "same"), (2, 1, "loose"), (3, 3, "same")}, {(1, 0, "same"), (2, 1, "loose"), (4, 2, "same")})
    han = lambda rows, n: spark.createDataFrame([(d, i, n + 700 * (i == 2)) for d, i, _, _ in rows], "doc_id long, idx long, n_han long")
    got = {x.new_idx: (x.body_idx, x.position, x.status, x.suggested) for x in alignment.plan(han(old, 900), han(new, 1000), pairs).collect()}
    assert got[0] == (None, None, "missing", True) and got[1] == (0, 0, "same", False) and got[2] == (1, 1, "longer", True) and got[5][2:] == ("new", True)


BOOKS = {
    # only end marks; the second volume's end is not written; the count begins again
    "ends": (["簡介", "第1章 山", "第2章 水", "第1章 河", "第3章 橋", "第二卷終", "第1章 路", "第2章 燈", "後記"],
             [(1, 1, "卷", "第一卷", "restart"), (3, 2, "卷", "第二卷", "restart"), (6, 3, "卷", "第三卷", "restart")], [(1, 1), (2, 1), (3, 2), (4, 2), (6, 3), (7, 3)]),
    "in front of one that is written": (["第1章 山", "第2章 水", "第3部 河", "第1章 橋"], [(0, 2, "部", "第2部", "restart")], [(0, 2), (1, 2)]),
    "inside one, up to the end mark of a later one": (["第一卷 山", "第1章 水", "第2章 河", "第1章 橋", "第2章 路", "第二卷 燈火 完"], [(3, 2, "卷", "第二卷 燈火", "restart")], [(3, 2), (4, 2)]),
    "no evidence": (["第1章 山", "第2章 水", "第1章 河"], [], []),
    "no titles": (["x"], [], []),
    "prefix": (["卷一 山路 第1章 山", "卷一 山路 第2章 水", "卷二 城 第1章 河", "後記"], [(0, 1, "卷", "第一卷", "prefix"), (2, 2, "卷", "第二卷", "prefix")], [(0, 1), (1, 1), (2, 2)]),
    "dash": (["第一季 山", "1-1 水", "1-2 河", "2-1 橋", "2-2 路", "3-1 燈"], [(3, 2, "季", "第二季", "dash"), (5, 3, "季", "第三季", "dash")], [(3, 2), (4, 2), (5, 3)]),
}


def test_volumes(spark):
    from bookloom.functions import rules

    dashes = tuple(r for r in rules.PRESETS if r.name == "volume_dash_chapter")
    lines = spark.createDataFrame([(d, i, t) for d, (texts, _, _) in enumerate(BOOKS.values()) for i, t in enumerate(texts)], "doc_id long, row long, text string")
    shown, members = volumes.inferred(contents.with_parents(contents.titles(lines, dashes), lines), lines)
    shown, members = shown.collect(), members.collect()
    for d, (name, (_, volumes_, rows)) in enumerate(BOOKS.items()):
        assert sorted(tuple(x)[1:] for x in shown if x.doc_id == d) == volumes_, name
        assert sorted((x.row, x.number) for x in members if x.doc_id == d) == rows, name


def direct_choices(texts, groups):
    """groups: lists of (row, end, n_chars, keep)."""
    gone, new = set(), {}
    for members in groups:
        keeps = [k for *_, k in members]
        if all(keeps) or not any(keeps):
            continue
        if min(n for _, _, n, _ in members) >= 100:
            gone |= {i for a, b, _, k in members if not k for i in range(a, b)}
            continue
        first, kept = members[0][0], next(a for a, _, _, k in members if k)
        title = texts[kept]
        mark = next((texts[a][texts[a].index("[::"):] for a, *_ in members if "[::" in texts[a] and "X" not in texts[a]), "")
        new[first] = title if "[::" in title and "X" not in title else title + mark
        gone |= {a for a, _, _, k in members if (not k or a == kept) and a != first}
    out, cut = [], False
    for i, t in enumerate(texts):
        if i in gone:
            cut = True
            continue
        t = new.get(i, t)
        if not (cut and not t and out and not texts[out[-1][0]]):
            out.append((i, t))
        cut = False
    return out


def test_choices(spark):
    r = random.Random(11)
    books, members, groups = {}, [], {}
    for d in range(25):
        texts, groups[d] = [""] * r.randrange(2), []
        for g in range(4):
            group = []
            for _ in range(r.randrange(1, 4)):
                row = len(texts)
                texts += [f"第{g}章" + r.choice(["", "", "[::]", "[::T]", "[::X]"])] + r.choice([[], [""], ["文", ""], ["", "文"], ["", "文", ""]])
                group.append((row, len(texts), r.choice([20, 200, 300]), r.random() < 0.5))
            groups[d].append(group)
            members += [(d, g, *m) for m in group]
        books[d] = texts
    lines = spark.createDataFrame([(d, i, t) for d, texts in books.items() for i, t in enumerate(texts)], "doc_id long, row long, text string")
    got = editing.with_choices(lines, spark.createDataFrame(members, "doc_id long, group_id long, row long, end long, n_chars long, keep boolean")).collect()
    for d, texts in books.items():
        assert [(x.src_row, x.text) for x in sorted((x for x in got if x.doc_id == d), key=lambda x: x.row)] == direct_choices(texts, groups[d]), d


def test_groups_share_calls(spark):
    """Many small groups in a batch and groups over several batches, as by a direct pass."""
    rng = random.Random(8)
    rows = [(g, i, rng.randint(0, 30) if g else i) for g in range(40) for i in range(25 if g % 9 == 0 else rng.randint(1, 4))]
    numbers = spark.createDataFrame(rows, "grp long, idx long, number long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        out = numbering.misplaced(numbers, ["grp"])
        got = sorted(map(tuple, out.collect()))
        old = spark.createDataFrame([(g, i, f"k{i % 6}", None) for g, i, _ in rows], ROWS)
        pairs = alignment.aligned(old, old)
        met = {(x.doc_id, x.new_idx, x.old_idx) for x in pairs.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for g in range(40):
        mine = [x for x in rows if x[0] == g]
        kept = set(numbering.longest_increasing([n for _, _, n in mine]))
        want += [x for i, x in enumerate(mine) if i not in kept] if 2 * len(kept) >= len(mine) else []
    assert got == sorted(want)
    assert met == {(g, i, i) for g, i, _ in rows}
    # no call of Python for each group
    assert not any("FlatMap" in x._jdf.queryExecution().executedPlan().toString() for x in (out, pairs))
