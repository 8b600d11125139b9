"""Wrong numbers and quote styles."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from bookloom.functions import quotes
from bookloom.operators.anomalies import number_anomalies


def direct(numbers):
    """Positions are settled from the front: a place, what it should be (None: nothing)."""
    n, at, out = len(numbers), 1, {}
    prev = numbers[0]
    if n >= 3 and numbers[2] - numbers[1] == 1 and numbers[0] - numbers[1] > 10:
        out[0], prev, at = ("stray", None), numbers[1], 2
    while at < n - 1:
        options = []
        for size in (1, 2, 3):
            run, behind = numbers[at:at + size], numbers[at + size] if at + size < n else None
            if behind is None:
                continue
            if run == list(range(run[0], run[0] + size)) and run[0] - prev not in (0, 1) and behind - prev == size + 1:
                options.append((0, size))
            if behind - prev == 1 and min(abs(x - prev) for x in run) > (1 if size == 1 else 10):
                options.append((1, size))
        if not options:
            prev, at = numbers[at], at + 1
            continue
        kind, size = min(options)
        for k in range(size):
            out[at + k] = ("stray", None) if kind else ("typo", prev + 1 + k)
        prev, at = prev if kind else prev + size, at + size
    for i in range(max(1, n - 3), n):
        before = [out[j][1] if j in out else numbers[j] for j in range(i) if out.get(j, ("", 0))[0] != "stray"]
        if i not in out and before:
            want, text = before[-1] + 1, str(numbers[i])
            if numbers[i] != want and any(text[:k] + text[k + 1:] == str(want) and len(text) == len(str(want)) + 1 for k in range(len(text))):
                out[i] = ("typo", want)
    return out


def test_anomalies_against_a_direct_pass(spark):
    r = random.Random(9)
    groups = {0: [1, 2, 225, 4], 1: [1, 2, 3899, 3900, 5, 6], 2: [5, 6, 32470, 7, 8], 3: [102, 1, 2, 3], 4: [1405, 1406, 11407], 5: [7], 6: [1, 1, 2], 7: [1, 50, 80, 2, 3], 8: [9, 10, 111, 112]}
    for g in range(10, 120):
        numbers, n = [], r.randrange(1, 5)
        for _ in range(r.randrange(1, 16)):
            n += 1
            numbers.append(n if r.random() < 0.7 else r.choice([n + 200, n * 10 + 1, n - 1, n + 1, 3, 40]))
        groups[g] = numbers
    df = spark.createDataFrame([(g, i, x) for g, some in groups.items() for i, x in enumerate(some)], "grp long, idx long, number long").repartition(3)
    got = {}
    for x in number_anomalies(df, ["grp"]).collect():
        got.setdefault(x.grp, {})[x.idx] = (x.kind, x.guess)
    for g, numbers in groups.items():
        assert got.get(g, {}) == direct(numbers), (g, numbers)
    assert got[1] == {2: ("typo", 3), 3: ("typo", 4)} and got[2] == {2: ("stray", None)} and got[4] == {2: ("typo", 1407)}


def test_quote_styles(spark):
    cases = {
        "“甲‘乙’丙”": "「甲『乙』丙」", "don't go": "don't go", "他說“don’t走”": "他說「don’t走」", "他說“走吧“好”嗎”": "他說「走吧『好』嗎」", "\"甲\"和\"go\"": "「甲」和\"go\"",
        "'甲'乙": "「甲」乙", "“甲'乙'丙”": "「甲『乙』丙」", "甲”乙": "甲」乙", "\"甲": "\"甲", "「甲」": "「甲」", "“hello”": "“hello”", "": "", "甲‘乙": "甲『乙",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", quotes.in_style(F.col("t"), "corner").alias("q"), quotes.in_style(quotes.in_style(F.col("t"), "corner"), "curly").alias("back")).collect()
    assert {x.t: x.q for x in rows} == cases
    assert {x.t: x.back for x in rows}["“甲‘乙’丙”"] == "“甲‘乙’丙”"
