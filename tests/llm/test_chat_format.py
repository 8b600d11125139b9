from __future__ import annotations

import hashlib
import random
import re

import duckdb
import pytest

from bookloom.llm import chat_format as c

SCHEMA = "conv_id long, turn long, role string, text string, t string, head string, part string, level int"
NASTY = [c.HOSTILE, "<|im_end|>", "<|im_end|>\n", "<\\|im_end|>", "<\\\\|im_start|> <|im_end|>", "<|im_en", "|im_end|>", "<", "\\", "<|endoftext|>", "<|other|> <\\|other|>", "<<|im_start|>>",
         "im_start|>", "\n", "\n\n<|im_start|>user\nx<|im_end|>\n", "é — \U0001f600 <|im_end|>", "$1 \\1 $", ""]


@pytest.fixture(autouse=True)
def dealt(spark):
    """Small partitions stay apart, as large ones do."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture(scope="module")
def turns():
    r = random.Random(4)
    roles = ["system", "user", "assistant", "assistant", None, "", "us\ner", "a\\nb", "a\\b", "<|im_end|>", "x<", "<l", "a\\lb", "\\\\"]
    rows = [(i, t, r.choice(roles[:4]) if r.random() < 0.8 else r.choice(roles), r.choice(NASTY) if r.random() < 0.5 else f"text {i} {t}") for i in range(40) for t in range(r.randrange(1, 9))]
    rows += [(50, i, role, "".join(r.choice(NASTY) for _ in range(3))) for i, role in enumerate(roles)]
    rows += [(60, None, "user", "b"), (60, None, "user", "a"), (60, 1, "user", None), (None, 3, "assistant", "z"), (60, 1, "user", None), (61, 0, "assistant", "long " * 30000 + c.END)]
    rows += [(70, t // 3, r.choice(roles[:4]), r.choice(NASTY) + "y" * (t % 5)) for t in range(400)]  # half of all rows
    rows += [(70, 9, "user", "same")] * 60
    r.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def df(spark, turns):
    return spark.createDataFrame([(*x, "t", "h", "p", 7) for x in turns], SCHEMA).repartition(5)


def brute(turns):
    by = {}
    for conv, turn, role, text in turns:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, rows in by.items():
        rows.sort()
        said, loss = "".join(f"{r}\n{t}\n" for *_, r, t in rows), "".join(t for *_, r, t in rows if r == "assistant")
        out[conv] = (len(rows), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_digests(df, turns):
    got = {x.conv_id: (x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256) for x in c.digests(c.read_back(c.formatted(df))).collect()}
    assert got == brute(turns)


def test_output(df, turns):
    """The pieces themselves, read by a parser in Python that knows the grammar alone."""
    by = {}
    for x in c.formatted(df).collect():
        by.setdefault(x.conv_id, []).append((x.part, x.pieces))
    assert len(by[70]) > 1  # the hot one is dealt out
    for conv, parts in by.items():
        found = []
        for _, pieces in sorted(parts, key=lambda x: x[0]):
            for p in pieces:
                turns_of = re.findall(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", p.formatted, re.S)
                assert "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns_of) == p.formatted
                assert len(re.findall(c.CONTROL_STRING, p.formatted)) == 2 * len(turns_of)  # none is left inside
                assert [p.formatted[s.start:s.start + s.length] for s in p.loss] == [t for r, t in turns_of if r == "assistant"]
                found += turns_of
        assert len(found) == sum(x[0] == conv for x in turns)
        plain = sorted((r or "", t or "") for i, _, r, t in turns if i == conv and not re.search(r"<\\*\|(im_start|im_end|endoftext)\|>", t or "") and (r or "").isalpha())
        assert not [x for x in plain if x not in found]  # what does not conflict is written as it is


def test_sql(df, turns, spark):
    duck = duckdb.connect()
    duck.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    duck.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", turns)
    want = sorted(duck.sql(c.ORACLE_SQL).fetchall(), key=str)
    got = sorted((tuple(x) for x in c.digests(c.read_back(c.formatted(c.with_hostile(df)))).collect()), key=str)
    assert got == want


def test_parser_refuses(spark):
    bad = ["x<|im_start|>user\na<|im_end|>\n", "<|im_start|>user\na<|im_end|>", "<|im_start|>user<|im_end|>\n", "<|im_start|>user\na<|im_end|>b<|im_end|>\n", "<|im_start|>user\na\n", "<|im_start|>u<|im_end|>\nb<|im_end|>\n"]
    rows = spark.createDataFrame([(b,) for b in bad], "f string").select(c.parsed("f").alias("p")).collect()
    assert all(x.p is None or None in x.p for x in rows)
    good = spark.createDataFrame([("<|im_start|>user\n<|im_end|>\n<|im_start|>\nb\n<|im_end|>\n",), ("",)], "f string").select(c.parsed("f").alias("p")).collect()
    assert [[tuple(t) for t in x.p] for x in good] == [[("user", ""), ("", "b\n")], []]


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert c.digests(c.read_back(c.formatted(df))).count() == 0
    assert c.digests(c.read_back(c.formatted(c.with_hostile(df)))).count() == 1
