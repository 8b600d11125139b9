from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, key string, line_no string"


@pytest.fixture(scope="session")
def words():
    return [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "tre") for b in ("n", "rst", "v") for c in ("a", "o", "ume", "ik")]


@pytest.fixture(scope="session")
def rows(words):
    """Texts with nulls, empties, copies, near copies, a hot group and a long text."""
    r = random.Random(3)

    def text(n):
        return " ".join(r.choice(words) for _ in range(n))

    base = [text(r.randrange(60, 160)) for _ in range(25)]
    out = [(i, t) for i, t in enumerate(base)]
    out += [(100 + i, base[0]) for i in range(30)]  # a third are copies of one
    out += [(200 + i, base[1] + f" tail{i}") for i in range(5)]
    out += [(300, None), (301, ""), (302, "  \n\t "), (303, "one"), (304, "one two"), (305, text(9000)), (None, base[2]), (3, base[3])]
    out += [(400, base[4] + "\n" + base[5]), (401, "Zz " + base[5])]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    """Extra columns clash with names the operators use inside."""
    return spark.createDataFrame([(i, t, "xx", "src", len(t or ""), "f", "k", "l") for i, t in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
