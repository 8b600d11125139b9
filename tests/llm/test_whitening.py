from __future__ import annotations

import math
import random

import numpy as np
import pytest

from bookloom.llm import qdwh_whitening as w

SCHEMA = "vec_id long, embedding array<float>, x string, n int, component string"


@pytest.mark.parametrize("spectrum", [
    np.linspace(9, 1, 40), np.logspace(0, -14, 30), np.repeat([3.0, 1.0], 12), np.r_[np.ones(5), np.zeros(9)],
    np.r_[100, np.linspace(1e-3, 1e-4, 20)], np.zeros(6), np.r_[5, 5 + 1e-9, np.linspace(1, 0, 20)], np.array([2.0])])
def test_eigen(spectrum):
    n = len(spectrum)
    q = np.linalg.qr(np.random.default_rng(n).standard_normal((n, n)))[0]
    a = (q * spectrum) @ q.T
    a = (a + a.T) / 2
    for most in (n, 16):
        values, vectors = w.eigen(a, most)
        size = max(np.linalg.norm(a), 1e-300)
        assert len(values) == min(n, most)
        assert np.abs(values - np.sort(spectrum)[::-1][:most]).max() <= 1e-13 * size
        assert np.abs(a @ vectors - vectors * values).max() <= 1e-13 * size
        assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() <= 1e-12


def test_polar():
    a = np.random.default_rng(1).standard_normal((20, 20))
    a = a + a.T
    values, vectors = np.linalg.eigh(a)
    assert np.abs(w.polar(a) - (vectors * np.sign(values)) @ vectors.T).max() < 1e-12


def test_merged_moments():
    x = np.random.default_rng(2).integers(0, 50, (300, 5)) + 10**9
    found = w.Moments(0, [], np.zeros(0))
    for i in range(0, 300, 7):
        found.merge(w.block_moments(x[i:i + 7], True))
    assert found.n == 300 and found.total == [int(v) for v in x.sum(axis=0)]
    assert np.allclose(found.second / 300, np.cov(x.T, bias=True), rtol=1e-12, atol=1e-10)


def brute(rows, most):
    good = [(i, v) for i, v in rows if v and not any(c is None or not math.isfinite(c) for c in v)]
    x = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in good]
    fit = sorted({tuple(v) for _, v in x})
    n, total = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[(n * c - s) / n for c, s in zip(v, total, strict=True)] for v in fit])
    v = centred.T @ centred / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    out = []
    for i, row in x:
        deviation = sum((n * c - s) ** 2 for c, s in zip(row, total, strict=True))
        white = np.array([(n * c - s) / n for c, s in zip(row, total, strict=True)]) @ vectors / np.sqrt(values)
        out += [(i, k + 1, n, deviation, white[k], values[k] / np.trace(v)) for k in range(len(values))]
    return out


def test_against_brute_force(spark):
    r = random.Random(5)
    rows = [(i, [r.gauss(0, 1 + j) for j in range(20)]) for i in range(150)]
    rows += [(1000 + i, rows[0][1]) for i in range(80)]  # a third of all rows is one vector
    rows += [(None, rows[1][1]), (3, rows[2][1]), (2000, None), (2001, [1.0] * 19 + [None]), (2002, [float("nan")] * 20), (2003, [float("inf")] * 20), (2004, [])]
    df = spark.createDataFrame([(i, v, "a", 1, "b") for i, v in rows], SCHEMA).repartition(5)
    got = [tuple(x) for x in w.whitened(df).collect()]
    want = brute(rows, 16)
    assert len(got) == len(want) == 232 * 16
    order = lambda x: (x[0] is None, x[0] or 0, x[1], abs(x[4]))
    got, want = sorted(got, key=order), sorted(want, key=order)
    signs = {}
    for g, b in zip(got, want, strict=True):
        assert g[:4] == b[:4]
        assert abs(abs(g[4]) - abs(b[4])) < 1e-9
        assert abs(g[5] - b[5]) < 1e-12
        assert g[6] < 1e-9
        if abs(b[4]) > 1e-6:
            signs.setdefault(g[1], set()).add(np.sign(g[4] * b[4]))
    assert all(len(s) == 1 for s in signs.values())


def test_edges(spark, no_docs):
    make = lambda rows: spark.createDataFrame([(i, v, "a", 1, "b") for i, v in rows], SCHEMA)
    assert w.whitened(make([])).count() == 0
    assert w.whitened(make([(1, [1.0, 2.0])] * 3)).count() == 0  # one distinct vector: nothing to whiten
    two = w.whitened(make([(1, [1.0, 2.0]), (2, [2.0, 2.0]), (3, [9.0])])).collect()
    assert sorted((x.vec_id, x.component, x.n, x.deviation, round(abs(x.whitened), 9), x.explained) for x in two) == [(1, 1, 2, 64 * 64, 1.0, 1.0), (2, 1, 2, 64 * 64, 1.0, 1.0)]


def test_deviation_beyond_a_long():
    x = np.array([[0, 0], [1 << 40, 5]], np.int64)
    model = w.Whitening(1 << 30, [0, 0], np.ones(1), np.ones((2, 1)), 1.0)
    assert model.deviations(x) == [0, None]
    assert model.deviations(x[:1] + 1) == [1 << 61]
