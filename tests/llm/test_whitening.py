"""Whitening against numpy and exact integers."""

import math
import random

import numpy as np
import pytest

from fieldloom.llm import whitening

COLUMNS = "vec_id long, embedding array<float>, x int, n string, component string, k int"


def table(spark, rows):
    """Vectors with columns whose names the operator uses inside."""
    return spark.createDataFrame([(i, v, 1, "n", "c", 2) for i, v in rows], COLUMNS)


def vectors(n=300, d=8):
    r = np.random.default_rng(5)
    rows = [(k, (r.normal(size=d) * np.linspace(1, 3, d) + 0.3).astype(np.float32).tolist()) for k in range(n)]
    rows += [(n + k, rows[0][1]) for k in range(n // 2)] + [(None, rows[1][1]), (2**60 + 1, rows[2][1]), (2**60 + 1, rows[2][1])]
    return rows


def plain(rows):
    """The contract with Python integers and numpy, by (vec_id, component)."""
    xs = [(i, tuple(math.floor(256 * float(c)) for c in v)) for i, v in rows]
    listed = sorted({x for _, x in xs})
    n, d = len(listed), len(listed[0])
    s = [sum(x[k] for x in listed) for k in range(d)]
    y = np.array([[n * x[k] - s[k] for k in range(d)] for x in listed], object)
    c = (y / n).astype(float)
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    out = []
    for i, x in xs:
        row = [n * x[k] - s[k] for k in range(d)]
        w = (np.array(row, object) / n).astype(float) @ u[:, :4] / np.sqrt(e[:4])
        out += [(i, k + 1, n, sum(a * a for a in row), w[k], e[k] / e.sum()) for k in range(min(4, d))]
    return out


def test_whitened_equals_numpy(spark):
    rows = vectors()
    bad = [(9001, None), (9002, [1.0, None] + [0.0] * 6), (9003, [float("nan")] + [0.0] * 7), (9004, [float("inf")] + [0.0] * 7), (9005, [1.0]), (9006, [])]
    got = whitening.whitened(table(spark, rows + bad).repartition(5)).collect()
    want = plain(rows)
    assert len(got) == len(want)
    assert sorted((str(r.vec_id), r.component, r.n, r.deviation) for r in got) == sorted((str(w[0]), *w[1:4]) for w in want)
    exact = {(w[0], w[1]): w for w in want}
    for k in range(1, 5):
        mine = [r for r in got if r.component == k]
        sign = np.sign(sum(r.whitened * exact[r.vec_id, k][4] for r in mine))
        assert all(abs(sign * r.whitened - exact[r.vec_id, k][4]) < 1e-9 and abs(r.explained - exact[r.vec_id, k][5]) < 1e-12 for r in mine)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


@pytest.mark.parametrize("rows", [[(1, [0.5, 0.25])], [(1, [0.5]), (2, [0.25]), (None, [0.5])], [(k, [1.0, 2.0, 3.0]) for k in range(9)]])
def test_components_without_variance(spark, rows):
    got = whitening.whitened(table(spark, rows)).collect()
    d = len(rows[0][1])
    assert len(got) == len(rows) * min(4, d)
    varies = len({tuple(v) for _, v in rows}) > 1
    assert all((r.whitened is not None) == varies and (r.identity_error is not None) == varies and (r.explained is not None) == varies for r in got)


def test_empty_tables(spark):
    a, b = whitening.whitened(table(spark, [])), whitening.whitened(table(spark, [(1, None), (2, [])]))
    full = whitening.whitened(table(spark, [(1, [0.5, 0.25])]))
    assert a.count() == b.count() == 0 and a.dtypes == b.dtypes == full.dtypes


def test_values_that_overflow_longs(spark):
    r = random.Random(2)
    rows = [(k, [r.uniform(-1, 1) * 3e13 for _ in range(3)]) for k in range(40)]
    got = {(x.vec_id, x.component): x for x in whitening.whitened(table(spark, rows)).collect()}
    for i, k, n, dev, w, share in plain([(i, np.array(v, np.float32).tolist()) for i, v in rows]):
        x = got[i, k]
        assert x.n == n and x.deviation == (dev if dev < 2**63 else None) and abs(abs(x.whitened) - abs(w)) < 1e-6 and abs(x.explained - share) < 1e-9


def test_exact_sums_of_squares():
    big = np.array([[2**40, 1], [3, 4]])
    assert whitening.deviations(big) == [None, 25]
    m = whitening.Whitening(2**40, np.array([5, 7], object))
    assert m.centred(np.array([[2**30, 0]])).tolist() == [[2**70 - 5, -7]]
