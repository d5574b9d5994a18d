"""Whitening: its solver against matrices with known vectors, and its rows against a plain version."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from strataq.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int, x string, n long, component string"
WIDE = np.longdouble


def orthogonal(d, seed):
    q = np.random.default_rng(seed).normal(size=(d, d)).astype(WIDE)
    for _ in range(3):
        for i in range(d):
            for j in range(i):
                q[:, i] -= q[:, j] * (q[:, j] @ q[:, i])
            q[:, i] /= np.sqrt(q[:, i] @ q[:, i])
    return q


@pytest.mark.parametrize("values", [
    [*range(1, 41)], [1, 1 + 1e-9, 1 + 2e-9, 2, 3, 3 + 1e-12, 5, 0.1], [1, 1, 1, 2, 3, 3 + 1e-13, 5, 0], [1 + 1e-7 * i for i in range(30)], [1] * 6, [1e-9, 1, 1e9],
])
def test_refined_vectors(values):
    q, v = orthogonal(len(values), 7), np.array(values, WIDE)
    a = (q * v) @ q.T
    rough = np.linalg.eigh(a.astype(np.float32))[1]
    e, x = W.refine(a, rough)
    order = np.argsort(-e)
    e, x = e[order], x[:, order]
    top = float(np.abs(v).max())
    assert np.abs(x.T @ x - np.eye(len(v))).max() < 1e-17
    assert np.abs(a @ x - x * e).max() < 1e-17 * top
    assert np.abs(e - np.sort(v)[::-1]).max() < 1e-17 * top
    assert np.abs(a @ rough - rough * np.diag(rough.T @ a @ rough)).max() > 1e-10 * top or len(set(values)) == 1  # what float32 gave was not enough


def test_doubles_are_no_better(spark):
    """To double precision: against the library's solver in double, on well parted eigenvalues."""
    q = orthogonal(24, 3)
    a = np.array((q * np.arange(1, 25, dtype=WIDE)) @ q.T, np.float64)
    e, x = W.eigen(a)
    assert np.allclose(e, np.arange(24, 0, -1), rtol=1e-14)
    assert max(min(np.abs(x[:, i] - q[:, 23 - i]).max(), np.abs(x[:, i] + q[:, 23 - i]).max()) for i in range(24)) < 1e-14
    assert W.eigen(np.zeros((3, 3)))[0].tolist() == [0, 0, 0] and W.eigen(np.zeros((0, 0)))[0].size == 0


def vectors():
    r = random.Random(11)
    out = [[r.gauss(0.2, 0.4) + (r.gauss(0, 2) if k < 2 else 0) for k in range(5)] for _ in range(90)]
    out += out[:20] + [[out[0][0] + 0.001, *out[0][1:]]] * 30
    return out


def plain(rows, top):
    """By exact fractions, then numpy's solver."""
    ok = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows if v is not None and len(v) == 5 and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in ok})
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    cov = np.array([[float(sum(Fraction(n * x[i] - s[i]) * (n * x[j] - s[j]) for x in fit) / n**3) for j in range(5)] for i in range(5)])
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1][:top], v[:, ::-1][:, :top]
    out = []
    for i, x in ok:
        c = np.array([float(Fraction(n * a - b, n)) for a, b in zip(x, s)])
        for k in range(top):
            out.append((i, k + 1, n, sum((n * a - b) ** 2 for a, b in zip(x, s)), c @ v[:, k] / math.sqrt(e[k]), e[k] / np.trace(cov)))
    return out


def test_whitening(spark):
    rows = list(enumerate(vectors())) + [(None, vectors()[3]), (3, vectors()[4]), (900, None), (901, [1.0, None, 0.0, 0.0, 0.0]), (902, [1.0, float("nan"), 0.0, 0.0, 0.0]), (903, [float("inf")] * 5), (904, [1.0] * 4), (905, [])]
    df = spark.createDataFrame([(i, v, 0, "x", 1, "c") for i, v in rows], SCHEMA)
    for top in (3, 16):
        got = W.embedding_whitening(df, components=top).collect()
        want = plain(rows, min(top, 5))
        key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3])
        got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
        assert [g[:4] for g in got] == [w[:4] for w in want]
        signs = {k: np.sign(sum(g[4] * w[4] for g, w in zip(got, want) if g[1] == k)) for k in range(1, 6)}
        assert max(abs(g[4] * signs[g[1]] - w[4]) for g, w in zip(got, want)) < 1e-9
        assert max(abs(g[5] / w[5] - 1) for g, w in zip(got, want)) < 1e-9
        assert len({g[6] for g in got}) == 1 and got[0][6] < 1e-12
    dense = W.dense(W.embedding_whitening(df.where("vec_id < 50"), components=3)).first()
    assert len(dense.whitened) == 3


def test_hot_vectors_count_once(spark):
    v = vectors()
    once = spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<float>")
    hot = once.unionByName(spark.range(3000).selectExpr("id + 1000 AS vec_id", f"CAST(array({','.join(map(str, v[0]))}) AS array<float>) AS embedding"))
    a = {(r.vec_id, r.component): r.whitened for r in W.embedding_whitening(once).collect()}
    out = W.embedding_whitening(hot).collect()
    assert len(out) == 5 * (len(v) + 3000)
    assert all(abs(r.whitened - a[(r.vec_id, r.component)]) < 1e-9 for r in out if r.vec_id < 1000)


def test_ranks_and_empty_tables(spark):
    two = "vec_id long, embedding array<double>"
    assert W.embedding_whitening(spark.createDataFrame([], two)).count() == 0
    assert W.embedding_whitening(spark.createDataFrame([(1, None), (2, [float("nan")]), (3, [])], two)).count() == 0
    assert W.embedding_whitening(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], two)).count() == 0  # one vector: nothing varies
    flat = W.embedding_whitening(spark.createDataFrame([(i, [float(i), 7.0, 2.0 * i]) for i in range(9)], two)).collect()
    assert {r.component for r in flat} == {1} and abs(flat[0].explained - 1) < 1e-12
    far = W.embedding_whitening(spark.createDataFrame([(i, [float(i) * 1e12, 1.0 * (i % 3)]) for i in range(9)] + [(9, [1e300, 0.0])], two)).collect()
    assert {r.vec_id for r in far} == set(range(9)) and far[0].deviation is None  # exact, but beyond a long
