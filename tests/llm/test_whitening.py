"""Whitening: the spectral division against another solver, exact sums, and the query against plain code."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest

from medtab.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<double>, x string, n int, dim int"


def spectrum(values, seed=2):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))
    return (q * values) @ q.T


CASES = {
    "random": np.cov(np.random.default_rng(1).normal(size=(200, 48)).T), "singular": np.cov(np.random.default_rng(1).normal(size=(5, 20)).T), "equal": np.eye(9), "zero": np.zeros((5, 5)), "diagonal": np.diag([3.0, 3, 1, 1, 0]),
    "two clusters": spectrum(np.r_[np.full(30, 2.0), np.full(34, 1.0)]), "graded": spectrum(np.logspace(0, -14, 32)), "near equal": spectrum(1 + 1e-9 * np.random.default_rng(3).normal(size=32)), "one": np.array([[2.5]]), "signs": spectrum(np.linspace(-1, 1, 15)),
}


@pytest.mark.parametrize("name", CASES)
def test_components_equal_another_solver(name):
    v = CASES[name]
    e, q = wh.components(v)
    scale = max(np.abs(v).max(), 1e-300) * len(v)
    assert np.abs(e - np.linalg.eigvalsh(v)[::-1]).max() <= 1e-14 * scale
    assert np.abs(v @ q - q * e).max() <= 1e-14 * scale and np.abs(q.T @ q - np.eye(len(v))).max() <= 1e-13


def test_polar_factor():
    a = spectrum(np.r_[np.linspace(-3, -1e-6, 10), np.linspace(1e-9, 2, 14)])
    u = wh.qdwh(a)
    assert np.abs(u @ u - np.eye(24)).max() < 1e-12 and round(np.trace(u)) == 4
    h = u @ a
    assert np.abs(h - h.T).max() < 1e-12 and np.linalg.eigvalsh(h).min() > -1e-12


def plain(rows):
    """The contract, with exact fractions and another solver."""
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    xs = [(i, tuple(math.floor(256 * c) for c in v)) for i, v in good]
    fit = sorted({x for _, x in xs})
    n, d = len(fit), len(fit[0])
    s = [sum(x[j] for x in fit) for j in range(d)]
    mean = [Fraction(t, n) for t in s]
    cov = np.array([[float(sum((x[i] - mean[i]) * (x[j] - mean[j]) for x in fit) / n) for j in range(d)] for i in range(d)])
    e, q = np.linalg.eigh(cov)
    e, q = e[::-1], q[:, ::-1]
    y = {x: (np.array([float(a - m) for a, m in zip(x, mean)]) @ q[:, :4]) / np.sqrt(e[:4]) for x in {x for _, x in xs}}
    return sorted((i, k + 1, n, sum((n * a - t) ** 2 for a, t in zip(x, s)), abs(y[x][k]), e[k] / np.trace(cov)) for i, x in xs for k in range(min(4, d)))


def answers(df):
    rows = df.select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error").collect()
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9
    return sorted((r.vec_id, r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in rows)


def same(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:4] == w[:4] and math.isclose(g[4], w[4], rel_tol=1e-8, abs_tol=1e-8) and math.isclose(g[5], w[5], rel_tol=1e-8)


def test_whitening_equals_plain_code(spark):
    rng = np.random.default_rng(4)
    base = (rng.normal(size=(120, 6)) * [5, 3, 2, 1, 0.5, 0.2]).tolist()
    rows = [(i, v) for i, v in enumerate(base)] + [(i, base[0]) for i in range(40)] + [(900, None), (901, []), (902, [1.0, None, 1, 1, 1, 1]), (903, [float("nan")] * 6), (904, [float("inf"), 0, 0, 0, 0, 0]), (7, [-0.0] * 6)]
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v]) for i, v in rows]
    df = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], SCHEMA)
    same(answers(wh.whiten(df)), plain(rows))
    same(answers(wh.whiten(df.repartition(7))), plain(rows))


def test_no_variance_few_dimensions_and_an_empty_table(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], "", 0, 0), (1, [1.0, 2.0], "", 0, 0)], SCHEMA)
    got = wh.whiten(df).collect()
    assert [(r.vec_id, r.n, r.deviation, r.whitened, r.explained) for r in got] == [(1, 1, 0, None, 0.0)] * 4
    assert wh.whiten(df.limit(0)).collect() == []
    flat = spark.createDataFrame([(i, [float(i), 0.5], "", 0, 0) for i in range(5)] + [(9, [1.0, 2.0, 3.0], "", 0, 0)], SCHEMA)
    got = {(r.vec_id, r.component): r for r in wh.whiten(flat).collect()}
    assert got[0, 1].explained == 1.0 and got[0, 2].whitened is None and got[9, 3].n == 1 and math.isclose(abs(got[4, 1].whitened), math.sqrt(2))


def test_large_entries_stay_exact(spark):
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(size=5) * 1e9).tolist()) for i in range(60)]
    same(answers(wh.whiten(spark.createDataFrame([(i, v, "", 0, 0) for i, v in rows], SCHEMA))), [(*p[:3], min(p[3], 2**63 - 1), *p[4:]) for p in plain(rows)])


def test_query_equals_plain_code(spark):
    from medtab.llm.queries import op13_whitening

    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    same(answers(op13_whitening(spark, sf)), plain(rows))
