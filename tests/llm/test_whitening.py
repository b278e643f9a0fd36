"""Whitening against numpy and exact whole numbers."""

import math
from fractions import Fraction

import numpy as np
import pytest

from loomtext.llm.whitening import fit_whitening, jacobi, on_grid, whiten

SCHEMA = "vec_id long, embedding array<float>, label int, x string, n int"


def plain(vectors, components=16):
    """x of what is left, and by the contract n, sums, eigenvalues, vectors."""
    kept = [(k, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for k, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in kept}), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    y = np.array([[float(Fraction(int(n * a - s), n)) for a, s in zip(row, sums)] for row in fit])
    e, u = np.linalg.eigh(y.T @ y / n)
    return kept, n, [int(s) for s in sums], e[::-1], u[:, ::-1]


@pytest.mark.parametrize("d", [1, 2, 7, 40])
def test_small_eigenvalues_keep_their_digits(d):
    m = np.random.default_rng(d).normal(size=(3 * d, d)) * np.logspace(0, -7, d)
    e, u = jacobi(m.T @ m)
    assert np.abs(e / np.linalg.svd(m, compute_uv=False) ** 2 - 1).max() < 1e-12
    assert np.abs(u.T @ u - np.eye(d)).max() < 1e-13 and list(e) == sorted(e, reverse=True)


def test_ranks_and_zeros_end():
    m = np.random.default_rng(1).normal(size=(90, 3)) @ np.random.default_rng(2).normal(size=(3, 30))
    e, _ = jacobi(m.T @ m)
    assert (e > 1e-9).sum() == 3 and list(jacobi(np.zeros((4, 4)))[0]) == [0.0] * 4


def test_equals_numpy(spark):
    r = np.random.default_rng(3)
    vectors = [(k, [float(c) for c in v]) for k, v in enumerate(r.normal(size=(150, 9)) * np.arange(1, 10))]
    vectors += vectors[:40] + [(500 + k, vectors[0][1]) for k in range(60)]
    bad = [(900, None), (901, [1.0] * 8 + [None]), (902, [float("nan")] + [0.0] * 8), (903, [0.0, float("-inf"), *[0.0] * 7]), (904, []), (905, [1.0, 2.0]), (None, [0.5] * 9)]
    rows = spark.createDataFrame([(k, v, 1, "x", 2) for k, v in vectors + bad], SCHEMA)
    got = {}
    for g in whiten(rows, 5).collect():
        got.setdefault(g.vec_id, []).append(g)
    kept, n, sums, e, u = plain(vectors + [bad[-1]], 5)
    assert set(got) == {k for k, _ in kept} and sum(map(len, got.values())) == 5 * len(kept)
    for k, x in kept:
        assert {g.deviation for g in got[k]} == {sum((n * a - s) ** 2 for a, s in zip(x, sums))}
        for g in got[k]:
            want = sum((a - s / n) * u[i, g.component - 1] for i, (a, s) in enumerate(zip(x, sums))) / math.sqrt(e[g.component - 1])
            assert g.n == n and abs(abs(g.whitened) - abs(want)) < 1e-8 and abs(g.explained - e[g.component - 1] / e.sum()) < 1e-9 and g.identity_error < 1e-9
    assert whiten(rows.limit(0)).count() == 0 and whiten(rows.where("vec_id in (900, 901)")).count() == 0
    assert whiten(rows.limit(0)).columns == whiten(rows).columns


def test_components_without_variance(spark):
    rows = spark.createDataFrame([(1, [1.0, 1.0, 5.0]), (2, [2.0, 2.0, 5.0]), (3, [4.0, 4.0, 5.0]), (3, [4.0, 4.0, 5.0])], "vec_id int, embedding array<double>")
    got = whiten(rows).collect()
    assert len(got) == 12 and all((g.whitened is None) == (g.component > 1) and g.n == 3 for g in got)
    assert {g.explained for g in got if g.component == 1} == {1.0} and max(g.identity_error for g in got) < 1e-12
    alone = whiten(rows.where("vec_id = 3")).collect()
    assert len(alone) == 6 and all(g.whitened is None and g.deviation == 0 and g.identity_error is None for g in alone)


def test_large_entries(spark):
    rows = spark.createDataFrame([(1, [1e12, 0.0]), (2, [-1e12, 0.5]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert {(g.vec_id, g.deviation) for g in whiten(rows).collect()} == {(1, None), (2, None), (3, (3 * 64 - 96) ** 2)}  # null beyond 63 bits
    with pytest.raises(Exception, match="too large"):
        whiten(spark.createDataFrame([(1, [1e17])], "vec_id long, embedding array<double>")).collect()


def test_whole_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    fit = fit_whitening(rows.select(on_grid(rows["embedding"]).alias("x")).where("x is not null"))
    _, n, sums, e, _ = plain([(r.vec_id, r.embedding) for r in rows.collect()])
    assert (fit.n, fit.sums.tolist()) == (n, sums) and np.abs(fit.values / e[:16] - 1).max() < 1e-9 and fit.identity_error < 1e-9
