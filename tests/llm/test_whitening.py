"""Whitening against an eigendecomposition of the covariance, and on awkward vectors."""

from __future__ import annotations

import numpy as np
import pytest

from scriptorium.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, component string, n string, y string, whitened string"


def brute(vectors, components=16):
    """n, eigenvalues, trace, and the fit list with its mean, by way of the covariance."""
    x = [tuple(int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v) for v in vectors]
    fit = sorted(set(x))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * c - s) / n for c, s in zip(r, sums)] for r in fit])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:components]
    return x, n, sums, values[order], axes[:, order], values.sum()


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(k, v, "c", "n", "y", "w") for k, v in rows], SCHEMA).repartition(parts)


def check(found, rows, components):
    good = [(k, v) for k, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    x, n, sums, values, axes, trace = brute([v for _, v in good])
    assert len(found) == len(good) * components
    got = sorted(found, key=lambda r: (r.vec_id, r.component))
    order = sorted(range(len(good)), key=lambda i: good[i][0])
    for at, i in enumerate(order):
        own = got[at * components : (at + 1) * components]
        assert [r.component for r in own] == list(range(1, components + 1))
        deviation = sum((n * c - s) ** 2 for c, s in zip(x[i], sums))
        assert {(r.vec_id, r.n, r.deviation) for r in own} == {(good[i][0], n, deviation if deviation < 1 << 63 else None)}
        want = np.array([(n * c - s) / n for c, s in zip(x[i], sums)]) @ axes[:, :components] / np.sqrt(values[:components])
        assert np.allclose(np.abs([r.whitened for r in own]), np.abs(want), rtol=1e-8, atol=1e-8)
    assert np.allclose([r.explained for r in got[:components]], values[:components] / trace, rtol=1e-10)
    assert {r.identity_error < 1e-8 for r in found} == {True}


def test_against_covariance(spark):
    rng = np.random.default_rng(5)
    rows = [(k, [float(c) for c in rng.normal(size=20) * np.linspace(0.2, 2, 20)]) for k in range(700)]
    rows += [(1000 + k, rows[3][1]) for k in range(300)]  # a third are copies, which count once
    rows += [(-1, None), (-2, []), (-3, [float("nan")] * 20), (-4, [1.0, None] * 10), (-5, [float("inf")] * 20)]
    check(whitening.whiten(frame(spark, rows, 9)).collect(), rows, 16)


def test_many_factors_make_one(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    rng = np.random.default_rng(6)
    rows = [(k, [float(c) for c in rng.normal(size=5) * (1, 2, 4, 8, 16)]) for k in range(400)]
    check(whitening.whiten(frame(spark, rows, 13)).collect(), rows, 5)


def test_few_vectors_have_few_components(spark):
    rows = [(0, [1.0, 0.0, 0.0, 2.0]), (1, [0.0, 1.0, 0.0, 2.0]), (2, [0.0, 0.5, 3.0, 2.0]), (3, [1.0, 0.0, 0.0, 2.0])]
    check(whitening.whiten(frame(spark, rows)).collect(), rows, 2)
    assert whitening.whiten(frame(spark, rows[:1])).count() == 0


def test_huge_components_stay_exact(spark):
    rng = np.random.default_rng(7)
    rows = [(k, [float(np.float32(c)) for c in rng.normal(size=3) * 2.0**40]) for k in range(50)]
    check(whitening.whiten(frame(spark, rows)).collect(), rows, 3)


@pytest.mark.parametrize("rows", [[], [(1, None), (None, None)]])
def test_nothing_to_whiten(spark, rows):
    found = whitening.whiten(frame(spark, rows))
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and found.count() == 0


def test_null_and_repeated_ids_and_other_lengths(spark):
    rng = np.random.default_rng(8)
    rows = [(k % 40, [float(c) for c in rng.normal(size=3)]) for k in range(80)] + [(None, [1.0, 2.0, 3.0]), (500, [1.0, 2.0])]
    found = whitening.whiten(frame(spark, rows)).collect()
    assert len(found) == 81 * 3 and not any(r.vec_id == 500 for r in found)
    assert sum(r.vec_id is None for r in found) == 3 and sum(r.vec_id == 7 for r in found) == 6
