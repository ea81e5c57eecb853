"""Whitening against an eigendecomposition of the exact covariance."""

from fractions import Fraction
from math import floor

import numpy as np
import pytest

from knotwork.llm import whitening
from knotwork.llm.queries import by_component


def brute(rows, k=16):
    """(n, sums, eigenvalues, components, trace, rows that stay) in exact sums and plain loops."""
    stay = [(i, [floor(64 * c) + 1000000 for c in v]) for i, v in rows]
    fit = sorted({tuple(x) for _, x in stay})
    n, d = len(fit), len(fit[0])
    s = [sum(x[j] for x in fit) for j in range(d)]
    cov = [[float(Fraction(sum((n * x[a] - s[a]) * (n * x[b] - s[b]) for x in fit), n**3)) for b in range(d)] for a in range(d)]
    e, v = np.linalg.eigh(np.array(cov))
    return n, s, e[::-1][:k], v[:, ::-1][:, :k], sum(cov[j][j] for j in range(d)), stay


def compare(got, rows, k):
    n, s, e, v, trace, stay = brute(rows, k)
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r)
    assert len(got) == len(stay) * len(e)
    for i, x in stay:
        dev = sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True))
        found = by[(i, dev)]
        assert sorted(found) == list(range(1, len(e) + 1))
        for c, hits in found.items():
            for r in hits:
                y = (np.array([n * a - b for a, b in zip(x, s, strict=True)], float) / n) @ v[:, c - 1] / np.sqrt(e[c - 1])
                assert r.n == n and abs(abs(r.whitened) - abs(y)) < 1e-7
                assert abs(r.explained - e[c - 1] / trace) < 1e-9
                assert r.identity_error < 1e-9


def test_whitening_against_brute_force(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(150, 20)) * np.linspace(3, 0.5, 20)
    good = [(i, x) for i, x in enumerate(v.tolist())]
    good += [(5, v[7].tolist()), (None, v[9].tolist()), *[(1000 + i, v[3].tolist()) for i in range(300)]]
    odd = [(900, None), (901, [float("nan")] * 20), (902, [float("inf")] + [1.0] * 19), (903, [None] + [1.0] * 19), (904, []), (905, [1.0] * 3), (906, [1e300] * 20)]
    rows = [(i, x, "n", 7) for i, x in good + odd]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, whitened string, n int").repartition(5)
    compare(by_component(whitening.whiten(df)).collect(), good, 16)


def test_signs_agree_over_rows(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(60, 4)) * [4, 3, 2, 1]
    got = by_component(whitening.whiten(spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>"))).collect()
    w = np.zeros((60, 4))
    for r in got:
        w[r.vec_id, r.component - 1] = r.whitened
    assert np.allclose(w.T @ w / 60, np.eye(4), atol=1e-9)


def test_wide_integers_stay_exact(spark):
    """Deviations beyond 64 bits are exact in the operator and null in the query's long."""
    values = [(0, [2.0**40, 1.0]), (1, [-(2.0**40), 0.5]), (2, [3.0, 2.0**39])]
    got = whitening.whiten(spark.createDataFrame(values, "vec_id long, embedding array<double>")).collect()
    n, s, _, _, _, stay = brute(values, 2)
    want = {i: sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True)) for i, x in stay}
    assert {r.vec_id: int(r.deviation) for r in got} == want
    assert all(r.deviation is None for r in by_component(whitening.whiten(spark.createDataFrame(values, "vec_id long, embedding array<double>"))).collect())


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_nothing_to_whiten(spark, rows):
    assert by_component(whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))).collect() == []


def test_rank_below_the_number_asked_for(spark):
    rows = [(i, [float(i), 2.0 * i, 0.0]) for i in range(40)]
    got = by_component(whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))).collect()
    assert {r.component for r in got} == {1} and all(abs(r.explained - 1) < 1e-9 for r in got)
