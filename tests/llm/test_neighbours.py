"""The block matrix join against plain inner products."""

import random

import numpy as np
import pytest

from knotwork.llm import neighbours


def brute(rows, k=20):
    """By row: (id, list of (id, score)) of every query row."""
    out = []
    d = np.array([v for _, v in rows], np.float32).astype(np.float64)
    for n, (i, _) in enumerate(rows):
        if i % 20 == 0:
            score = neighbours.exact_products(np.repeat(d[n : n + 1], len(rows), 0), d).tolist()
            out.append((i, [(j, -s) for s, j in sorted((-s, rows[m][0]) for m, s in enumerate(score) if m != n)[:k]]))
    return sorted(out)


def lists(got, k=20):
    """Lists of equal ids are told apart by their order of ranks only where there is one of each."""
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault((r.query_id, r.rank), []).append((r.vec_id, r.score))
    return by


@pytest.mark.parametrize("dense", [0, 1, 8])
def test_nearest_against_brute_force(spark, monkeypatch, dense):
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 4)
    monkeypatch.setattr(neighbours, "CANDIDATE_BLOCK", 50)
    monkeypatch.setattr(neighbours, "DENSE", dense)  # with 0 all tiles are searched from original vectors
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 16)).astype(np.float32)
    v[40:80] = v[40]
    good = [(i, x.tolist()) for i, x in enumerate(v)]
    good += [(20, (-v[20]).tolist()), (20, v[3].tolist()), (21, v[5].tolist()), (21, v[5].tolist()), (60, v[60].tolist())]
    rows = [(i, x, i % 3, "q") for i, x in good]
    odd = [(300, None), (320, [0.0] * 16), (340, [float("nan")] * 16), (360, [None] * 16), (380, [1.0] * 3), (None, [1.0] * 16), (400, [])]
    rows += [(i, x, 0, "q") for i, x in odd]
    random.Random(1).shuffle(rows)
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rank string"), k=20).collect()
    want = {}
    for i, found in brute(good):
        for rank, hit in enumerate(found, 1):
            want.setdefault((i, rank), []).append(hit)
    assert {key: sorted(x) for key, x in lists(got).items()} == {key: sorted(x) for key, x in want.items()}


def test_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [2.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id) for r in neighbours.nearest(few).collect()] == [(0, 1, 1), (0, 2, 2)]
    assert neighbours.nearest(few.limit(0)).count() == 0
