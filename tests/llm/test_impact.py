"""The impact-ordered index against plain inner products."""

import random
from math import floor

import numpy as np
import pytest

from knotwork.llm import impact


def brute(rows, k, every=100):
    w = [(i, [floor(1024 * float(np.float32(c))) for c in v]) for i, v in rows]
    out = []
    for a, (i, q) in enumerate(w):
        if i % every == 0:
            hits = sorted((-sum(x * y for x, y in zip(q, v, strict=True)), j) for b, (j, v) in enumerate(w) if b != a)[:k]
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(hits, 1)]
    return sorted(out)


@pytest.mark.parametrize(("block", "group"), [(50, 3), (8192, 4096)])
def test_top_k_against_brute_force(spark, monkeypatch, block, group):
    monkeypatch.setattr(impact, "BLOCK", block)
    monkeypatch.setattr(impact, "QUERY_GROUP", group)
    rng = np.random.default_rng(5)
    v = rng.normal(size=(700, 12)).astype(np.float32)
    v[100:180] = v[100]  # ties over blocks
    v[300] = 0
    good = [(i, x.tolist()) for i, x in enumerate(v)] + [(100, v[5].tolist()), (77, v[6].tolist()), (77, v[6].tolist())]
    odd = [(800, None), (900, [float("nan")] * 12), (1000, [None] * 12), (1100, [1.0] * 3), (None, [1.0] * 12), (1200, []), (1300, [float("inf")] * 12), (1400, [1e30] * 12)]
    rows = [(i, x, 0, "s") for i, x in good + odd]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int, score string").repartition(3)
    got = sorted(tuple(r) for r in impact.top_k(df).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute(good, 10)


def test_reading_stops_on_proof_only():
    """Fewer postings than all are read, and every true member is among the possible ones."""
    rng = np.random.default_rng(6)
    v = (rng.normal(size=(4000, 64)) * 128).astype(np.int32)
    v[:3000, 8:] //= 64  # most of a vector's weight in few dimensions
    index, shares = impact.ImpactIndex.of(v), []
    for q in v[::250].astype(np.int64):
        score = v.astype(np.int64) @ q
        kth = np.sort(score)[-10]
        place, found, read = index.search(q, 10)
        assert set(np.flatnonzero(score >= kth)) <= set(place.tolist()) and (score[place] == found).all()
        shares.append(read / v.size)
        place, _, _ = index.search(q, 10, floor=int(kth) + 1)
        assert set(np.flatnonzero(score > kth)) <= set(place.tolist())
    assert min(shares) < 1


def test_zero_query_and_extreme_components():
    v = np.array([[impact.LARGEST * 1024 - 1, -impact.LARGEST * 1024 + 1], [0, 0], [1, -1], [-1, 1]], np.int32)
    index = impact.ImpactIndex.of(v)
    for q in v.astype(np.int64):
        place, found, _ = index.search(q, 2)
        exact = [int(a) * int(q[0]) + int(b) * int(q[1]) for a, b in v.tolist()]
        assert found.tolist() == [exact[p] for p in place.tolist()] and set(np.argsort(exact)[-2:]) <= set(place.tolist()) | set(np.flatnonzero(np.array(exact) == sorted(exact)[-2]))


def test_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [2.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id) for r in impact.top_k(few).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2)]
    assert impact.top_k(few.limit(0)).count() == 0
    one = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<double>")
    assert impact.top_k(one).count() == 0
