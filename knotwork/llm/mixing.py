"""Mixing documents to target weights with soft domain membership.

A classifier fitted on a bounded sample of the labelled table gives each document
posteriors over domains. Projected-gradient least squares then finds nonnegative
document rates whose expected domain token totals match the targets: with S the
totals at the present rates and T the targets, a step moves rate d by
``posterior_d . M (T - S)`` times its tokens, and projects it onto the allowed
rates. M is the inverse of the domains' second-moment matrix over the documents
whose rate is above the least (only those can still fall), so a few steps do. A
step that brings the totals no nearer is halved, and at last replaced by a plain
gradient step, which always does. Only sums of a few numbers a domain pass
through the driver: tasks replay the steps so far from them, so no state of the
documents is kept.

Defined cases: a null or empty text has no tokens and keeps rate 1 (or the least
rate); without labels of two classes all documents are one domain; a null label
is no example; rows that repeat an id have a rate each; targets are normalised,
and a target for a domain with no expected tokens is left out; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.llm.common import arrow_map, row_of, sized_batches, with_row, written
from knotwork.llm.linear import BUCKETS, common_buckets, each_slice, sample_features, sampled
from knotwork.llm.words import folded_table, plain_table, word_hashes

SAMPLE, EPOCHS, STEPS, CLOSE = 3000, 120, 60, 1e-7
_RATED = "doc_id long, n_tokens long, posterior array<double>, rate double, missed double"
_RATED_NAMES = [c.split()[0] for c in _RATED.split(", ")]
_FOLDED, _PLAIN = folded_table(), plain_table()


def fit_domains(rows: list, n_domains: int, epochs: int = EPOCHS, least: int = 5, l2: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial logistic regression on the mean of a document's word weights (scaled by the root of its words)."""
    weights, bias = np.zeros((BUCKETS, n_domains)), np.zeros(n_domains)
    rows = [r for r in rows if len(r.bucket)]
    if len({r.label for r in rows}) < 2:
        return weights, bias
    usable = common_buckets(rows, least)
    buck, doc, val = [], [], []
    for k, r in enumerate(rows):
        u, c = np.unique(np.frombuffer(r.bucket, np.int32), return_counts=True)
        keep = usable[u]
        buck.append(u[keep].astype(np.int64))
        doc.append(np.full(int(keep.sum()), k))
        val.append(c[keep] / np.sqrt(c.sum()))
    buck, doc, val = np.concatenate(buck), np.concatenate(doc), np.concatenate(val)
    names, local = np.unique(buck, return_inverse=True)
    y = np.eye(n_domains)[[r.label for r in rows]]
    w = np.array([r.weight for r in rows])
    w = w / w.sum()
    theta = np.zeros((len(names) + 1, n_domains))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, epochs + 1):
        z = np.stack([np.bincount(doc, theta[local, k] * val, len(rows)) for k in range(n_domains)], 1) + theta[-1]
        g = w[:, None] * (softmax(z) - y)
        grad = np.empty_like(theta)
        for k in range(n_domains):
            grad[:-1, k] = np.bincount(local, g[doc, k] * val, len(names))
        grad[-1] = g.sum(0)
        grad[:-1] += l2 * theta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    weights[names] = theta[:-1]
    return weights, theta[-1]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def posteriors(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], rows: bool = False) -> DataFrame:
    """doc_id, n_tokens (words between ASCII white space) and the posterior of each domain; with ``rows`` also each ``row``."""
    weights, bias = model[0].astype(np.float32), model[1]
    n_domains = len(bias)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            tokens, z = np.zeros(n, np.int64), np.zeros((n, n_domains))
            for buf, offs, i, j in each_slice(batch.column(1)):
                _, _, row = word_hashes(buf, offs, _PLAIN)
                tokens[i:j] = np.bincount(row, minlength=j - i)
                h, _, row = word_hashes(buf, offs, _FOLDED)
                bucket = (h & np.uint64(BUCKETS - 1)).astype(np.int64)
                count = np.maximum(1, np.bincount(row, minlength=j - i))
                for k in range(n_domains):
                    z[i:j, k] = np.bincount(row, weights[bucket, k], j - i) / np.sqrt(count)
            p = softmax(z + bias)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, n * n_domains + 1, n_domains, dtype=np.int32)), pa.array(p.reshape(-1)))
            more = {"row": batch.column(2)} if rows else {}
            yield pa.record_batch([batch.column(0), pa.array(tokens), flat, *more.values()], names=["doc_id", "n_tokens", "posterior", *more])

    given = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *([row_of(docs)] if rows else []))
    return arrow_map(given, predict, with_row("doc_id long, n_tokens long, posterior array<double>", docs, rows))


def replayed(p: np.ndarray, n: np.ndarray, steps: list[np.ndarray], least: float) -> np.ndarray:
    """Rates after the given steps: each adds tokens x posterior . step, then projects onto [least, inf)."""
    rate = np.full(len(n), max(1.0, least))
    for step in steps:
        rate = np.maximum(least, rate + n * (p @ step))
    return rate


def fit_rates(known: DataFrame, targets: list[float], least: float = 0.0, budget: float | None = None, steps: int = STEPS) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Steps of the projected gradient, the targets, and the totals reached.

    ``budget``: expected tokens in all; by default the fewest at which no domain
    has to shrink. ``steps`` bounds the jobs; where the targets cannot be met, the
    totals end as near as they get.
    """
    k = len(targets)

    def totals(done: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Domain totals and the second moments of the documents above the least rate."""

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, moments = np.zeros(k), np.zeros((k, k))
            for batch in batches:
                if batch.num_rows:
                    n = batch.column(0).to_numpy(zero_copy_only=False).astype(float)
                    p = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
                    rate, own = replayed(p, n, done, least), p * n[:, None]
                    total += own.T @ rate
                    free = own[rate > least] if done else own
                    moments += free.T @ free
            yield pa.record_batch([pa.array([[*total, *moments.reshape(-1)]], pa.list_(pa.float64()))], names=["sums"])

        rows = [r.sums for r in arrow_map(known.select("n_tokens", "posterior"), part, "sums array<double>").collect()]
        sums = np.sum(rows or [np.zeros(k + k * k)], axis=0)
        return sums[:k], sums[k:].reshape(k, k)

    done: list[np.ndarray] = []
    now, moments = totals(done)
    share = np.array(targets, float) * (now > 0)
    if not share.sum():
        return [], now, now
    share /= share.sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        want = share * (budget if budget is not None else float(np.max(np.where(share > 0, now / share, 0))))
    plain = 1 / np.trace(moments)
    jobs, shrink = 0, 1.0
    while jobs < steps and np.abs(want - now).sum() > CLOSE * want.sum():
        step = shrink * (np.linalg.pinv(moments, rcond=1e-12) @ (want - now)) if shrink > 0.2 else plain * (want - now)
        then, free = totals([*done, step])
        jobs += 1
        if np.linalg.norm(want - then) < np.linalg.norm(want - now):
            done.append(step)
            now, moments, shrink = then, free, 1.0
        elif shrink <= 0.2:
            break
        else:
            shrink /= 2
    return done, want, now


def mixed(docs: DataFrame, labels: DataFrame, targets: list[float], label: str = "quality", least: float = 0.0, budget: float | None = None, rows: bool = False) -> DataFrame:
    """doc_id, n_tokens, posterior, rate, missed. ``targets``: share of expected tokens of each value 0, 1, ... of ``label``.

    ``missed`` tells, on every row, by what share of all tokens the totals reached
    differ from their targets: about 0, unless no nonnegative rates (or none of
    ``least`` or more) meet them. ``rows``: besides, each document's whole row as a
    column ``row``.
    """
    spark = docs.sparkSession
    sized_batches(spark)
    n_domains = len(targets)
    examples = labels.select("doc_id", label).where(F.col(label).between(0, n_domains - 1))
    model = fit_domains(sample_features(sampled(docs.select("doc_id", "text"), examples, label, SAMPLE)), n_domains)
    known = written(posteriors(docs, model, rows), "posteriors")
    steps, want, now = fit_rates(known, targets, least, budget)
    missed = float(np.abs(want - now).sum() / max(want.sum(), 1.0))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            p = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, n_domains)
            r = replayed(p, batch.column(1).to_numpy(zero_copy_only=False).astype(float), steps, least)
            yield pa.record_batch([*batch.columns[:3], pa.array(r), pa.array(np.full(len(r), missed)), *batch.columns[3:]], names=[*_RATED_NAMES, *batch.schema.names[3:]])

    return arrow_map(known, rate, with_row(_RATED, docs, rows))
