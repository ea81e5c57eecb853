"""Toxicity by multiple-instance learning: labels of documents train scores of sentences.

A sentence's score is a logistic function of the weights of its words and of
their beginnings (so that inflected forms share evidence), each counted once a
sentence. A document is toxic unless all its sentences are clean, so their
scores combine by noisy-or; the weights are fitted to the documents' labels
through that rule.
The model is fitted on a bounded sample: at most SAMPLE documents of each class,
spread by a hash of their ids. Every document is then scored whole.

Defined cases: a null or empty text has no sentence and scores 0; documents
without any usable label leave an untrained model that scores 0; a row whose
label is null is no example; rows that repeat an id are scored each; label,
lang, source and doc_id never enter a score; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.llm.common import arrow_map, row_of, sized_batches, with_row
from knotwork.llm.linear import BUCKETS, common_buckets, each_slice, sample_features, sampled, sentences

#: Documents of each class that the fit takes at most; epochs of it, more where they would make fewer steps.
SAMPLE, EPOCHS, STEPS = 3000, 12, 600
THRESHOLD, OFFENDING = 0.3, 0.5
_SCORED = "doc_id long, score double, n_sentences long, offending array<struct<start:long,end:long,score:double>>"


def held_out(doc_id):
    """Rows that never train: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(rows: list, epochs: int = EPOCHS, least: int = 3, l1: float = 1e-4, l2: float = 1e-5, rate: float = 0.05, batch: int = 64) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam over small batches, on the weighted log-likelihood of the noisy-or.

    ``l1`` and ``l2`` penalise weights; the first keeps rare words of a few toxic
    documents from being learnt by heart.
    """
    rows = [r for r in rows if len(r.bucket)]
    if len({r.label for r in rows}) < 2:
        return np.zeros(BUCKETS), -50.0
    names = np.flatnonzero(common_buckets(rows, least))
    place = np.full(BUCKETS, -1)
    place[names] = np.arange(len(names))
    examples = []
    for r in rows:
        b, s = place[np.frombuffer(r.bucket, np.int32)], np.frombuffer(r.sentence, np.int32)
        examples.append((b[b >= 0], s[b >= 0], int(s.max()) + 1))
    label = np.array([r.label for r in rows], float)
    share = np.array([r.weight for r in rows])
    share /= share.mean()
    theta = np.zeros(len(names) + 1)
    theta[-1] = -6.0
    rng = np.random.default_rng(7)
    m, v, t = np.zeros_like(theta), np.zeros_like(theta), 0
    epochs = max(epochs, -(-STEPS * batch // len(rows)))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), batch):
            own = order[at : at + batch]
            sizes = np.array([examples[i][2] for i in own])
            first = np.cumsum(sizes) - sizes
            word = np.concatenate([examples[i][0] for i in own])
            sentence = np.concatenate([examples[i][1] + k for i, k in zip(own, first, strict=True)])
            doc, n = np.repeat(np.arange(len(own)), sizes), int(sizes.sum())
            y, w = label[own], share[own] / len(own)
            z = np.bincount(sentence, theta[word], n) + theta[-1]
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            toxic = np.clip(-np.expm1(np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), len(own))), 1e-12, 1)
            # d(-log likelihood) / dz = p for a clean document, p - p / toxic for a toxic one
            g = w[doc] * p * np.where(y[doc] > 0, 1 - 1 / toxic[doc], 1.0)
            grad = np.append(np.bincount(word, g[sentence], len(names)), g.sum())
            grad[:-1] += l2 * theta[:-1] + l1 * np.sign(theta[:-1])
            t += 1
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            theta -= step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    weights = np.zeros(BUCKETS)
    weights[names] = theta[:-1]
    return weights, float(theta[-1])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = SAMPLE) -> tuple[np.ndarray, float]:
    sized_batches(docs.sparkSession)
    learn = labels.where(~held_out(F.col("doc_id")))
    return fit(sample_features(sampled(docs.select("doc_id", "text"), learn.select("doc_id", label), label, most), prefixes=True))


def sentence_scores(buf: np.ndarray, offs: np.ndarray, weights: np.ndarray, bias: float):
    """(row, first byte, probability) of each sentence with a word."""
    s = sentences(buf, offs)
    if not len(s.row):
        return s.row, s.byte, np.empty(0)
    z = np.bincount(s.sentence, weights[s.bucket], len(s.row)) + bias
    return s.row, s.byte, 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score(docs: DataFrame, model: tuple[np.ndarray, float], rows: bool = False) -> DataFrame:
    """doc_id, score, n_sentences and the offending sentences' byte spans; a scan and one map.

    ``rows``: besides, each document's whole row as a column ``row``.
    """
    sized_batches(docs.sparkSession)
    weights, bias = model[0].astype(np.float32), model[1]
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            clean, count, spans = np.zeros(n), np.zeros(n, np.int64), [[] for _ in range(n)]
            for buf, offs, i, j in each_slice(batch.column(1)):
                row, byte, p = sentence_scores(buf, offs, weights, bias)
                clean[i:j] = np.bincount(row, np.log1p(-np.minimum(p, 1 - 1e-12)), j - i)
                count[i:j] = np.bincount(row, minlength=j - i)
                hit = p >= OFFENDING
                if len(row):  # a toxic document has its worst sentence located at least
                    order = np.lexsort((p, row))
                    worst = order[np.append(row[order][1:] != row[order][:-1], True)]
                    hit[worst] |= -np.expm1(clean[i:j])[row[worst]] >= THRESHOLD
                for k in np.flatnonzero(hit).tolist():
                    r = int(row[k])
                    end = byte[k + 1] if k + 1 < len(row) and row[k + 1] == r else offs[r + 1]
                    spans[i + r].append({"start": int(byte[k] - offs[r]), "end": int(end - offs[r]), "score": float(p[k])})
            yield pa.record_batch([batch.column(0), pa.array(-np.expm1(clean)), pa.array(count), pa.array(spans, span)], names=["doc_id", "score", "n_sentences", "offending"])

    def scored_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for made in scored([batch]):
                yield pa.record_batch([*made.columns, batch.column(2)], names=[*made.schema.names, "row"])

    texts = [F.col("doc_id").cast("long"), F.col("text").cast("string")]
    if rows:
        return arrow_map(docs.select(*texts, row_of(docs)), scored_rows, with_row(_SCORED, docs))
    return arrow_map(docs.select(*texts), scored, _SCORED)
