"""Sparse features of words and small linear models fitted on a bounded sample."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from knotwork.llm.common import arrow_map, row_slices, utf8
from knotwork.llm.words import folded_table, sentence_starts, word_hashes

#: Word features are hashed into so many weights.
BUCKETS = 1 << 18
FOLDED = folded_table()


#: Lengths in bytes of the word beginnings that are features besides whole words; inflected forms share them.
PREFIXES = (3, 4, 5, 6)


@dataclass
class Sentences:
    """Distinct buckets of each sentence's words and their beginnings, their sentences, and each sentence's row and first byte."""

    bucket: np.ndarray
    sentence: np.ndarray
    row: np.ndarray
    byte: np.ndarray


def sentences(buf: np.ndarray, offs: np.ndarray) -> Sentences:
    h, start, row, cut = word_hashes(buf, offs, FOLDED, PREFIXES)
    if not len(h):
        none = np.empty(0, np.int64)
        return Sentences(none, none, none, none)
    begins = sentence_starts(buf, offs)
    which = np.searchsorted(begins, start, "right") - 1
    new = np.concatenate(([True], which[1:] != which[:-1]))
    sentence, first = np.cumsum(new) - 1, np.flatnonzero(new)
    features = (np.concatenate([h, *(c for c, _ in cut)]) & np.uint64(BUCKETS - 1)).astype(np.int64)
    both = np.unique(np.concatenate([sentence, *(sentence[w] for _, w in cut)]) * BUCKETS + features)
    return Sentences(both % BUCKETS, both // BUCKETS, row[first], begins[which[first]])


#: Bytes of the texts of one class that a fit takes at most, and of one of them.
SAMPLE_BYTES, LONGEST_EXAMPLE = 16 << 20, 1 << 20


def sampled(docs: DataFrame, labels: DataFrame, label: str, most: int, id_col: str = "doc_id") -> DataFrame:
    """Up to ``most`` labelled documents of each class (label, weight, text), by the hash of their ids, within SAMPLE_BYTES.

    ``labels`` and ``most`` bound what is broadcast. ``weight`` restores the
    classes' shares. A document with contradictory labels counts by the larger, as
    do equal texts; of rows that share an id the least text counts.
    """
    one = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label).cast("int").alias("_y"))
    one = one.join(docs.select(F.col(id_col).alias("_id")).distinct(), "_id", "left_semi").withColumn("_h", F.xxhash64("_id"))
    sizes = {r._y: r.n for r in one.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for y, n in sorted(sizes.items()):
        part = one.where(F.col("_y") == y).orderBy("_h", "_id").limit(most).withColumn("_w", F.lit(n / min(n, most)))
        chosen = part if chosen is None else chosen.unionByName(part)
    if chosen is None:
        return docs.limit(0).select(F.lit(0).alias("label"), F.lit(1.0).alias("weight"), F.lit("").alias("text"))
    text = F.coalesce(F.col("text"), F.lit(""))
    fit = docs.where(F.octet_length(text) <= LONGEST_EXAMPLE).select(F.col(id_col).alias("_id"), text.alias("text"))
    each = fit.join(F.broadcast(chosen), "_id").groupBy("_id").agg(F.max(F.struct("_y", "_w", "_h")).alias("x"), F.min("text").alias("text"))
    once = each.groupBy("text").agg(F.max("x").alias("x")).select("x._y", "x._w", "x._h", "text")
    before = F.sum(F.octet_length("text").cast("long")).over(W.partitionBy("_y").orderBy("_h", "text"))  # ``most`` rows a class
    kept = once.withColumn("_bytes", before).where(F.col("_bytes") <= SAMPLE_BYTES)
    return kept.select(F.col("_y").alias("label"), F.col("_w").alias("weight"), "text")


_FEATURES = "label int, weight double, bucket binary, sentence binary"


def sample_features(sample: DataFrame, prefixes: bool = False) -> list:
    """The bounded sample's buckets and their sentences; made by tasks, gathered to fit the model.

    ``prefixes``: with the words' beginnings; else whole words alone, as one sentence.
    """

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = utf8(batch.column(2))
            cols = [[], []]
            for i in range(batch.num_rows):
                own = buf[offs[i] : offs[i + 1]]
                ends = np.array([0, len(own)])
                if prefixes:
                    s = sentences(own, ends)
                    bucket, sentence = s.bucket, s.sentence
                else:
                    bucket = word_hashes(own, ends, FOLDED)[0] & np.uint64(BUCKETS - 1)
                    sentence = np.zeros(len(bucket))
                cols[0].append(bucket.astype(np.int32).tobytes())
                cols[1].append(sentence.astype(np.int32).tobytes())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.binary())], names=["label", "weight", "bucket", "sentence"])

    rows = arrow_map(sample, features, _FEATURES).collect()
    rows.sort(key=lambda r: (r.label, bytes(r.bucket), bytes(r.sentence)))
    return rows


def common_buckets(rows: list, least: int) -> np.ndarray:
    """Buckets that at least ``least`` sampled documents hold; others get no weight."""
    df = np.zeros(BUCKETS, np.int64)
    for r in rows:
        df[np.unique(np.frombuffer(r.bucket, np.int32))] += 1
    return df >= least


def each_slice(column: pa.Array):
    """(buffer, offsets, first row) of a text column, about a megabyte at a time."""
    buf, offs = utf8(column)
    for i, j in row_slices(offs):
        yield buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], i, j
