"""Ranked lexical search: a forward index in blocks of documents, pruned by block maxima.

A block is a run of documents in storage order. It holds a dictionary of its terms and,
for each document, term codes and counts. Once the totals N and L are known, every
block tells for each of its terms in how many documents it occurs and the largest
impact t(tf, m) it has in one of them. For a query the sum of weight times that maximum
over its terms bounds the score of every document of the block. Blocks are scored by
falling bound: first each query's FIRST best, then its next ones whose bound is not
below the query's k-th score so far, then all others whose bound is not below it; a
block whose bound is lower cannot hold a member and is never read for that query.

All scores are integers, so results are exact. Terms are known by 128 bits of hash; two
terms of one block that share the first 64 are told apart by the others.

Blocks stay where they are written as long as Spark finds the list of wanted blocks small
enough to broadcast; else they are shuffled by their number, once a round.

Queries meet blocks in groups of QUERY_GROUP queries and their terms, so that a task
holds a block, a group and k scores a query; only terms that a query holds leave the
pass over the maxima. A group is met by many blocks: it is small, so Spark broadcasts
it where its size allows it, and splits skewed tasks where not.

Defined cases: a null text has no terms and takes no part in N; documents without terms
likewise; empty tables give no rows; a document longer than a block stands alone and is
read in slices that end between terms; rows that repeat an id are documents each; a null
doc_id is the largest; every row of the queries is a query, also where ids repeat (each
has its own ranks) or are null; equal scores go by ascending doc_id; a query without
known terms gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from knotwork.llm.common import arrow_map, row_slices, sized_batches, utf8, written
from knotwork.llm.words import folded_table, mix, word_hashes

BLOCK_ROWS, BLOCK_BYTES, SLICE = 256, 1 << 20, 1 << 20
QUERY_GROUP = 256
#: Blocks of the first two rounds of a query.
FIRST, SECOND = 4, 64
K1, K1B, SCALE = 1000, 12, 1_000_000_000
_BLOCK = "block long, ids array<long>, n_terms array<long>, h1 binary, h2 binary, heads binary, codes binary, counts binary, with_terms long, total long"
_MAXIMA = "block long, h1 long, h2 long, df long, best long"
_ASKED = "row long, item_id long, h1 long, h2 long, times long"
_SCORED = "row long, item_id long, doc_id long, score long"


def _second_table() -> np.ndarray:
    """The folded table under a fixed permutation of the bytes, for a second hash."""
    order = np.concatenate(([0], 1 + np.argsort(mix(np.arange(1, 256, dtype=np.uint64))))).astype(np.uint8)
    return order[folded_table()]


_TABLES = folded_table(), _second_table()


def terms(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first hash, second hash, row) of each term, in order; long rows are read in slices between terms."""
    between = _TABLES[0][buf] == 0
    cuts, row_of = [offs[:1]], []
    for row, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)):
        at = a
        while b - at > SLICE:
            gap = np.flatnonzero(between[at + SLICE : b])
            if not len(gap):
                break
            at += SLICE + int(gap[0]) + 1
            cuts.append(np.array([at]))
            row_of.append(row)
        cuts.append(np.array([b]))
        row_of.append(row)
    cuts, row_of = np.concatenate(cuts), np.array(row_of, np.int64)
    out = []
    for i, j in row_slices(cuts, SLICE):
        part, inner = buf[cuts[i] : cuts[j]], cuts[i : j + 1] - cuts[i]
        h1, _, row = word_hashes(part, inner, _TABLES[0])[:3]
        h2 = word_hashes(part, inner, _TABLES[1])[0]
        out.append((h1.view(np.int64), h2.view(np.int64), row_of[row + i]))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def coded(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(dictionary's first and second hashes, sorted, code of each term)."""
    d1, first, codes = np.unique(h1, return_index=True, return_inverse=True)
    d2 = h2[first]
    if (d2[codes] != h2).any():  # two terms share 64 bits
        pairs, codes = np.unique(np.column_stack((h1, h2)), axis=0, return_inverse=True)
        d1, d2 = pairs.T
    return np.ascontiguousarray(d1), np.ascontiguousarray(d2), codes.ravel()


def places_in(d1: np.ndarray, d2: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Code of each term in a dictionary; -1 where it isn't there."""
    at = np.searchsorted(d1, h1)
    while True:
        inside = at < len(d1)
        same = inside & (d1[np.minimum(at, len(d1) - 1)] == h1) if len(d1) else inside
        other = same & (d2[np.minimum(at, len(d1) - 1)] != h2) if len(d1) else inside
        if not other.any():
            return np.where(same, at, -1)
        at = at + other


def narrow(x: np.ndarray) -> bytes:
    """Numbers from 0 in the least of 1, 2 or 4 bytes each."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0)))).tobytes()


def widened(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"u{len(data) // n if n else 1}").astype(np.int64)


def _row(values: tuple, schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v], kinds[k]) for v, (_, k) in zip(values, fields, strict=True)], [n for n, _ in fields])


def forward_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The forward index of all documents that hold a term; see _BLOCK."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, (buf, offs) = batch.column(0), utf8(batch.column(1))
            for i, j in _blocks_of(offs):
                h1, h2, row = terms(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                if not len(h1):
                    continue
                n_terms = np.bincount(row, minlength=j - i)
                there = np.flatnonzero(n_terms)
                d1, d2, codes = coded(h1, h2)
                pairs, counts = np.unique((np.cumsum(n_terms > 0)[row] - 1) * len(d1) + codes, return_counts=True)
                heads = np.searchsorted(pairs, np.arange(len(there) + 1) * len(d1))
                kept = ids.take(pa.array(there + i))
                values = block, kept.to_pylist(), n_terms[there].tolist(), d1.tobytes(), d2.tobytes(), heads.astype(np.int32).tobytes(), narrow(pairs % len(d1)), narrow(counts), len(there), len(h1)
                yield _row(values, _BLOCK)
                block += 1

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), blocks, _BLOCK)


def _blocks_of(offs: np.ndarray) -> Iterator[tuple[int, int]]:
    for i, j in row_slices(offs, BLOCK_BYTES):
        for at in range(i, j, BLOCK_ROWS):
            yield at, min(at + BLOCK_ROWS, j)


def impacts(counts: np.ndarray, n_terms: list[int], heads: np.ndarray, n: int, total: int) -> np.ndarray:
    """t(tf, m) of each posting; m = 75 + 25 n N div L of its document."""
    m = np.array([75 + 25 * x * n // total for x in n_terms], np.int64)  # in Python's integers
    return SCALE * counts // (K1 * counts + K1B * np.repeat(m, np.diff(heads)))


def block_maxima(blocks: DataFrame, n: int, total: int) -> DataFrame:
    """For each block and term: documents that hold it and its largest impact there."""

    def maxima(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, n_terms, h1, h2, heads, codes, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h1, h2 = np.frombuffer(h1, np.int64), np.frombuffer(h2, np.int64)
                heads = np.frombuffer(heads, np.int32)
                codes, counts = widened(codes, int(heads[-1])), widened(counts, int(heads[-1]))
                best = np.zeros(len(h1), np.int64)
                np.maximum.at(best, codes, impacts(counts, n_terms, heads, n, total))
                df = np.bincount(codes, minlength=len(h1))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h1), block)), pa.array(h1), pa.array(h2), pa.array(df), pa.array(best)], [f.split()[0] for f in _MAXIMA.split(", ")])

    return arrow_map(blocks.select("block", "n_terms", "h1", "h2", "heads", "codes", "counts"), maxima, _MAXIMA)


def query_terms(queries: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """A row for each query row's distinct term, with its repeats."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 33
        for batch in batches:
            h1, h2, row = terms(*utf8(batch.column(1)))
            if len(h1):
                d1, d2, codes = coded(h1, h2)
                pairs, times = np.unique(row * len(d1) + codes, return_counts=True)
                row, code = np.divmod(pairs, len(d1))
                yield pa.RecordBatch.from_arrays([pa.array(at + row), batch.column(0).take(pa.array(row)), pa.array(d1[code]), pa.array(d2[code]), pa.array(times)], [f.split()[0] for f in _ASKED.split(", ")])
            at += batch.num_rows

    return arrow_map(queries.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), found, _ASKED)


def scored_blocks(tiles: DataFrame, k: int, n: int, total: int) -> DataFrame:
    """The k best scores above 0 (and not below the floor) of each wanted query in each block."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = "ids", "n_terms", "h1", "h2", "heads", "codes", "counts", "wanted", "floors", "rows", "item_ids", "starts", "q1", "q2", "weights"
        for batch in batches:
            for ids, n_terms, h1, h2, heads, codes, counts, wanted, floors, rows, items, starts, q1, q2, weights in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                d1, d2 = np.frombuffer(h1, np.int64), np.frombuffer(h2, np.int64)
                heads = np.frombuffer(heads, np.int32)
                codes, counts = widened(codes, int(heads[-1])), widened(counts, int(heads[-1]))
                starts, weights = np.array(starts), np.array(weights, np.int64)
                code = places_in(d1, d2, np.array(q1, np.int64), np.array(q2, np.int64))
                place = {row: p for p, row in enumerate(rows)}
                # only postings of some query's terms are looked at
                asked = np.zeros(len(d1), bool)
                for row in wanted:
                    here = code[starts[place[row]] : starts[place[row] + 1]]
                    asked[here[here >= 0]] = True
                mine = asked[codes]
                t, kept = impacts(counts, n_terms, heads, n, total)[mine], codes[mine]
                ends = np.concatenate(([0], np.cumsum(mine)))[heads]
                numbers, missing = np.array([0 if i is None else i for i in ids], np.int64), np.array([i is None for i in ids])
                out, weight = [], np.zeros(len(d1), np.int64)
                for row, floor in zip(wanted, floors, strict=True):
                    p = place[row]
                    here, own = code[starts[p] : starts[p + 1]], weights[starts[p] : starts[p + 1]]
                    weight[here[here >= 0]] = own[here >= 0]
                    sums = np.concatenate(([0], np.cumsum(weight[kept] * t)))
                    weight[here[here >= 0]] = 0
                    value = sums[ends[1:]] - sums[ends[:-1]]
                    good = np.flatnonzero((value > 0) & (value >= floor))
                    top = good[np.lexsort((numbers[good], missing[good], -value[good]))[:k]]
                    out += [(row, items[p], ids[d], v) for d, v in zip(top.tolist(), value[top].tolist(), strict=True)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], [f.split()[0] for f in _SCORED.split(", ")])

    return arrow_map(tiles, score, _SCORED)


@dataclass
class Index:
    """A written forward index with its totals."""

    blocks: DataFrame
    n: int
    total: int


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    sized_batches(docs.sparkSession)
    blocks = written(forward_blocks(docs, id_col, text_col), "forward")
    sums = blocks.agg(F.sum("with_terms").alias("n"), F.sum("total").alias("total")).first()
    return Index(blocks, sums.n or 0, sums.total or 0)


def _grouped(weighted: DataFrame, groups: int) -> DataFrame:
    """Queries with their terms and weights, about QUERY_GROUP to a row."""
    term = F.struct("h1", "h2", "weight")
    each = weighted.groupBy("row", "item_id").agg(F.collect_list(term).alias("terms"))  # the distinct terms of one query
    packed = each.groupBy(_group("row", groups)).agg(F.collect_list(F.struct("row", "item_id", "terms")).alias("q"))
    sizes = F.transform("q", lambda q: F.size(q["terms"]))
    starts = F.transform(F.sequence(F.lit(0), F.size("q")), lambda i: F.aggregate(F.slice(sizes, 1, i), F.lit(0), lambda a, b: a + b))
    flat = F.flatten(F.col("q.terms"))
    return packed.select("group", F.col("q.row").alias("rows"), F.col("q.item_id").alias("item_ids"), starts.alias("starts"), flat["h1"].alias("q1"), flat["h2"].alias("q2"), flat["weight"].alias("weights"))


def _group(row: str, groups: int):
    return F.pmod(F.xxhash64(row), F.lit(groups)).cast("int").alias("group")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query with their rank."""
    order = W.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: Index, queries: DataFrame, k: int = 20, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each query."""
    spark = queries.sparkSession
    sized_batches(spark)
    if not index.total:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    term = ["h1", "h2"]
    asked = written(query_terms(queries, id_col, text_col), "asked")
    maxima = written(block_maxima(index.blocks, index.n, index.total).join(asked.select(*term).distinct(), term, "left_semi"), "maxima")
    df = maxima.groupBy(*term).agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(index.n).cast("double") + 2) / (2 * F.col("df").cast("double") + 1))).cast("long") * F.col("times")
    weighted = written(asked.join(df, term).select("row", "item_id", *term, weight.alias("weight")).where("weight > 0"), "weights")
    groups = max(1, -(-weighted.select("row").distinct().count() // QUERY_GROUP))
    packed = written(_grouped(weighted, groups), "query_groups")
    bounds = written(maxima.join(weighted, term).groupBy("row", "block").agg(F.sum(F.col("weight") * F.col("best")).alias("bound")), "bounds")
    place = F.row_number().over(W.partitionBy("row").orderBy(F.desc("bound"), "block"))
    top = written(bounds.withColumn("place", place).where(F.col("place") <= SECOND), "first_bounds")  # SECOND a query
    rest = bounds.join(top.select("row", "block"), ["row", "block"], "left_anti")
    best = None
    for some in (top.where(F.col("place") <= FIRST), top.where(F.col("place") > FIRST), rest):
        pairs = some.select("row", "block", "bound")
        if best is None:
            pairs = pairs.withColumn("floor", F.lit(0).cast("long"))
        else:
            floors = best.where(F.col("rank") == k).select("row", F.col("score").alias("floor"))
            pairs = pairs.join(floors, "row", "left").fillna(0, ["floor"]).where("bound >= floor")
        # written, so that Spark knows its size and sends it to the blocks where it is small, not the blocks to it
        wanted = written(pairs.groupBy("block", _group("row", groups)).agg(F.collect_list(F.struct("row", "floor")).alias("w")), "wanted")
        tiles = wanted.select("block", "group", F.col("w.row").alias("wanted"), F.col("w.floor").alias("floors")).join(index.blocks.drop("with_terms", "total"), "block").join(packed, "group")
        found = scored_blocks(tiles, k, index.n, index.total)
        best = written(_best(found if best is None else best.drop("rank").unionAll(found), k), "best")
    return best.select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """Index a table of documents and search it for each row of (item_id, text)."""
    return search(build(docs), queries, k)
