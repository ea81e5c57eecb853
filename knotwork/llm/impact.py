"""Exact top-k by integer inner product: an impact-ordered index, read score at a time.

Components become integers w = floor(1024 x). The index is cut into blocks of vectors.
Within a block every dimension has a posting of each vector, sorted by quantised impact
(w without its low bits), so that equal impacts are one segment. A query takes the
segments of all dimensions by descending size of component times impact and adds that
product to the accumulators of a segment's vectors, in rounds. What is not yet read, and
what quantisation hides, bounds how far an accumulator can be from the true score; after
each round the vectors whose upper bound reaches the k-th lower bound (or the k-th exact
score of the blocks before) are the possible members. Reading stops when those are few,
or when all is read; the possible members, all of them, are scored from their integer
vectors. No vector is left out without such a proof.

Groups of queries meet blocks by an equi-join on the group's number, so the whole table
is read once for each group of QUERY_GROUP queries; a task holds one block, one group
and k scores a query. Where one vector has thousands of near copies they are all
possible members of each other's lists and are scored as such, inside their blocks.

Defined cases: vectors that are null, empty or hold null or non-finite components take no
part, nor do those of another length than the most frequent one (of equally frequent ones
the shortest), with a component of LARGEST or more (whose products leave 64 bits) or with
a null id; zero vectors do take part; rows that repeat an id are queries and candidates
each, and a row with a query's id is a candidate unless it is that very row; ties go to
the smaller id; fewer candidates than k give all of them; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from knotwork.llm.common import arrow_map, sized_batches, written

SCALE, LARGEST = 1024, 1 << 13
BLOCK, QUERY_GROUP = 8192, 4096
#: Impacts of one sign, at most; rounds between checks; possible members, in units of k, at which reading stops.
LEVELS, ROUNDS, FEW = 32, 8, 8
_BLOCK = "block long, ids binary, vectors binary, places binary, segments binary, low_bits int, dim int"
_QUERY = "row long, vec_id long, vector binary"
_TOP = "row long, query_id long, vec_id long, score long"


def integers(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, w (array of long) of the vectors that take part."""
    v = F.col("v")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0))
    good = rows.where(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST)))
    dims = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).first()
    return good.where(F.size("v") == (dims.d if dims else 0)).select("vec_id", F.transform("v", lambda x: F.floor(x * SCALE).cast("int")).alias("w"))


class ImpactIndex:
    """Postings of one block: for each dimension the places of its vectors by impact.

    ``segments`` has a row (dimension, twice the middle of its impacts, first, end) for
    each run of equal impacts in ``places``. Twice the middle, so that it is an integer.
    """

    def __init__(self, vectors: np.ndarray, places: np.ndarray, segments: np.ndarray, low_bits: int):
        self.vectors, self.places, self.segments, self.low_bits = vectors, places, segments, low_bits

    @classmethod
    def of(cls, vectors: np.ndarray) -> ImpactIndex:
        n, dims = vectors.shape
        low_bits = max(0, int(np.abs(vectors.astype(np.int64)).max()).bit_length() - (LEVELS.bit_length() - 1))
        impact = vectors.T >> low_bits
        places = np.argsort(impact, axis=1, kind="stable")
        ordered = np.take_along_axis(impact, places, axis=1)
        head = np.ones((dims, n), bool)
        head[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
        first = np.flatnonzero(head)
        middle = 2 * (ordered.ravel()[first].astype(np.int64) << low_bits) + (1 << low_bits) - 1
        segments = np.column_stack((first // n, middle, first, np.append(first[1:], n * dims)))
        return cls(vectors, places.astype(np.uint16).ravel(), segments, low_bits)

    def search(self, q: np.ndarray, k: int, floor: int | None = None, own: int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """(places, scores) of all vectors that may be among the k best scores, and how many postings were read.

        Only scores of ``floor`` or more are asked for; the vector at ``own`` is left out.
        """
        n, dims = self.vectors.shape
        dim, middle, first, end = self.segments.T
        part = q[dim] * middle
        size = np.abs(part)
        order = np.argsort(-size, kind="stable")
        count = (end - first)[order]
        read = np.cumsum(count)
        # what the unread segments of each dimension can add: the size of the largest of them
        left = np.zeros(dims, np.int64)
        np.maximum.at(left, dim, size)
        small = left.sum() < 1 << 52  # then sums of doubles are exact
        hidden = int(np.abs(q).sum()) * ((1 << self.low_bits) - 1)
        following = _next_in_dimension(dim[order], size[order])
        unread = int(left.sum()) - np.cumsum(size[order] - following)
        total, at = np.zeros(n, np.int64), 0
        low = None if floor is None else 2 * floor
        for stop in np.searchsorted(read, np.linspace(0, read[-1], ROUNDS + 1)[1:], "left") + 1:
            run = order[at:stop]
            if len(run):
                lengths = count[at:stop]
                ends = np.cumsum(lengths)
                where = np.repeat(first[run] - ends + lengths, lengths) + np.arange(ends[-1])
                if small:
                    total += np.bincount(self.places[where], np.repeat(part[run].astype(np.float64), lengths), n).astype(np.int64)
                else:
                    np.add.at(total, self.places[where], np.repeat(part[run], lengths))
                at = stop
            slack = int(unread[at - 1]) + hidden
            bound = low
            if n > k:
                seen = total if own is None else np.delete(total, own)
                kth = int(np.partition(seen, len(seen) - k)[len(seen) - k]) - slack if len(seen) >= k else None
                bound = kth if bound is None or (kth is not None and kth > bound) else bound
            possible = np.flatnonzero(total + slack >= bound) if bound is not None else np.arange(n)
            if len(possible) <= FEW * k:
                break
        if own is not None:
            possible = possible[possible != own]
        return possible, self.vectors[possible].astype(np.int64) @ q, int(read[at - 1]) if at else 0


def _next_in_dimension(dim: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Size of the next segment of the same dimension in this order; 0 after the last one."""
    by = np.argsort(dim, kind="stable")
    out = np.zeros(len(dim), np.int64)
    same = dim[by][1:] == dim[by][:-1]
    out[by[:-1][same]] = size[by[1:][same]]
    return out


def indexed(rows: DataFrame) -> DataFrame:
    """Blocks of up to BLOCK vectors of (vec_id, w) with their postings; ``block`` << 16 plus its place is a row."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, vectors, held = TaskContext.get().partitionId() << 24, [], [], 0

        def closed() -> pa.RecordBatch:
            index = ImpactIndex.of(np.concatenate(vectors))
            values = block, np.concatenate(ids).tobytes(), index.vectors.tobytes(), index.places.tobytes(), index.segments.tobytes(), index.low_bits, index.vectors.shape[1]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.int64(), *[pa.binary()] * 4, pa.int32(), pa.int32()), strict=True)], [f.split()[0] for f in _BLOCK.split(", ")])

        for batch in batches:
            at = 0
            if batch.num_rows:
                own, w = batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(batch.num_rows, -1)
            while at < batch.num_rows:
                take = min(BLOCK - held, batch.num_rows - at)
                ids.append(own[at : at + take])
                vectors.append(w[at : at + take])
                held, at = held + take, at + take
                if held == BLOCK:
                    yield closed()
                    block, ids, vectors, held = block + 1, [], [], 0
        if held:
            yield closed()

    return arrow_map(rows, blocks, _BLOCK)


def queries_of(blocks: DataFrame, every: int) -> DataFrame:
    """The vectors of blocks whose id divides by ``every``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ids, vectors, dim in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.frombuffer(ids, np.int64)
                mine = np.flatnonzero(ids % every == 0)
                if len(mine):
                    parts = [vectors[p * dim * 4 : (p + 1) * dim * 4] for p in mine.tolist()]
                    yield pa.record_batch([pa.array((block << 16) + mine), pa.array(ids[mine]), pa.array(parts, pa.binary())], names=["row", "vec_id", "vector"])

    return arrow_map(blocks.select("block", "ids", "vectors", "dim"), rows, _QUERY)


def best_of(tiles: DataFrame, k: int) -> DataFrame:
    """The k best of each query within the tiles (group and block) of each task."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, best = None, []

        def told() -> Iterator[pa.RecordBatch]:
            sizes = [len(b[0]) for b in best]
            if sum(sizes):
                score, ids = (np.concatenate(c) for c in zip(*best, strict=True))
                yield pa.record_batch([pa.array(np.repeat(rows, sizes)), pa.array(np.repeat(q_ids, sizes)), pa.array(ids), pa.array(score)], names=["row", "query_id", "vec_id", "score"])

        for batch in batches:
            for g, block, ids, vectors, places, segments, low_bits, dim, q_rows, these, q_vectors in zip(*(batch.column(c).to_pylist() for c in ("group", "block", "ids", "vectors", "places", "segments", "low_bits", "dim", "rows", "q_ids", "q_vectors")), strict=True):
                if g != group:
                    yield from told()
                    group, rows, q_ids = g, np.array(q_rows, np.int64), np.array(these, np.int64)
                    q = np.frombuffer(b"".join(q_vectors), np.int32).reshape(-1, dim).astype(np.int64)
                    best = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(rows)
                index = ImpactIndex(np.frombuffer(vectors, np.int32).reshape(-1, dim), np.frombuffer(places, np.uint16), np.frombuffer(segments, np.int64).reshape(-1, 4), low_bits)
                ids = np.frombuffer(ids, np.int64)
                for at, row in enumerate(rows.tolist()):
                    score, near = best[at]
                    place, found, _ = index.search(q[at], k, int(score.min()) if len(score) == k else None, row & 0xFFFF if row >> 16 == block else None)
                    score, near = np.concatenate((score, found)), np.concatenate((near, ids[place]))
                    first = np.lexsort((near, -score))[:k]
                    best[at] = score[first], near[first]
        yield from told()

    return arrow_map(tiles.repartition("group", "block").sortWithinPartitions("group"), search, _TOP)


def top_k(df: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products of each row whose id divides by ``every``."""
    sized_batches(df.sparkSession)
    blocks = written(indexed(integers(df, id_col, vec_col)), "impacts")
    asked = written(queries_of(blocks, every), "asked")
    groups = max(1, -(-asked.count() // QUERY_GROUP))
    grouped = asked.groupBy(F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int").alias("group")).agg(F.collect_list(F.struct("row", "vec_id", "vector")).alias("q"))  # about QUERY_GROUP of them
    gathered = grouped.select("group", F.col("q.row").alias("rows"), F.col("q.vec_id").alias("q_ids"), F.col("q.vector").alias("q_vectors"))
    tiles = blocks.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).join(gathered, "group")
    order = W.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return best_of(tiles, k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
