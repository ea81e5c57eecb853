"""Exact nearest neighbours by inner product: a block matrix join over int8 tiles.

Vectors are packed into blocks, each with their int8 codes, scales and error
weights; a row is known by its block and place. Every group of queries meets the
codes of every candidate block once, as an equi-join on the group's number. A
tile's product of codes gives each inner product with a bound of its quantisation
error; a pair survives if its upper bound reaches the query's k-th lower bound of
all tiles of its task, and then of all tasks. Original vectors are fetched for
surviving pairs only, their products are made in double precision, and a heap per
query keeps the k best. A tile in which codes tell too little apart (many pairs
survive, as among copies of one vector) is searched again from the original vectors
of its two blocks instead, with k pairs for each query handed on.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components take no part, nor do those of another length than the most frequent
one or with a null id; rows that repeat an id are queries and candidates each, and a
row with a query's id is a candidate, too, unless it is that very row; ties go to the
smaller id; fewer candidates than k give all of them; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from knotwork.llm.common import arrow_map, written

QUERY_BLOCK, CANDIDATE_BLOCK, SLICE = 1024, 8192, 128
#: Survivors of one tile for each query, in units of k, beyond which its original vectors are searched.
DENSE = 8
_BLOCK = "block long, ids binary, vectors binary, codes binary, bounds binary, dim int"
_QUERY = "row long, vec_id long, vector binary, codes binary, bounds binary, dim int"
_PAIR = "row long, c_row long, high double, floor double, group int, c_block long"
_TOP = "row long, query_id long, vec_id long, score double"


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, v (array of double) of the vectors that take part."""
    v = F.col("v")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & v.isNotNull())
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = rows.where(finite & F.exists(v, lambda x: x != 0.0))
    dims = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).first()
    return good.where(F.size("v") == (dims.d if dims else 0))


def _record(rows: list, schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.record_batch([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])


def packed(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of up to ``size`` vectors of (vec_id, v) with their codes; ``block`` << 16 plus its place is a row."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 24
        ids, vectors, held = [], [], 0

        def closed() -> pa.RecordBatch:
            i, v = np.concatenate(ids), np.concatenate(vectors)
            codes, scale, weight = quantised(v)
            return _record([(block, i.tobytes(), v.tobytes(), codes.tobytes(), np.column_stack((scale, weight)).tobytes(), v.shape[1])], _BLOCK)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
            at = 0
            while at < n:
                take = min(size - held, n - at)
                ids.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)[at : at + take])
                vectors.append(flat[at : at + take])
                held, at = held + take, at + take
                if held == size:
                    yield closed()
                    block, ids, vectors, held = block + 1, [], [], 0
        if held:
            yield closed()

    return arrow_map(rows, blocks, _BLOCK)


def unpacked(blocks: DataFrame, every: int) -> DataFrame:
    """Rows of blocks whose id divides by ``every``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ids, vectors, codes, bounds, dim in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, w = np.frombuffer(ids, np.int64), dim * 8
                mine = np.flatnonzero(ids % every == 0).tolist()
                if mine:
                    yield _record([(block << 16 | k, int(ids[k]), vectors[k * w : k * w + w], codes[k * dim : k * dim + dim], bounds[k * 16 : k * 16 + 16], dim) for k in mine], _QUERY)

    return arrow_map(blocks, rows, _QUERY)


def quantised(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scale of each vector, and the sum of its decoded components' magnitudes."""
    scale = np.abs(v).max(axis=1) / 127
    scale[scale == 0] = np.finfo(np.float64).tiny
    codes = np.rint(v / scale[:, None]).clip(-127, 127).astype(np.int8)
    return codes, scale, np.abs(codes.astype(np.float64)).sum(axis=1) * scale


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of paired rows in double precision, components added in order."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j] * b[:, j]
    return total


def tile_bounds(q: np.ndarray, q_bounds: np.ndarray, c: np.ndarray, c_bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the inner products of a tile, from codes, scales and weights.

    Sums of int8 products stay under 2 ** 24 for up to 1,040 components, so single
    precision holds them exactly; longer vectors use double precision.
    """
    d = q.shape[1]
    kind = np.float32 if d <= 1040 else np.float64
    (qs, qw), (cs, cw) = q_bounds.T, c_bounds.T
    product = (q.astype(kind) @ c.astype(kind).T).astype(np.float64) * qs[:, None] * cs
    # |xy - x'y'| <= |x'| e_y + |y'| e_x + d e_x e_y with e = half a step of the scale
    error = (0.5 * (qw[:, None] * cs + qs[:, None] * cw) + 0.25 * d * qs[:, None] * cs) * (1 + 1e-9)
    return product - error, product + error


def tile_survivors(low: np.ndarray, high: np.ndarray, best: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose upper bound is not below the query's k-th lower bound; ``best`` holds each query's k largest ones and is brought up to date."""
    both = np.concatenate((best, low), axis=1)
    best[:] = -np.partition(-both, k - 1, axis=1)[:, :k]
    return np.nonzero(high >= best.min(1)[:, None])


def _array(rows: list, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(rows), kind).reshape(-1, width)


def candidates(tiles: DataFrame, k: int) -> DataFrame:
    """Surviving pairs (see _PAIR) of tiles sorted by group; a dense tile is one row without ``row``."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, kept = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            floor = best.min(1)
            for q, r, h in kept:
                stay = h >= floor[q]
                if stay.any():
                    n, q = int(stay.sum()), q[stay]
                    none = pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())
                    yield pa.record_batch([pa.array(rows[q]), pa.array(r[stay]), pa.array(h[stay]), pa.array(floor[q]), *none], names=[f.split()[0] for f in _PAIR.split(", ")])

        for batch in batches:
            for g, qrows, qcodes, qbounds, block, c_codes, c_bounds, dim in zip(*(batch.column(n).to_pylist() for n in ("group", "rows", "q_codes", "q_bounds", "block", "codes", "bounds", "dim")), strict=True):
                if g != group:
                    if group is not None:
                        yield from flush()
                    group, kept, rows = g, [], np.array(qrows, np.int64)
                    q, qb, best = _array(qcodes, np.int8, dim), _array(qbounds, np.float64, 2), np.full((len(rows), k), -np.inf)
                c, cb = np.frombuffer(c_codes, np.int8).reshape(-1, dim), np.frombuffer(c_bounds, np.float64).reshape(-1, 2)
                found, before = [], best.copy()
                for at in range(0, len(rows), SLICE):
                    low, high = tile_bounds(q[at : at + SLICE], qb[at : at + SLICE], c, cb)
                    own = np.flatnonzero(rows[at : at + SLICE] >> 16 == block)  # a query is no candidate of its own
                    low[own, rows[at + own] & 0xFFFF] = high[own, rows[at + own] & 0xFFFF] = -np.inf
                    a, b = tile_survivors(low, high, best[at : at + SLICE], k)
                    there = high[a, b] > -np.inf
                    found.append((a[there] + at, (block << 16) + b[there], high[a, b][there]))
                if sum(len(f[0]) for f in found) > DENSE * k * len(rows):
                    best = before  # its own bounds stay out: the pairs behind them are not among the survivors
                    yield _record([(None, None, None, None, g, block)], _PAIR)
                else:
                    kept += found
                if len(kept) > 1024:
                    floor = best.min(1)
                    whole = [np.concatenate(x) for x in zip(*kept, strict=True)]
                    stay = whole[2] >= floor[whole[0]]
                    kept = [tuple(x[stay] for x in whole)]
        if group is not None:
            yield from flush()

    return arrow_map(tiles.repartition("group", "block").sortWithinPartitions("group"), search, _PAIR)


class Heaps:
    """The k largest (score, then smaller id) of each query row."""

    def __init__(self, k: int):
        self.k, self.best = k, {}

    def add(self, row: int, query_id: int, vec_id: int, score: float) -> None:
        heap = self.best.setdefault((row, query_id), [])
        if len(heap) < self.k:
            heapq.heappush(heap, (score, -vec_id))
        elif (score, -vec_id) > heap[0]:
            heapq.heapreplace(heap, (score, -vec_id))

    def taken(self) -> Iterator[pa.RecordBatch]:
        rows = [(row, query_id, -v, s) for (row, query_id), heap in self.best.items() for s, v in heap]
        self.best = {}
        if rows:
            yield _record(rows, _TOP)


def exact_pairs(pairs: DataFrame, k: int) -> DataFrame:
    """The k best of each query among (row, query_id, vector, vec_id, c_vector, dim), in double precision."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps, last = Heaps(k), None
        for batch in batches:
            if not batch.num_rows:
                continue
            row, query_id, vec_id = (batch.column(n).to_pylist() for n in ("row", "query_id", "vec_id"))
            dim = batch.column("dim")[0].as_py()
            a, b = (_array(batch.column(n).to_pylist(), np.float64, dim) for n in ("vector", "c_vector"))
            for r, i, v, s in zip(row, query_id, vec_id, exact_products(a, b).tolist(), strict=True):
                if r != last:
                    yield from heaps.taken()
                    last = r
                heaps.add(r, i, v, s)
        yield from heaps.taken()

    return arrow_map(pairs.repartition("row").sortWithinPartitions("row"), search, _TOP)


def exact_tiles(tiles: DataFrame, k: int) -> DataFrame:
    """The k best of each query of dense tiles, from the original vectors of both blocks."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, q_ids, q_vectors, block, ids, vectors, dim in zip(*(batch.column(n).to_pylist() for n in ("rows", "q_ids", "q_vectors", "block", "ids", "vectors", "dim")), strict=True):
                q, c, ids, heaps = _array(q_vectors, np.float64, dim), np.frombuffer(vectors, np.float64).reshape(-1, dim), np.frombuffer(ids, np.int64), Heaps(k)
                for at, (row, query_id) in enumerate(zip(rows, q_ids, strict=True)):
                    score = exact_products(np.broadcast_to(q[at], c.shape), c)
                    if row >> 16 == block:
                        score[row & 0xFFFF] = -np.inf
                    floor = np.partition(score, -k)[-k] if len(score) > k else -np.inf
                    near = np.flatnonzero((score >= floor) & (score > -np.inf))
                    for n in near[np.lexsort((ids[near], -score[near]))][:k].tolist():
                        heaps.add(row, query_id, int(ids[n]), float(score[n]))
                yield from heaps.taken()

    return arrow_map(tiles, search, _TOP)


def nearest(df: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each row whose id divides by ``every``."""
    blocks = written(packed(usable(df, id_col, vec_col), CANDIDATE_BLOCK), "blocks")
    asked = written(unpacked(blocks, every), "queries")
    groups = max(1, -(-asked.count() // QUERY_BLOCK))
    grouped = asked.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int"))

    def gathered(*columns: str) -> DataFrame:
        """About QUERY_BLOCK queries a group, side by side."""
        together = grouped.groupBy("group").agg(F.collect_list(F.struct("row", *columns)).alias("q"))
        return together.select("group", F.col("q.row").alias("rows"), *[F.col(f"q.{c}").alias(f"q_{c}") for c in columns])

    every_group = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group")
    tiles = blocks.select("block", "codes", "bounds", "dim", every_group).join(gathered("codes", "bounds"), "group")
    found = written(candidates(tiles, k), "candidates")
    pairs = found.where("row IS NOT NULL").withColumn("floor", F.max("floor").over(W.partitionBy("row"))).where("high >= floor").select("row", "c_row")
    vectors = unpacked(blocks, 1).select(F.col("row").alias("c_row"), "vec_id", F.col("vector").alias("c_vector"))
    own = asked.select("row", F.col("vec_id").alias("query_id"), "vector", "dim")
    exact = exact_pairs(pairs.join(vectors, "c_row").join(own, "row"), k)
    dense = found.where("row IS NULL").select("group", F.col("c_block").alias("block"))
    q = gathered("vec_id", "vector").withColumnsRenamed({"q_vec_id": "q_ids", "q_vector": "q_vectors"})
    again = exact_tiles(dense.join(blocks.select("block", "ids", "vectors", "dim"), "block").join(q, "group").repartition("group", "block"), k)
    order = W.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return exact.unionAll(again).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
