"""Pairs within a group, searched in blocks: no pair but the best of each row leaves a task.

A group of n rows is cut into blocks of about ``BLOCK`` rows by a hash of their ids;
each row goes once to every pair of blocks it belongs to, so a hot group is spread
over many tasks and a task holds two blocks. Rows travel n / BLOCK times.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from knotwork.operators.order import dealt_join, numbered
from knotwork.sources.shared import kept

BLOCK = 2048
#: Rows that ask in one task while a key's rows pass by, and distances and near pairs held at once.
ASK_BLOCK, MET_AT_ONCE, HITS_AT_ONCE = 16_384, 4_000_000, 200_000
#: Words of rows are compared in blocks: so many common ones as bits, rows at least and words at most in a right block,
#: and blocks of each side where rows are enough.
COLUMNS, WORD_BLOCK, BLOCK_CODES, LEFT_BLOCKS, RIGHT_BLOCKS = 512, 512, 16_000_000, 5, 8
#: Units asked for up to this number (of a few characters or a word each) are sent to every task.
FEW_UNITS = 20_000
#: Most characters of a gram; grams asked for are known by 2^SLOTS slots; texts are searched in chunks of about so many characters.
GRAM, SLOTS, CHUNK = 8, 26, 500_000


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, list[int]]]:
    """Tables of whole groups and the groups' bounds in them; the input is sorted by the keys."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        bounds = _bounds(held, keys)
        if len(bounds) > 2:
            yield held.slice(0, bounds[-2]).combine_chunks(), bounds[:-1]
            held = held.slice(bounds[-2])
    if held is not None:
        yield held.combine_chunks(), _bounds(held, keys)


def _bounds(table: pa.Table, keys: list[str]) -> list[int]:
    change = np.zeros(table.num_rows, bool)
    change[0] = True
    for k in keys:
        values = table.column(k).combine_chunks().dictionary_encode()
        codes = (values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values).indices.fill_null(-1).to_numpy(zero_copy_only=False)
        change[1:] |= codes[1:] != codes[:-1]
    return [*np.flatnonzero(change).tolist(), table.num_rows]


def _least(distance: np.ndarray, a: np.ndarray, b: np.ndarray, most: float, each: int) -> tuple[np.ndarray, ...]:
    """(a, b, distance) of up to ``each`` columns under ``most`` for each row, nearest first; of equal ones the earlier column."""
    rows, out = np.arange(len(a)), []
    for _ in range(min(each, len(b))):
        k = distance.argmin(1)
        d = distance[rows, k]
        hit = d < most
        if not hit.any():
            break
        out.append((a[hit], b[k[hit]], d[hit]))
        distance[rows, k] = np.inf
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (a[:0], b[:0], np.empty(0))


def nearest_pairs(rows: DataFrame, most: float, each: int, later_only: bool = True) -> DataFrame:
    """(key, a, b, distance) of (key, id, v): for each a the ``each`` nearest b of its key by cosine distance under ``most``.

    ``later_only``: only b with a larger id. With a column ``asked`` only rows that are
    asked meet only rows that aren't. Vectors of different lengths don't meet; those that
    are null, zero or hold null, NaN or infinite components meet none. Ties go to the
    smaller b.
    """
    keys = ["key", "dim"]
    told = "asked" in rows.columns
    sized = rows.select("key", "id", F.col("v").cast("array<double>").alias("v"), F.size("v").alias("dim"), F.col("asked") if told else F.lit(False).alias("asked"))
    v = F.col("v")
    sized = sized.where(v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0.0))
    counts = sized.groupBy(*keys).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n")).withColumnsRenamed({"key": "_k", "dim": "_d"})
    joined = sized.join(counts, F.col("key").eqNullSafe(F.col("_k")) & (F.col("dim") == F.col("_d")))
    own = joined.withColumn("own", F.pmod(F.xxhash64("id"), "n").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    dealt = own.select("key", "dim", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "id", "v", "asked")
    group = [*keys, "i", "j"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in _groups(batches, group):
            ids, side = table.column("id").to_numpy(), table.column("side").to_numpy()
            i, j, asked = table.column("i").to_numpy(), table.column("j").to_numpy(), table.column("asked").to_numpy()
            lists = table.column("v").combine_chunks()
            flat, starts = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            for a, b in zip(bounds, bounds[1:], strict=False):
                if b - a < 2:
                    continue
                v = flat[starts[a] : starts[b]].reshape(b - a, -1)
                v = v / np.sqrt((v * v).sum(1))[:, None]
                same = i[a] == j[a]
                cut = b - a if same else int(np.searchsorted(side[a:b], 1))
                found = []
                pairs = [(slice(0, cut), slice(0, cut))] if same else [(slice(0, cut), slice(cut, b - a)), (slice(cut, b - a), slice(0, cut))]
                for x, y in pairs:
                    p, q = ids[a:b][x], ids[a:b][y]
                    if len(p) and len(q):
                        d = 1 - v[x] @ v[y].T
                        d[(p[:, None] >= q) if later_only else (p[:, None] == q)] = np.inf
                        if told:
                            d[~asked[a:b][x][:, None] | asked[a:b][y]] = np.inf
                        found.append(_least(d, p, q, most, each))
                if found and sum(len(f[0]) for f in found):
                    p, q, d = (np.concatenate(c) for c in zip(*found, strict=True))
                    yield pa.record_batch([pa.array([table.column("key")[a].as_py()] * len(p), table.schema.field("key").type), pa.array(p), pa.array(q), pa.array(d)], names=["key", "a", "b", "distance"])

    kind = rows.schema["key"].dataType.simpleString()
    best = dealt.repartition(*group).sortWithinPartitions(*group, "side", "id").mapInArrow(search, f"key {kind}, a long, b long, distance double")
    top = F.row_number().over(W.partitionBy("key", "a").orderBy("distance", "b"))
    return best.withColumn("_n", top).where(F.col("_n") <= each).drop("_n")


class _Nearest:
    """For rows that ask, the ``each`` nearest of those they meet, which come by rising id; of equal distances the lower ids."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, neg: np.ndarray, most: float, each: int):
        self.own, self.v, self.neg, self.most, self.each, self.short = ids, v, neg, most, each, v.astype(np.float32)
        self.distance = np.full((len(ids), each), np.inf)
        self.ids, self.negs = np.zeros((len(ids), each), np.int64), np.zeros((len(ids), each), bool)

    def meet(self, ids: np.ndarray, v: np.ndarray, neg: np.ndarray) -> None:
        k, step = 0, 16
        while k < len(ids):
            step = max(1, min(2 * step, 1024, MET_AT_ONCE // len(self.own)))
            bound = np.minimum(self.distance[:, -1], self.most)
            some, own_ids, own_neg = v[k : k + step], ids[k : k + step], neg[k : k + step]
            # single precision tells which pairs are looked at
            rows, places = np.nonzero(self.short @ some.astype(np.float32).T > (1 - bound - 1e-4).astype(np.float32)[:, None])
            for x in range(0, len(rows), HITS_AT_ONCE):
                row, at = rows[x : x + HITS_AT_ONCE], places[x : x + HITS_AT_ONCE]
                d = np.round(1 - (self.v[row] * some[at]).sum(1), 12)  # equal vectors stay equal
                hit = (d < bound[row]) & (self.own[row] != own_ids[at])
                if hit.any():
                    self._put(row[hit], d[hit], own_ids[at[hit]], own_neg[at[hit]])
            k += step

    def _put(self, row: np.ndarray, d: np.ndarray, ids: np.ndarray, neg: np.ndarray) -> None:
        rows, place = np.unique(row, return_inverse=True)
        there = np.nonzero(np.isfinite(self.distance[rows]))
        old = rows[there[0]], there[1]
        place, d = np.concatenate((there[0], place)), np.concatenate((self.distance[old], d))
        ids, neg = np.concatenate((self.ids[old], ids)), np.concatenate((self.negs[old], neg))
        order = np.lexsort((ids, d, place))
        place, d, ids, neg = place[order], d[order], ids[order], neg[order]
        rank = np.arange(len(place)) - np.searchsorted(place, place)
        first = rank < self.each
        into = rows[place[first]], rank[first]
        self.distance[rows] = np.inf
        self.distance[into], self.ids[into], self.negs[into] = d[first], ids[first], neg[first]

    def opposed(self, limit: int) -> tuple[np.ndarray, ...]:
        """(a, b, distance), a < b, of pairs of opposite ``neg``: all that can be among the ``limit`` first by falling confidence, a and b."""
        row, at = np.nonzero(np.isfinite(self.distance) & (self.negs != self.neg[:, None]))
        d, p, q = self.distance[row, at], self.own[row], self.ids[row, at]
        a, b = np.minimum(p, q), np.maximum(p, q)
        order = np.lexsort((d, b, a))
        a, b, d = a[order], b[order], d[order]
        first = np.ones(len(a), bool)
        first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        a, b, d = a[first], b[first], d[first]
        # confidence has four digits; where they may be rounded either way, the pair stays
        points = np.minimum((1 - d) * 1.1, 0.99) * 1e4 + 0.5
        low, unsure = np.floor(points - 1e-6), np.floor(points - 1e-6) != np.floor(points + 1e-6)
        stays = unsure.copy()
        stays[np.lexsort((b, a, -low))[: limit + int(unsure.sum())]] = True
        return a[stays], b[stays], d[stays]


def opposed_pairs(rows: DataFrame, most: float, each: int, limit: int) -> DataFrame:
    """(key, a, b, distance) with a < b: pairs of opposite ``neg``, one of them among the ``each`` nearest of the other under ``most``.

    ``rows``: (key, dim, n, id, v, neg), where n is the key's rows over ``ASK_BLOCK``, rounded up. All
    pairs that can be among a key's ``limit`` best are there. A task holds one block of rows that ask,
    and the key's rows pass by; a row travels n + 1 times, and only the best pairs of a block leave it.
    """
    part, group = F.pmod(F.xxhash64("id"), "n").cast("int"), ["key", "dim", "part"]
    roles = F.concat(F.array(F.struct(part.alias("part"), F.lit(0).alias("role"))), F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.struct(k.alias("part"), F.lit(1).alias("role"))))
    dealt = rows.select("key", "dim", "id", "v", "neg", F.inline(roles))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, asking, near = None, [], None

        def found() -> Iterator[pa.RecordBatch]:
            a, b, d = near.opposed(limit) if near is not None else ([], [], [])
            if len(a):
                yield pa.record_batch([pa.array([at[0]] * len(a), pa.int64()), pa.array(a), pa.array(b), pa.array(d)], names=["key", "a", "b", "distance"])

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            bounds = _bounds(table, [*group, "role"])
            ids, neg, role = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "neg", "role"))
            lists = batch.column("v")
            flat, starts = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            for x, y in zip(bounds, bounds[1:], strict=False):
                now = tuple(batch.column(c)[x].as_py() for c in group)
                if now != at:
                    yield from found()
                    at, asking, near = now, [], None
                v = flat[starts[x] : starts[y]].reshape(y - x, -1).astype(np.float64)
                run = ids[x:y], v / np.sqrt((v * v).sum(1))[:, None], neg[x:y].astype(bool)
                if role[x] == 0:
                    asking.append(run)
                    continue
                if near is None and asking:
                    near = _Nearest(*(np.concatenate(c) for c in zip(*asking, strict=True)), most, each)
                if near is not None:
                    near.meet(*run)
        yield from found()

    best = dealt.repartition(*group).sortWithinPartitions(*group, "role", "id").mapInArrow(search, "key long, a long, b long, distance double")
    return best.groupBy("key", "a", "b").agg(F.min("distance").alias("distance"))


def _coded(both: DataFrame) -> DataFrame:
    """(side, row, id, codes): words of (side, row, id, words) as numbers by falling frequency; words of one side only are left out."""
    each = both.select("side", "row", "id", F.explode(F.array_distinct("words")).alias("word"))
    counts = each.groupBy("word").agg(F.count("*").alias("n"), F.min("side").alias("a"), F.max("side").alias("b")).where("a < b")
    codes = kept(numbered(counts.select("word", "n"), F.desc("n"), F.asc("word"), name="code").select("word", (F.col("code") - 1).cast("int").alias("code")))
    # common words, up to a bound, go to every task; the rest is dealt by word
    common = F.broadcast(codes.where(F.col("code") < FEW_UNITS).withColumnRenamed("code", "common"))
    told = kept(each.join(common, "word", "left").select("side", "row", "id", "common", F.when(F.col("common").isNull(), F.col("word")).alias("word")))
    rare = dealt_join(told.where("common IS NULL"), codes.where(F.col("code") >= FEW_UNITS), "word").select("side", "row", "id", "code")
    all_ = told.where("common IS NOT NULL").select("side", "row", "id", F.col("common").alias("code")).unionAll(rare)
    return all_.groupBy("side", "row", "id").agg(F.sort_array(F.collect_list("code")).alias("codes"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ascending codes of a row as bytes: the gaps between them, seven bits a byte, the last byte of each below 128."""
    for batch in batches:
        lists = batch.column("codes")
        starts, codes = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        gaps = codes.copy()
        gaps[1:] -= codes[:-1]
        first = starts[:-1][np.diff(starts) > 0]
        gaps[first] = codes[first]
        size = 1 + sum((gaps >= 1 << k).astype(np.int64) for k in (7, 14, 21, 28))
        ends = np.concatenate(([0], np.cumsum(size)))
        out = np.zeros(ends[-1], np.uint8)
        for k in range(5):
            some = size > k
            out[ends[:-1][some] + k] = (gaps[some] >> 7 * k & 127) | ((size[some] > k + 1) << 7)
        packed = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(ends[starts].astype(np.int32)), pa.py_buffer(out)])
        yield pa.record_batch([batch.column(c) for c in ("side", "row", "id")] + [pa.array(np.diff(starts).astype(np.int32)), packed], names=["side", "row", "id", "n", "codes"])


def _unpacked(packed: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, starts) of rows that ``_packed`` made."""
    offsets = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1]
    data = np.frombuffer(packed.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    last = np.flatnonzero(data < 128)
    first = np.concatenate(([0], last[:-1] + 1)) if len(last) else last
    gaps = data[first].astype(np.int64) & 127
    for k in range(1, int((last - first).max(initial=0)) + 1):
        some = last - first >= k
        gaps[some] |= (data[first[some] + k].astype(np.int64) & 127) << 7 * k
    starts = np.searchsorted(last, offsets - offsets[0])
    before = np.concatenate(([0], np.cumsum(gaps)))
    return (before[1:] - np.repeat(before[starts[:-1]], np.diff(starts))).astype(np.int32), starts


class _Words:
    """Rows of ascending codes, for counting what each has in common with another row: common codes are bits, the others have postings."""

    def __init__(self, codes: np.ndarray, starts: np.ndarray, columns: int):
        self.n, self.columns, width = len(starts) - 1, columns, -(-columns // 64) * 64
        row = np.repeat(np.arange(self.n, dtype=np.int32), np.diff(starts))
        head = codes < columns
        dense = np.zeros((self.n, width), bool)
        dense[row[head], codes[head]] = True
        self.bits = np.packbits(dense, axis=1).view(np.uint64)
        self.heads = dense.sum(1, dtype=np.int32)
        tail = codes[~head]
        order = np.argsort(tail, kind="stable")
        self.rows = row[~head][order]
        self.known, first = np.unique(tail[order], return_index=True)
        self.bounds = np.append(first, len(tail))

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Places of the codes among those that have postings; -1 where they have none."""
        at = np.minimum(np.searchsorted(self.known, codes), len(self.known) - 1)
        return np.where(self.known[at] == codes, at, -1) if len(self.known) else np.full(len(codes), -1)

    def best(self, query: np.ndarray, at: np.ndarray, ids: np.ndarray, least: int, each: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts of the ``each`` ids with most codes of the query in common, ``least`` at least; ``at`` are the codes' places."""
        cut = int(np.searchsorted(query, self.columns))
        lists = [self.rows[self.bounds[k] : self.bounds[k + 1]] for k in at[at >= 0].tolist()]
        count = np.bincount(np.concatenate(lists), minlength=self.n) if lists else np.zeros(self.n, np.int64)
        most = count + np.minimum(self.heads, cut)
        dense = np.zeros(self.bits.shape[1] * 64, bool)
        dense[query[:cut]] = True
        own = np.packbits(dense).view(np.uint64)
        exact = lambda rows: count[rows] + np.bitwise_count(self.bits[rows] & own).sum(1, dtype=np.int64)
        # the rows that look best give a bound that the others have to reach
        above = np.cumsum(np.bincount(most)[::-1])
        tried = np.flatnonzero(most >= len(above) - 1 - int(np.searchsorted(above, min(4 * each, self.n))))
        shared = np.sort(_one_an_id(ids[tried], exact(tried))[1])[::-1]
        bound = max(least, int(shared[each - 1]) if len(shared) >= each else 0)
        rows = np.flatnonzero(most >= bound)
        found = exact(rows)
        rows, found = rows[found >= bound], found[found >= bound]
        own_ids, found = _one_an_id(ids[rows], found)
        first = np.lexsort((own_ids, -found))[:each]
        return own_ids[first], found[first]


def _one_an_id(ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids with their largest counts."""
    order = np.lexsort((-count, ids))
    ids, count = ids[order], count[order]
    first = np.ones(len(ids), bool)
    first[1:] = ids[1:] != ids[:-1]
    return ids[first], count[first]


def shared_words(left: DataFrame, right: DataFrame, least: int, each: int) -> DataFrame:
    """(left_id, right_id, shared): for each left row's id the ``each`` right ids with most words in common, ``least`` at least.

    Both: (id, words); several rows may share an id, and the best pair of them
    counts. Words travel as numbers, packed, and right blocks hold up to ``BLOCK_CODES`` of
    them, so a row goes to few tasks; left rows pass by, in blocks whose number does not grow.
    In a task counts are exact only for rows whose rare words, and all common ones that
    they can share, reach the best counts known.
    """
    numbered_rows = lambda df, side: df.select(F.lit(side).alias("side"), F.monotonically_increasing_id().alias("row"), "id", "words")
    coded = _coded(kept(numbered_rows(left, 1).unionAll(numbered_rows(right, 0))))
    rows = kept(coded.mapInArrow(_packed, "side int, row long, id long, n int, codes binary"))
    sizes = {r.side: (r.rows, r.codes) for r in rows.groupBy("side").agg(F.count("*").alias("rows"), F.sum("n").alias("codes")).collect()}
    few = lambda side, most: min(most, -(-sizes.get(side, (0, 0))[0] // WORD_BLOCK))
    n_left, n_right = max(1, few(1, LEFT_BLOCKS)), max(1, -(-sizes.get(0, (0, 0))[1] // BLOCK_CODES), few(0, RIGHT_BLOCKS))

    def dealt(side: int, mine: str, n: int, other: str, m: int) -> DataFrame:
        own = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
        return rows.where(F.col("side") == side).select(own.alias(mine), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other), "side", "id", "codes").select("i", "j", "side", "id", "codes")

    both = dealt(1, "i", n_left, "j", n_right).unionAll(dealt(0, "j", n_right, "i", n_left))
    columns = COLUMNS

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, words, known = None, [], None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            bounds = _bounds(pa.Table.from_batches([batch]), ["i", "j", "side"])
            for a, b in zip(bounds, bounds[1:], strict=False):
                now, own = (batch.column("i")[a].as_py(), batch.column("j")[a].as_py()), batch.slice(a, b - a)
                if now != at:
                    at, held, words = now, [], None
                ids, (flat, starts) = own.column("id").to_numpy(), _unpacked(own.column("codes"))
                if own.column("side")[0].as_py() == 0:
                    held.append((ids, flat, np.diff(starts)))
                    continue
                if not held and words is None:
                    continue
                if words is None:
                    known, codes, sizes_ = (np.concatenate(c) for c in zip(*held, strict=True))
                    words, held = _Words(codes, np.concatenate(([0], np.cumsum(sizes_))), columns), []
                places = words.find(flat)
                found = [(i, *words.best(flat[x:y], places[x:y], known, least, each)) for i, x, y in zip(ids.tolist(), starts.tolist(), starts[1:].tolist(), strict=False)]
                p = np.repeat(ids, [len(f[1]) for f in found])
                if len(p):
                    yield pa.record_batch([pa.array(p), pa.array(np.concatenate([f[1] for f in found])), pa.array(np.concatenate([f[2] for f in found]))], names=["left_id", "right_id", "shared"])

    found = both.repartition(n_left * n_right, "i", "j").sortWithinPartitions("i", "j", "side", "id").mapInArrow(search, "left_id long, right_id long, shared long")
    best = found.groupBy("left_id", "right_id").agg(F.max("shared").alias("shared"))
    top = F.row_number().over(W.partitionBy("left_id").orderBy(F.desc("shared"), "right_id"))
    return best.withColumn("_n", top).where(F.col("_n") <= each).drop("_n")


def _windows(texts: list[str], sizes: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, slots, whole): for each size the slot of the n characters from each place of the texts (a line each), and where they are of one word."""
    points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    place = np.arange(len(points))
    ends = np.minimum.accumulate(np.where((points == 32) | ((points >= 9) & (points <= 13)), place, len(points))[::-1])[::-1]
    room, values = ends - place, np.zeros(len(points), np.uint64)
    for n in range(1, max(sizes, default=0) + 1):
        if n > len(points):
            break
        values = values[: len(points) - n + 1] * np.uint64(6364136223846793005) + points[n - 1 :] + np.uint64(1)
        if n in sizes:
            mixed = (values ^ (values >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
            yield n, (mixed >> np.uint64(64 - SLOTS)).astype(np.int64), room[: len(values)] >= n


def _chunks(values: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Neighbours of together up to some ``CHUNK`` characters, with the first one's place."""
    at, held = 0, 0
    for k, v in enumerate(values):
        held += len(v or "") + 1
        if held > CHUNK:
            yield at, [x or "" for x in values[at : k + 1]]
            at, held = k + 1, 0
    if at < len(values):
        yield at, [x or "" for x in values[at:]]


def _grams_held(texts: DataFrame, wanted: DataFrame, sizes: list[int]) -> DataFrame:
    """(text_id, unit): which of (unit), of the given sizes, stand within a word of (text_id, text).

    A bitmap of the units' slots, of one size at every scale, goes to every task, so that
    nearly no other gram leaves it.
    """

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, units in _chunks(batch.column("unit").to_pylist()):
                first = np.concatenate(([0], np.cumsum([len(u) + 1 for u in units])[:-1]))
                size = np.array([len(u) for u in units])
                for n, at, _ in _windows(units, sizes):
                    yield pa.record_batch([pa.array(np.unique(at[first[size == n]]))], names=["slot"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            at = batch.column("slot").to_numpy()
            for part in np.unique(at >> 16).tolist():
                found.setdefault(part, np.zeros(1 << 16, bool))[at[at >> 16 == part] & 0xFFFF] = True
        if found:
            yield pa.record_batch([pa.array(list(found)), pa.array([np.packbits(f).tobytes() for f in found.values()], pa.binary())], names=["part", "bits"])

    parts = wanted.select("unit").mapInArrow(slots, "slot long").distinct().repartition(F.col("slot").bitwiseAND(F.lit(-1 << 16))).mapInArrow(packed, "part long, bits binary").collect()  # SLOTS bits at most
    bits = np.zeros((1 << SLOTS - 16, 1 << 13), np.uint8)
    for r in parts:
        bits[r.part] = np.frombuffer(r.bits, np.uint8)
    shared = texts.sparkSession.sparkContext.broadcast(bits.ravel())

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            ids = batch.column("text_id")
            for at, part in _chunks(batch.column("text").to_pylist()):
                line, first = "\n".join(part), np.cumsum([0, *[len(t) + 1 for t in part]])
                met = set()
                for n, slot, whole in _windows(part, sizes):
                    hits = np.flatnonzero(whole & asked[slot])
                    owners = np.searchsorted(first, hits, side="right") - 1
                    met.update((o, line[k : k + n]) for o, k in zip(owners.tolist(), hits.tolist(), strict=True))
                if met:
                    yield pa.record_batch([ids.take(pa.array([at + o for o, _ in met])), pa.array([u for _, u in met], pa.string())], names=["text_id", "unit"])

    kind = texts.schema["text_id"].dataType.simpleString()
    return texts.select("text_id", "text").mapInArrow(search, f"text_id {kind}, unit string")


def by_rarest(texts: DataFrame, units: Column | list[int], asked: DataFrame) -> DataFrame:
    """(needle, text_id): texts that hold the rarest unit of a needle of ``asked`` (needle, unit).

    ``units`` is the array of a text's units, or the sizes of grams. Texts are read twice,
    first to count the units that are asked, then for the rarest of each needle; nearly no
    other unit leaves a task. A needle with a unit that no text holds meets none.
    """

    def held(wanted: DataFrame) -> DataFrame:
        few = wanted.limit(FEW_UNITS + 1).count() <= FEW_UNITS
        found = _grams_held(texts, wanted, units) if isinstance(units, list) else texts.select("text_id", F.explode(F.array_distinct(units)).alias("unit"))
        return found.join(F.broadcast(wanted), "unit", "left_semi") if few else dealt_join(found, wanted, "unit", "left_semi")

    asked = kept(asked.select("needle", "unit").distinct())
    counts = held(asked.select("unit").distinct()).groupBy("unit").agg(F.count("*").alias("n"))
    rarest = dealt_join(asked, counts, "unit", "left").groupBy("needle").agg(F.min_by("unit", F.struct("n", "unit")).alias("unit"), F.count_if(F.col("n").isNull()).alias("unknown"))
    known = kept(rarest.where("unknown = 0").select("needle", "unit"))
    return dealt_join(known, held(kept(known.select("unit").distinct())), "unit").select("needle", "text_id")


def containing(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """(needle, text_id): which of (text_id, text) hold which of (needle) as a substring; both in one case already.

    A needle meets only the texts that hold its rarest gram (a word, or ``GRAM``
    characters of a longer one), which are then tested; a needle with a gram that no
    text holds meets none.
    """
    parts = kept(needles.where(F.trim("needle") != "").select("needle", F.filter(F.split("needle", r"\s+"), lambda w: w != "").alias("words")).distinct())
    # words of one or two characters count where a needle has no longer ones
    telling = F.filter("words", lambda w: F.length(w) >= F.least(F.lit(3), F.array_max(F.transform("words", F.length))))
    size = lambda w: F.least(F.length(w), F.lit(GRAM))
    sizes = sorted(r.n for r in parts.select(F.explode(F.transform(telling, size)).alias("n")).distinct().collect())  # up to GRAM numbers
    grams = lambda w, n: F.when(F.length(w) >= n, F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: F.substring(w, i, n))).otherwise(F.expr("array()").cast("array<string>"))
    candidates = by_rarest(texts, sizes, parts.select("needle", F.explode(F.flatten(F.transform(telling, lambda w: grams(w, size(w))))).alias("unit")))
    return dealt_join(candidates, texts, "text_id").where(F.contains(F.col("text"), F.col("needle"))).select("needle", "text_id")
