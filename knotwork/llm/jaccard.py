"""Similarity self-join on word n-grams by chosen paths.

A document's set holds the hashes of its runs of five words (words are runs of
anything but ASCII white space; a shorter text has one run of all its words).
Documents with equal sets are one class and are handled as one set. In each run a
set chooses tokens with probability 1 / (threshold x size), by a hash that all
sets share; sets that choose the same token meet in a bucket. A bucket that is
too large is split again on further tokens along its path, unless splitting
stalls, as it does for large groups of near copies. Buckets are then searched by
brute force, large ones in pairs of blocks, so no task holds a whole one. Runs
are repeated until a pair at the threshold is missed with probability 1 - recall
at most: all sets take the runs that unsplit buckets ask for, and sets that stood
in a bucket that was split take as many more as the deepest split asks for.

A pair that meets in several buckets belongs to the least of them. Brute force
first compares 32-bin sketches and passes on only the sets with a plausible
partner; those sets are then compared in full. Sets hold 32-bit hashes: of a text
of 20,000 words two runs share one with a chance of 5 %, and its set is then smaller
by one. Links are counted and joined into components without listing a group's pairs.
Tokens stay where they are made: sets follow the paths of large buckets in place,
and only sets with a plausible partner are shuffled whole.

Defined cases: a null text is empty; an empty text has no links and a class of
its own; a null doc_id takes part and counts as the largest id (class_id is null
if all ids of a class are); rows that repeat an id are documents each; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.llm.common import arrow_map, batches_by_key, join_groups, row_of, sized_batches, utf8, with_row, written
from knotwork.llm.components import components
from knotwork.llm.linear import each_slice
from knotwork.llm.words import mix, plain_table, shingles, word_hashes

WIDTH, THRESHOLD, RECALL = 5, 0.8, 0.9995
#: Sets in a bucket that is searched whole; levels of splitting; share of a bucket at which splitting stalls.
SMALL, LEVELS, STALL = 4096, 5, 0.7
#: Sets in a block of a large bucket; bins of a sketch and the agreement that makes a partner plausible.
BLOCK, BINS, PLAUSIBLE = 4096, 32, 0.5
ROWS_A_TASK, _TILE, _COLUMNS = 1 << 15, 1024, 8192
_SETS = "uid long, doc_id long, key binary, n long, paths array<long>, later array<array<long>>, sketch binary, tokens binary"
_U = np.uint64


def runs_needed(threshold: float, recall: float, levels: int = 1) -> int:
    """Runs that reach the recall for every pair at the threshold, whose buckets may be split up to ``levels`` deep.

    A pair shares t / (1 + t) of both sizes together, at least t times the larger
    size if one set holds the other; the larger set chooses with probability
    1 / (t n), so one common choice a level is expected at least. A pair must meet
    at every level down to the bucket that is searched: the runs are as many as the
    deepest one asks for.
    """
    survival = 1.0
    for _ in range(levels - 1):
        survival = 1 - math.exp(-survival)
    return max(1, math.ceil(-math.log(1 - recall) / survival))


def chosen(tokens: np.ndarray, path: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Whether a set on ``path`` splits on each token."""
    return mix(tokens.astype(_U) * _U(0x9E3779B97F4A7C15) ^ path) < limit


def next_path(tokens: np.ndarray, path: np.ndarray) -> np.ndarray:
    return mix(mix(tokens.astype(_U) + _U(1)) + np.atleast_1d(path) * _U(0x9E3779B97F4A7C15))


def limits(n: np.ndarray, threshold: float) -> np.ndarray:
    return (np.minimum(1.0, 1 / (threshold * np.maximum(n, 1))) * float(2**64 - 2**12)).astype(_U)


def sketch(tokens: np.ndarray) -> bytes:
    """Least 16-bit value of the tokens in each bin; 65535 for none."""
    h = mix(tokens.astype(_U))
    out = np.full(BINS, 65535, np.uint16)
    np.minimum.at(out, (h >> _U(59)).astype(np.int64), ((h >> _U(20)) & _U(0xFFFF)).astype(np.uint16))
    return out.tobytes()


def token_sets(docs: DataFrame, threshold: float, recall: float, width: int, id_col: str, text_col: str, rows: bool) -> DataFrame:
    first = runs_needed(threshold, recall)
    runs = mix(np.arange(1, runs_needed(threshold, recall, LEVELS) + 1, dtype=_U))
    table = plain_table()
    names = [c.split()[0] for c in _SETS.split(", ")]

    def lists(values: list[np.ndarray]) -> pa.Array:
        flat = np.concatenate(values) if values else np.empty(0, np.int64)
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)), pa.array(flat, pa.int64()))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 33
        for batch in batches:
            uids, keys, sizes, sketches, raws = [], [], [], [], []
            by_run = [[] for _ in runs]
            for buf, offs, i, j in each_slice(batch.column(1)):
                h, _, row = word_hashes(buf, offs, table)
                s, row = shingles(h, row, j - i, width)
                s = (s >> _U(32)).astype(np.uint32)
                both = np.unique(row.astype(_U) << _U(32) | s)
                row, s = (both >> _U(32)).astype(np.int64), (both & _U(0xFFFFFFFF)).astype(np.uint32)
                ends = np.searchsorted(row, np.arange(j - i + 1))
                size = np.diff(ends)
                limit = limits(size, threshold)[row]
                for own, r in zip(by_run, runs, strict=True):
                    at = np.flatnonzero(chosen(s, r, limit))
                    path = next_path(s[at], r).view(np.int64)
                    cuts = np.searchsorted(row[at], np.arange(j - i + 1))
                    own += [path[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
                for k in range(j - i):
                    own = s[ends[k] : ends[k + 1]]
                    raw = own.tobytes()
                    for c, v in zip((uids, keys, sizes, sketches, raws), (uid, hashlib.blake2b(raw, digest_size=16).digest(), len(own), sketch(own), raw), strict=True):
                        c.append(v)
                    uid += 1
            n = len(uids)
            paths = lists([np.unique(np.concatenate([own[k] for own in by_run[:first]])) for k in range(n)])
            inner = lists([own[k] for k in range(n) for own in by_run[first:]])
            later = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (len(runs) - first)), inner)
            arrays = [pa.array(uids, pa.int64()), batch.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), paths, later, pa.array(sketches, pa.binary()), pa.array(raws, pa.binary())]
            more = {"row": batch.column(2)} if rows else {}
            yield pa.record_batch([*arrays, *more.values()], names=[*names, *more])

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *([row_of(docs)] if rows else []))
    return arrow_map(given, make, with_row(_SETS, docs, rows))


def among(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose ``uid`` is one of ``ids``, where they stand: a bit for each set goes to every task, so wide rows need no shuffle."""
    bits = ids.groupBy(F.bitmap_bucket_number("uid").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("uid")).alias("_bits"))
    at = F.bitmap_bit_position("uid")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = rows.join(F.broadcast(bits), F.bitmap_bucket_number("uid") == F.col("_bucket"))
    return met.where(F.getbit(byte, (at % 8).cast("int")) == 1).select(*rows.columns)


def split_further(large: DataFrame, starts: DataFrame, opened: list[np.ndarray], threshold: float) -> DataFrame:
    """(path, uid, parent, above) of the tokens that sets in large buckets choose next.

    ``starts``: uid, paths, tokens; ``opened``: paths of each level above that were split.
    Sets follow their paths down from the first level where they stand, so that only
    paths are shuffled, no tokens. Only large buckets' paths and sizes are sent to the tasks,
    one for SMALL rows of ``large`` at most.
    """
    sizes = large.select("path", "size").distinct().toPandas().sort_values("path")
    here, above = sizes["path"].to_numpy(np.int64), sizes["size"].to_numpy(np.int64)
    levels = [*opened, here]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = utf8(batch.column(2))
            uid, out = batch.column(0).to_numpy(), []
            starting = _lists(pa.chunked_array([batch.column(1)]))
            flat, row = np.concatenate(starting), np.repeat(np.arange(len(starting)), [len(x) for x in starting])
            for k in np.unique(row[np.isin(flat, levels[0])]).tolist():
                own = np.frombuffer(buf[offs[k] : offs[k + 1]].tobytes(), np.uint32)
                limit, now = limits(np.array([len(own)]), threshold), starting[k]
                for depth, level in enumerate(levels):
                    now = np.unique(now[np.isin(now, level)])
                    new = [next_path(own[chosen(own, p, limit)], p).view(np.int64) for p in now.view(_U)[:, None]]
                    if depth < len(levels) - 1:
                        now = np.concatenate([*new, np.empty(0, np.int64)])
                parent = np.repeat(now, [len(x) for x in new])
                out.append((np.concatenate([*new, np.empty(0, np.int64)]), np.full(len(parent), uid[k]), parent, above[np.searchsorted(here, parent)]))
            if out:
                yield pa.record_batch([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out, strict=True)], names=["path", "uid", "parent", "above"])

    found = arrow_map(starts.select("uid", "paths", "tokens"), step, "path long, uid long, parent long, above long")
    return found.join(large.select(F.col("path").alias("parent"), "uid"), ["parent", "uid"], "left_semi").select("path", "uid", "parent", "above")


def buckets(now: DataFrame, starts: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame | None, int]:
    """From (path, uid), with ``starts`` (uid, paths, tokens) that hold them: (path, uid, size) of the buckets at which splitting ended, of two sets at least; uid of sets in split buckets; the deepest level."""
    ended, split, opened_paths = None, None, []
    for level in range(1, LEVELS + 1):
        sizes = now.groupBy("path").agg(F.count("*").alias("size")).where("size > 1")
        met = written(now.join(sizes, "path"), "buckets")
        large = met.where(F.col("size") > SMALL)
        if level == LEVELS or large.isEmpty():
            part = met.select("path", "uid", "size")
            return part if ended is None else ended.unionByName(part), split, level
        children = written(split_further(large, starts, opened_paths, threshold), "split")
        stalled = children.groupBy("path", "parent", "above").count().where(F.col("count") >= STALL * F.col("above")).select(F.col("parent").alias("path")).distinct()
        part = met.where(F.col("size") <= SMALL).select("path", "uid", "size").unionByName(large.join(stalled, "path", "left_semi").select("path", "uid", "size"))
        ended = part if ended is None else ended.unionByName(part)
        opened = written(large.join(stalled, "path", "left_anti").select("path", "uid"), "opened")
        opened_paths.append(opened.select("path").distinct().toPandas()["path"].to_numpy(np.int64))
        opened = opened.select("uid").distinct()
        split = opened if split is None else split.unionByName(opened)
        now = children.join(stalled.withColumnRenamed("path", "parent"), "parent", "left_anti").select("path", "uid")
    raise AssertionError("the last level returns")


def all_buckets(classes: DataFrame, sets: DataFrame, threshold: float, recall: float) -> DataFrame:
    """(path, uid, size) of all runs; runs go on for sets in split buckets until the recall is reached."""
    done = runs_needed(threshold, recall)
    own = among(sets.select("uid", "paths", "tokens"), classes.select("uid"))
    ended, split, depth = buckets(own.select(F.explode("paths").alias("path"), "uid"), own, threshold)
    first = done
    while split is not None and (needed := runs_needed(threshold, recall, depth)) > done:
        split = written(split.distinct(), "again")
        paths = F.array_distinct(F.flatten(F.slice("later", done - first + 1, needed - done)))
        own = among(sets.select("uid", paths.alias("paths"), "tokens"), split)
        more, again, deepest = buckets(own.select(F.explode("paths").alias("path"), "uid"), own, threshold)
        ended, done, depth = ended.unionByName(more), needed, max(depth, deepest)
        split = split if again is None else split.unionByName(again)
    return ended.distinct()


def common_bucket(own: list[np.ndarray], path: int) -> np.ndarray | None:
    """Matrix rows that mark in which earlier buckets each set stands; only buckets of several sets."""
    flat = np.concatenate(own) if own else np.empty(0, np.int64)
    row = np.repeat(np.arange(len(own)), [len(x) for x in own])
    early = flat < path
    names, at, count = np.unique(flat[early], return_inverse=True, return_counts=True)
    if not (count > 1).any():
        return None
    keep = count[at] > 1
    place = np.cumsum(count > 1) - 1
    out = np.zeros((len(own), int((count > 1).sum())), np.float32)
    out[row[early][keep], place[at[keep]]] = 1
    return out


def owned(ok: np.ndarray, a: np.ndarray | None, rows: slice, cols: slice) -> None:
    """Take from ``ok`` the pairs of a tile that meet in an earlier bucket, too; only rows and columns with a pair are looked at."""
    if a is None:
        return
    r, c = np.flatnonzero(ok.any(1)), np.flatnonzero(ok.any(0))
    if len(r):
        ok[np.ix_(r, c)] &= (a[rows][r] @ a[cols][c].T) == 0


def tile_slices(side: np.ndarray, pair: bool) -> Iterator[tuple[slice, slice, bool]]:
    """Tiles of a block pair; rows of the first block come first. (rows, columns, on the diagonal)."""
    n = len(side)
    cut = int(np.searchsorted(side, 1)) if pair else n
    first = [slice(i, min(i + _TILE, cut)) for i in range(0, cut, _TILE)]
    if pair:
        second = [slice(i, min(i + _TILE, n)) for i in range(cut, n, _TILE)]
        yield from ((a, b, False) for a in first for b in second)
    else:
        yield from ((a, b, a is b) for k, a in enumerate(first) for b in first[k:])


def plausible_rows(sk: np.ndarray, own: list[np.ndarray], path: int, side: np.ndarray, pair: bool) -> np.ndarray:
    """Sets with a partner of enough agreement, of a pair that belongs to this bucket."""
    keep = np.zeros(len(sk), bool)
    earlier = common_bucket(own, path)
    for a, b, diagonal in tile_slices(side, pair):
        same = np.zeros((a.stop - a.start, b.stop - b.start), np.int16)
        used = np.zeros_like(same)
        for k in range(BINS):
            x, y = sk[a, k][:, None], sk[b, k]
            used += (x != 65535) | (y != 65535)
            same += (x == y) & (x != 65535)
        ok = same >= PLAUSIBLE * used
        if diagonal:
            np.fill_diagonal(ok, False)
        owned(ok, earlier, a, b)
        keep[a] |= ok.any(1)
        keep[b] |= ok.any(0)
    return keep


def exact_links(tokens: list[np.ndarray], weight: np.ndarray, own: list[np.ndarray], path: int, side: np.ndarray, pair: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each set (its partners' documents), and the least row it hangs together with here."""
    n = len(tokens)
    links, label = np.zeros(n, np.int64), np.arange(n)
    size = np.array([len(t) for t in tokens], np.float64)
    flat, row = np.concatenate(tokens), np.repeat(np.arange(n), size.astype(np.int64))
    names, at, count = np.unique(flat, return_inverse=True, return_counts=True)
    keep = count[at] > 1
    column = (np.cumsum(count > 1) - 1)[at[keep]]
    row, width = row[keep], int((count > 1).sum())
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    earlier = common_bucket(own, path)
    masks = []
    for a, b, diagonal in tile_slices(side, pair):
        inter = np.zeros((a.stop - a.start, b.stop - b.start), np.float32)
        for c in range(0, width, _COLUMNS):
            lo, hi = np.searchsorted(column, (c, c + _COLUMNS))
            r, k = row[lo:hi], column[lo:hi] - c
            x = np.zeros((inter.shape[0], _COLUMNS if width - c > _COLUMNS else width - c), np.float32)
            inside = (r >= a.start) & (r < a.stop)
            x[r[inside] - a.start, k[inside]] = 1
            if a == b:
                y = x
            else:
                y = np.zeros((inter.shape[1], x.shape[1]), np.float32)
                inside = (r >= b.start) & (r < b.stop)
                y[r[inside] - b.start, k[inside]] = 1
            inter += x @ y.T
        union = size[a][:, None] + size[b] - inter
        ok = inter / np.maximum(union, 1) >= threshold
        if diagonal:
            np.fill_diagonal(ok, False)
        owned(ok, earlier, a, b)
        if ok.any():
            links[a] += ok @ weight[b]
            if not diagonal:
                links[b] += weight[a] @ ok
            masks.append((a, b, np.packbits(ok, axis=1), ok.shape[1]))
    changed = bool(masks)
    while changed:
        before = label.copy()
        for a, b, bits, w in masks:
            ok = np.unpackbits(bits, axis=1, count=w).astype(bool)
            down = np.where(ok, label[b], n).min(1)
            label[a] = np.minimum(label[a], down)
            across = np.where(ok, label[a][:, None], n).min(0)
            label[b] = np.minimum(label[b], across)
        label = label[label]
        changed = bool((label != before).any())
    return links, label


_GROUP = ["path", "i", "j"]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Tables of whole groups, with the groups' first rows and end."""
    for t in batches_by_key(batches, _GROUP):
        t = t.combine_chunks()
        keys = np.stack([t.column(c).to_numpy() for c in _GROUP])
        heads = np.flatnonzero(np.concatenate(([True], (keys[:, 1:] != keys[:, :-1]).any(0))))
        yield t, heads, np.append(heads[1:], t.num_rows)


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    column = column.combine_chunks()
    flat, offs = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    offs = offs - offs[0]
    return [flat[a:b] for a, b in zip(offs, offs[1:], strict=False)]


def blocked(members: DataFrame) -> DataFrame:
    """Each member once for every pair of blocks of its bucket that it belongs to."""
    n = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("uid"), n).cast("int")
    rows = members.withColumn("own_block", own).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    return rows.select("*", F.least("own_block", "other").alias("i"), F.greatest("own_block", "other").alias("j")).withColumn("side", F.when(F.col("own_block") == F.col("i"), 0).otherwise(1)).drop("own_block", "other", "size")


def dealt(df: DataFrame, parts: int) -> DataFrame:
    """Small rows, much work: the number of tasks goes by the rows, not by their bytes."""
    return df.repartition(parts, *_GROUP).sortWithinPartitions(*_GROUP, "side", "uid")


def survivors(members: DataFrame, parts: int) -> DataFrame:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, heads, ends in _groups(batches):
            raw, _ = utf8(t.column("sketch"))
            sk = np.frombuffer(raw.tobytes(), np.uint16).reshape(-1, BINS)
            own, path, side = _lists(t.column("own")), t.column("path").to_numpy(), t.column("side").to_numpy()
            i, j = t.column("i").to_numpy(), t.column("j").to_numpy()
            keep = np.zeros(t.num_rows, bool)
            for a, b in zip(heads.tolist(), ends.tolist(), strict=True):
                if b - a > 1:
                    keep[a:b] = plausible_rows(sk[a:b], own[a:b], int(path[a]), side[a:b], bool(i[a] != j[a]))
            kept = t.select([*_GROUP, "side", "uid"]).filter(pa.array(keep))
            yield from kept.to_batches()

    return arrow_map(dealt(members, parts), search, "path long, i int, j int, side int, uid long")


def links(members: DataFrame, threshold: float, parts: int) -> DataFrame:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, heads, ends in _groups(batches):
            raw, offs = utf8(t.column("tokens"))
            own, path, side = _lists(t.column("own")), t.column("path").to_numpy(), t.column("side").to_numpy()
            i, j, uid, weight = (t.column(c).to_numpy() for c in ("i", "j", "uid", "weight"))
            out = []
            for a, b in zip(heads.tolist(), ends.tolist(), strict=True):
                if b - a < 2:
                    continue
                tokens = [np.frombuffer(raw[offs[k] : offs[k + 1]].tobytes(), np.uint32) for k in range(a, b)]
                n, label = exact_links(tokens, weight[a:b], own[a:b], int(path[a]), side[a:b], bool(i[a] != j[a]), threshold)
                has = n > 0
                out.append((uid[a:b][has], n[has], uid[a:b][label[has]]))
            if out:
                yield pa.record_batch([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out, strict=True)], names=["uid", "links", "with"])

    return arrow_map(dealt(members, parts), search, "uid long, links long, with long")


def classified(docs: DataFrame, threshold: float, recall: float, width: int, id_col: str, text_col: str, rows: bool = False) -> tuple[DataFrame, DataFrame]:
    """The sets of all documents (see _SETS, with ``rows`` also each ``row``), and one row for each distinct set: key, rep, uid, weight, root, links."""
    sized_batches(docs.sparkSession)
    sets = written(token_sets(docs, threshold, recall, width, id_col, text_col, rows), "sets")
    rep = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "uid"))
    classes = written(
        sets.where("n > 0").groupBy("key").agg(rep.alias("r"), F.count("*").alias("weight"))
        .select("key", F.col("r.uid").alias("uid"), F.col("r.doc_id").alias("rep"), "weight"), "classes",
    )
    ended = written(all_buckets(classes, sets, threshold, recall), "ended")
    own = written(ended.groupBy("uid").agg(F.collect_set("path").alias("own")), "own")
    light = ended.join(own, "uid").join(sets.select("uid", "sketch"), "uid")
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), ended.count() // ROWS_A_TASK)
    pairs = written(survivors(blocked(light), parts), "pairs")
    payload = pairs.join(own, "uid").join(classes.select("uid", "weight"), "uid").join(among(sets.select("uid", "tokens"), pairs.select("uid")), "uid")
    found = written(links(payload, threshold, parts), "links")
    graph = components(found.select(F.col("uid").alias("a"), F.col("with").alias("b")))
    counts = found.groupBy("uid").agg(F.sum("links").alias("links"))
    return sets, classes.join(counts, "uid", "left").join(graph.withColumnRenamed("node", "uid"), "uid", "left").withColumn("root", F.coalesce("root", "uid"))


def similar(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id (least id it hangs together with), n_links (documents at the threshold or above), set_size."""
    sets, named = classified(docs, threshold, recall, width, id_col, text_col)
    least = named.groupBy("root").agg(F.min("rep").alias("class_id"))
    final = written(named.join(least, "root").select("key", "weight", "class_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")), "classed")
    joined = join_groups(sets.select("uid", "doc_id", "key", "n"), final, ["key"], "weight", "uid")
    return joined.select("doc_id", F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), F.coalesce(F.when(F.col("n") > 0, F.col("n_links")), F.lit(0).cast("long")).alias("n_links"), F.col("n").alias("set_size"))


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay when one document of each class does: the one with the least id (null is the largest); empty texts all stay."""
    sets, named = classified(docs, threshold, recall, width, id_col, text_col, True)
    least = named.groupBy("root").agg(F.min(F.struct(F.col("rep").isNull(), "rep", "uid")).alias("r"))
    stay = least.select(F.col("r.uid").alias("uid")).unionAll(sets.where("n = 0").select("uid"))
    return among(sets.select("uid", "row"), stay).select("row.*")
