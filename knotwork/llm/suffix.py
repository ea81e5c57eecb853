"""Repeated passages by suffix arrays, built by linear grouping.

Documents are written once as compressed blocks of bytes. Every window of
``length`` bytes has an anchor, its run of K bytes with the least hash, so equal
windows have equal anchors at the same place; windows in a row with one anchor
form a segment. A first shuffle (48 bits of a hash for each anchor of a block)
tells which anchors occur in two documents at least; one bit for each goes back.
A second shuffle brings the segments of those anchors together by anchor.

There, equal segments are one string that belongs to its smallest document. What
all strings of an anchor have in common around it becomes one symbol that
remembers its length; the strings of many anchors are laid end to end and their
suffix array is built by grouping: suffixes that begin with the same Lyndon word
form groups, which are taken in descending order; each suffix lengthens the word
of its previous smaller suffix, whose group is split thereby. When all words are
whole, each group's order is emitted from the order of the smaller suffixes.
Common prefixes of neighbours then give each suffix its longest match in a
smaller document. Matched spans go back to the blocks, where bytes are removed.

An anchor that a third of all blocks hold is one entry a block in the first
shuffle. In the second, equal segments compress and merge; the segments of a hot
anchor (in many blocks, or many times in one) are divided: a window that reaches
far to the right of the anchor goes by the bytes there, another by the bytes to its
left, so each part of them shares a longer run. No task holds more than some parts,
whose number grows with the input. Anchors are known by hashes of 48 bits and more
within a part; a window is taken for another's only if the hashes of their anchors
collide and all their other bytes are equal.

Defined cases: a null text is empty; an empty or shorter text loses nothing; a
null doc_id counts as the largest; rows that repeat an id don't remove each
other's bytes; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.llm.common import arrow_map, batches_by_key, sized_batches, written

LENGTH, K = 50, 24
#: Bytes of a block (a longer document stands alone), of input to a part, and windows hashed at once.
BLOCK, PART, SLICE = 4 << 20, 8 << 20, 1 << 16
#: Symbols at which a suffix array is closed.
SYMBOLS = 1 << 17
#: An anchor is hot if it stands in so many blocks, or so many times in one of them.
HOT_BLOCKS, HOT_SEGMENTS = 256, 512
LAST_ID = (1 << 63) - 1
_BLOCKS = "block long, ids array<long>, lens array<long>, text binary"
_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_M = 0x9E3779B97F4A7C15
_U = np.uint64


# Suffix arrays


def suffix_groups(text: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Final groups in ascending order, each position's group (-1: separator) and previous smaller suffix.

    ``text`` begins and ends with the separator 0, which no comparison passes.
    """
    n, places = len(text), {}
    for i, c in enumerate(text):
        if c:
            places.setdefault(c, []).append(i)
    members = [places[c] for c in sorted(places)]
    group, alive = [-1] * n, [len(m) for m in members]
    for g, own in enumerate(members):
        for i in own:
            group[i] = g
    above, below = list(range(1, len(members) + 1)), list(range(-1, len(members) - 1))
    done, smaller, final = bytearray(n), [0] * n, []
    g = len(members) - 1
    while g >= 0:
        if alive[g]:
            final.append(g)
            own = members[g] if alive[g] == len(members[g]) else [i for i in members[g] if group[i] == g]
            members[g] = own
            for i in own:
                done[i] = 1
            lengthened, last, times = {}, -1, 0
            for i in own:
                j = i - 1
                while done[j]:  # in a group not below this one
                    j = smaller[j]
                smaller[i] = j
                if j == last:
                    times += 1
                    continue
                if times and group[last] >= 0 and alive[group[last]] > 1:
                    lengthened.setdefault((group[last], times), []).append(last)
                last, times = j, 1
            if times and group[last] >= 0 and alive[group[last]] > 1:
                lengthened.setdefault((group[last], times), []).append(last)
            under = -1
            for (h, _), moved in sorted(lengthened.items()) if len(lengthened) > 1 else lengthened.items():
                if h != under:
                    under, at = h, h
                    if len(moved) == alive[h]:  # the whole group's word is lengthened
                        continue
                new, up = len(members), above[at]
                members.append(moved)
                alive.append(len(moved))
                alive[h] -= len(moved)
                for i in moved:
                    group[i] = new
                above.append(up)
                below.append(at)
                above[at] = below[up] = new
                at = new
        g = below[g]
    return final[::-1], group, smaller


def suffix_array(text: list[int]) -> list[int]:
    """Order of all suffixes but the separators', each compared up to its separator."""
    final, group, smaller = suffix_groups(text)
    counts = np.bincount(np.array(group)[np.array(group) >= 0], minlength=max(final, default=-1) + 1)
    free, at = {}, 0
    for g in final:
        free[g] = at
        at += int(counts[g])
    order, placed = [0] * at, bytearray(len(text))
    for i, g in enumerate(group):
        if g < 0:
            placed[i] = 1
    separators = (i for i, g in enumerate(group) if g < 0 and i)

    def emit(i: int) -> None:
        j = i - 1
        while not placed[j]:  # those whose next smaller suffix is i
            g = group[j]
            order[free[g]] = j
            free[g] += 1
            placed[j] = 1
            j = smaller[j]

    for i in separators:
        emit(i)
    for k in range(at):
        emit(order[k])
    return order


def common_lengths(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Symbols that each suffix has in common with the one before it."""
    out, active, at = np.zeros(len(order), np.int64), np.arange(1, len(order)), 0
    while len(active):
        a, b = text[order[active - 1] + at], text[order[active] + at]
        active = active[(a == b) & (a != 0)]
        at += 1
        out[active] = at
    return out


def smaller_matches(length: np.ndarray, owner: np.ndarray, least: int) -> dict[int, int]:
    """For each place in a suffix array the longest match (``least`` at least) with a suffix of a smaller owner."""
    found: dict[int, int] = {}
    near = length >= least
    begins = np.flatnonzero(near & ~np.concatenate(([False], near[:-1]))) - 1
    ends = np.flatnonzero(near & ~np.concatenate((near[1:], [False]))) + 1
    for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
        own, common = owner[a:b].tolist(), length[a:b].tolist()
        m = b - a
        if own.count(own[0]) == m:
            continue
        for places, step in ((range(m), 0), (range(m - 1, -1, -1), 1)):
            stack = []
            for k in places:
                c = common[k + step] if stack else 0
                d = own[k]
                while stack and stack[-1][0] >= d:
                    c = min(c, stack.pop()[1])
                if stack and c > found.get(a + k, 0):
                    found[a + k] = c
                stack.append((d, c))
    return found


class Array:
    """Strings of some anchors, and where their windows match a smaller document."""

    def __init__(self, length: int):
        self.length = length
        self.text, self.weight, self.strings = [0], [0], []

    def add(self, symbol: int, strings: list[tuple[bytes, bytes]], owners: list[int], keys: list) -> None:
        """The (left, right) surroundings of one anchor, with the owner of each."""
        before = len(os.path.commonprefix([x[::-1] for x, _ in strings]))
        after = len(os.path.commonprefix([y for _, y in strings]))
        core = before + K + after
        for (left, right), owner, key in zip(strings, owners, keys, strict=True):
            self.strings.append((len(self.text), len(left) - before, owner, key))
            rest = [c + 1 for c in left[: len(left) - before]]
            tail = [c + 1 for c in right[after:]]
            self.text += rest
            self.text.append(257 + symbol)
            self.text += tail
            self.text.append(0)
            self.weight += [1] * len(rest)
            self.weight.append(core)
            self.weight += [1] * len(tail)
            self.weight.append(0)

    def matches(self) -> dict:
        """Key of each matched string: the first and last + 1 of each run of its windows that match."""
        if not self.strings:
            return {}
        text, order = np.array(self.text), np.array(suffix_array(self.text), np.int64)
        symbols = common_lengths(text, order)
        total = np.concatenate(([0], np.cumsum(self.weight)))
        length = total[order + symbols] - total[order]
        begin = np.array([s[0] for s in self.strings])
        which = np.searchsorted(begin, order, "right") - 1
        owner = np.array([s[2] for s in self.strings], np.int64)[which]
        out: dict = {}
        for k, most in sorted(smaller_matches(length, owner, self.length).items(), key=lambda x: order[x[0]]):
            at, rest, _, key = self.strings[which[k]]
            first = int(order[k]) - at
            if first > rest:
                continue
            last = first + 1 if first < rest else first + int(most) - self.length + 1
            runs = out.setdefault(key, [])
            if runs and runs[-1][1] == first:
                runs[-1] = (runs[-1][0], last)
            else:
                runs.append((first, last))
        return out


# Anchors of blocks


def run_hashes(buf: np.ndarray, k: int = K) -> np.ndarray:
    """A hash of each run of k bytes, by doubling."""
    now, size, power, out, have = buf.astype(_U) + _U(1), 1, _M, None, 0
    while k:
        if k & 1:
            if out is None:
                out, have = now, size
            else:
                m = len(buf) - have - size + 1
                out = out[:m] * _U(power) + now[have : have + m]
                have += size
        k >>= 1
        if k:
            m = len(now) - size
            now = now[:m] * _U(power) + now[size : size + m]
            size, power = size * 2, power * power % (1 << 64)
    for _ in range(2):
        out = (out ^ (out >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return out ^ (out >> _U(32))


def least_in(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def segments(buf: np.ndarray, offs: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(anchor's hash, its place, first window, windows, document) of each segment; all within documents."""
    out = []
    for a in range(0, len(buf) - length + 1, SLICE):
        part = buf[a : a + SLICE + length - 1]
        h = run_hashes(part)
        places = np.arange(len(h), dtype=_U)
        at = (least_in((h & _U(~0x3FFFF & (2**64 - 1))) | places, length - K + 1) & _U(0x3FFFF)).astype(np.int64)
        d0, d1 = np.searchsorted(offs, a, "right") - 1, np.searchsorted(offs, a + len(at) - 1, "right")
        edges = np.clip(offs[d0 : d1 + 1], a, a + len(at))
        doc = np.repeat(np.arange(d0, d1), np.diff(edges))
        inside = np.arange(a + length, a + length + len(at)) <= offs[doc + 1]
        new = inside.copy()
        new[1:] &= (at[1:] != at[:-1]) | ~inside[:-1]
        first = np.flatnonzero(new)
        if len(first):
            windows = np.add.reduceat(inside.astype(np.int64), first)
            out.append((h[at[first]], at[first] + a, first + a, windows, doc[first]))
    if not out:
        none = np.empty(0, np.int64)
        return none.astype(_U), none, none, none, none
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> _U(24)) % _U(parts)).astype(np.int64)


class BlockAnchors:
    """Distinct anchors of a block by (part, hash), and each segment's place among them."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, parts: int, length: int):
        self.hash, self.place, self.first, self.windows, self.doc = segments(buf, offs, length)
        part = part_of(self.hash, parts)
        self.order = np.lexsort((self.doc, self.hash, part))
        h, d = self.hash[self.order], self.doc[self.order]
        begins = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.empty(0, np.int64)
        self.sizes = np.diff(np.append(begins, len(h)))
        self.distinct = h[begins]
        self.several = d[begins] != d[begins + self.sizes - 1] if len(h) else np.empty(0, bool)
        self.parts, at = np.unique(part[self.order][begins], return_index=True)
        self.cuts = np.append(at, len(begins))


def opened(text: bytes, lens: list[int]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(zstandard.decompress(text), np.uint8), np.concatenate(([0], np.cumsum(np.array(lens, np.int64)))).astype(np.int64)


def blocks_of(docs: DataFrame) -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, press = TaskContext.get().partitionId() << 33, zstandard.ZstdCompressor(3)
        ids, lens, texts, held = [], [], [], 0

        def closed() -> pa.RecordBatch:
            row = (block, ids, lens, press.compress(b"".join(texts)))
            types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.record_batch([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=["block", "ids", "lens", "text"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and held + len(text) > BLOCK:
                    yield closed()
                    block, ids, lens, texts, held = block + 1, [], [], [], 0
                ids.append(doc_id)
                lens.append(len(text))
                texts.append(text)
                held += len(text)
        if ids:
            yield closed()

    return arrow_map(docs, make, _BLOCKS)


def shared_anchors(blocks: DataFrame, parts: int, length: int) -> DataFrame:
    """(block, part, bits): which of a block's distinct anchors of a part occur in another document, then which are hot."""

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, lens, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                own = BlockAnchors(*opened(text, lens), parts, length)
                low = np.ascontiguousarray(own.distinct, "<u8").view(np.uint8).reshape(-1, 8)[:, :6]
                many = own.sizes >= HOT_SEGMENTS
                rows = [low[a:b].tobytes() + np.packbits(own.several[a:b]).tobytes() + np.packbits(many[a:b]).tobytes() for a, b in zip(own.cuts, own.cuts[1:], strict=False)]
                yield pa.record_batch([pa.array(own.parts, pa.int32()), pa.array([block] * len(rows), pa.int64()), pa.array(np.diff(own.cuts), pa.int32()), pa.array(rows, pa.binary())], names=["part", "block", "n", "payload"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_part(batches):
            n, payload = t.column("n").to_pylist(), t.column("payload").to_pylist()
            cuts = np.concatenate(([0], np.cumsum(n)))
            wide = np.zeros((int(cuts[-1]), 8), np.uint8)
            flag, hot = np.empty(len(wide), bool), np.empty(len(wide), bool)
            for a, b, m, raw in zip(cuts, cuts[1:], n, payload, strict=False):
                data = np.frombuffer(raw, np.uint8)
                wide[a:b, :6] = data[: 6 * m].reshape(m, 6)
                flag[a:b] = np.unpackbits(data[6 * m : 6 * m + -(-m // 8)], count=m)
                hot[a:b] = np.unpackbits(data[6 * m + -(-m // 8) :], count=m)
            h = wide.reshape(-1).view("<u8")
            order = np.argsort(h)
            same = np.flatnonzero(h[order[1:]] == h[order[:-1]])
            flag[order[same]] = flag[order[same + 1]] = True
            heads = np.flatnonzero(np.concatenate(([True], h[order[1:]] != h[order[:-1]])))
            blocks = np.diff(np.append(heads, len(h)))
            hot[order] = np.repeat(np.logical_or.reduceat(hot[order], heads) | (blocks >= HOT_BLOCKS), blocks)
            rows = [np.packbits(flag[a:b]).tobytes() + np.packbits(hot[a:b]).tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
            yield pa.record_batch([t.column("block").combine_chunks(), t.column("part").combine_chunks(), pa.array(rows, pa.binary())], names=["block", "part", "bits"])

    rows = arrow_map(blocks.select("block", "lens", "text"), sent, "part int, block long, n int, payload binary")
    return arrow_map(rows.repartition("part").sortWithinPartitions("part"), shared, "block long, part int, bits binary")


def by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """One table for each part."""
    for t in batches_by_key(batches, ["part"]):
        t = t.combine_chunks()
        part = t.column("part").to_numpy()
        heads = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))).tolist()
        for a, b in zip(heads, [*heads[1:], t.num_rows], strict=True):
            yield t.slice(a, b - a).combine_chunks()


def divided(buf: np.ndarray, h: np.ndarray, place: np.ndarray, first: np.ndarray, left: np.ndarray, right: np.ndarray, doc: np.ndarray, hot: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Segments, those of hot anchors cut in two: windows with ``half`` bytes to the right of the anchor go by these, the others by the bytes to its left."""
    if not hot.any():
        return h, place, first, left, right, doc
    half = (length - K) // 2
    back = length - K - half + 1  # bytes to the left of the anchor that the other windows have at least
    to_right, to_left = hot & (right >= half), hot & (left >= back)

    def named(rows: np.ndarray, begin: np.ndarray, size: int) -> np.ndarray:
        near = buf[begin[rows][:, None] + np.arange(size)].astype(_U) + _U(1)
        weight = run_hashes(np.arange(size + K - 1).astype(np.uint8)) | _U(1)
        x = h[rows] * _U(_M) + (near * weight[:size]).sum(1, dtype=_U) + _U(size)
        for _ in range(2):
            x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
        return x ^ (x >> _U(32))

    right_first = np.maximum(first, place - (back - 1))
    sides = [
        (h[~hot], place[~hot], first[~hot], left[~hot], right[~hot], doc[~hot]),
        (named(to_right, place + K, half), place[to_right], right_first[to_right], (place - right_first)[to_right], right[to_right], doc[to_right]),
        (named(to_left, place - back, back), place[to_left], first[to_left], left[to_left], np.minimum(right, half - 1)[to_left], doc[to_left]),
    ]
    return tuple(np.concatenate(c) for c in zip(*sides, strict=True))


def shared_segments(blocks: DataFrame, flags: DataFrame, parts: int, length: int) -> DataFrame:
    """(part, block, payload) of the segments whose anchors are shared."""

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(3)
        for batch in batches:
            for block, ids, lens, text, bits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                buf, offs = opened(text, lens)
                own = BlockAnchors(buf, offs, parts, length)
                flag, hot = np.zeros(len(own.distinct), bool), np.zeros(len(own.distinct), bool)
                told = {b["part"]: b["bits"] for b in bits}
                for p, a, b in zip(own.parts.tolist(), own.cuts, own.cuts[1:], strict=False):
                    if p in told:
                        both, half = np.frombuffer(told[p], np.uint8), -(-(b - a) // 8)
                        flag[a:b] = np.unpackbits(both[:half], count=b - a)
                        hot[a:b] = np.unpackbits(both[half:], count=b - a)
                keep = own.order[np.repeat(flag, own.sizes)]
                if not len(keep):
                    continue
                key = np.array([LAST_ID if i is None else i for i in ids], np.int64)
                h, place, first, windows, doc = (x[keep] for x in (own.hash, own.place, own.first, own.windows, own.doc))
                left, right = place - first, first + windows + length - 1 - place - K
                h, place, first, left, right, doc = divided(buf, h, place, first, left, right, doc, np.repeat(hot[flag], own.sizes[flag]), length)
                part = part_of(h, parts)
                order = np.lexsort((first, part))
                h, place, first, left, right, doc, part = (x[order] for x in (h, place, first, left, right, doc, part))
                heads = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))).tolist()
                rows = []
                for a, b in zip(heads, [*heads[1:], len(part)], strict=True):
                    begin = np.column_stack((first[a:b], place[a:b] + K)).reshape(-1)
                    size = np.column_stack((left[a:b], right[a:b])).reshape(-1)
                    ends = np.cumsum(size)
                    content = buf[np.repeat(begin - (ends - size), size) + np.arange(ends[-1])]
                    low = np.ascontiguousarray(h[a:b], "<u8").view(np.uint8).reshape(-1, 8)[:, :6]
                    head = [low, key[doc[a:b]].astype("<i8"), np.diff(first[a:b], prepend=0).astype("<u4"), left[a:b].astype(np.uint8), right[a:b].astype(np.uint8), content]
                    rows.append(press.compress(np.array([b - a], "<u4").tobytes() + b"".join(x.tobytes() for x in head)))
                yield pa.record_batch([pa.array(part[heads], pa.int32()), pa.array([block] * len(rows), pa.int64()), pa.array(rows, pa.binary())], names=["part", "block", "payload"])

    told = flags.groupBy("block").agg(F.collect_list(F.struct("part", "bits")).alias("flags"))
    joined = blocks.join(told.hint("merge"), "block").select("block", "ids", "lens", "text", "flags")
    return arrow_map(joined, sent, "part int, block long, payload binary")


def read_segments(raw: bytes) -> tuple:
    data = zstandard.decompress(raw)
    n = int(np.frombuffer(data, "<u4", 1)[0])
    h = np.zeros((n, 8), np.uint8)
    h[:, :6] = np.frombuffer(data, np.uint8, 6 * n, 4).reshape(n, 6)
    at, out = 4 + 6 * n, []
    for kind, size in (("<i8", 8), ("<u4", 4), (np.uint8, 1), (np.uint8, 1)):
        out.append(np.frombuffer(data, kind, n, at))
        at += n * size
    doc, step, left, right = out
    return h.reshape(-1).view("<u8"), doc, np.cumsum(step, dtype=np.int64), left, right, data[at:]



def matched_spans(sent: DataFrame, length: int) -> DataFrame:
    """(block, spans): first and last + 1 byte of what a smaller document holds too."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_part(batches):
            blocks = t.column("block").to_pylist()
            read = [read_segments(raw) for raw in t.column("payload").to_pylist()]
            h, doc, first, left, right = (np.concatenate([r[k] for r in read]) for k in range(5))
            which = np.repeat(np.arange(len(read)), [len(r[0]) for r in read])
            content = b"".join(r[5] for r in read)
            del read
            size = left.astype(np.int64) + right
            begin = np.cumsum(size) - size
            order = np.argsort(h, kind="stable")
            heads = np.flatnonzero(np.concatenate(([True], h[order][1:] != h[order][:-1])))
            found = [np.empty((0, 3), np.int64)]  # (row, from, to)
            string_of, least = np.empty(len(h), np.int64), []
            array = Array(length)
            own, at, mid = order.tolist(), begin[order].tolist(), (begin + left)[order].tolist()
            end, docs = (begin + size)[order].tolist(), doc[order].tolist()
            matched: dict[int, list] = {}
            for g, (a, b) in enumerate(zip(heads.tolist(), [*heads[1:].tolist(), len(own)], strict=True)):
                seen: dict = {}
                for k in range(a, b):
                    key = (content[at[k] : mid[k]], content[mid[k] : end[k]])
                    s = seen.get(key)
                    if s is None:
                        s = seen[key] = len(least)
                        least.append(docs[k])
                    elif docs[k] < least[s]:
                        least[s] = docs[k]
                    string_of[own[k]] = s
                keys = list(seen.values())
                array.add(g, list(seen), [least[s] for s in keys], keys)
                if len(array.text) >= SYMBOLS:
                    matched |= array.matches()
                    array = Array(length)
            matched |= array.matches()
            owner = np.array(least, np.int64)[string_of]
            whole = np.flatnonzero(doc > owner)
            start = first
            found.append(np.column_stack((whole, start[whole], (start + size + K)[whole])))
            rows = np.flatnonzero(doc == owner)
            if matched:
                has = np.zeros(len(least), bool)
                has[list(matched)] = True
                rows = rows[has[string_of[rows]]]
                some = [(r, start[r] + x, start[r] + y + length - 1) for r in rows.tolist() for x, y in matched[int(string_of[r])]]
                if some:
                    found.append(np.array(some, np.int64))
            spans = np.concatenate(found)
            spans = spans[np.lexsort((spans[:, 1], which[spans[:, 0]]))]
            cuts = np.searchsorted(which[spans[:, 0]], np.arange(len(blocks) + 1))
            out = [(k, spans[a:b, 1:].astype("<u4").tobytes()) for k, a, b in zip(blocks, cuts, cuts[1:], strict=False) if b > a]
            if out:
                press = zstandard.ZstdCompressor(3)
                yield pa.record_batch([pa.array([k for k, _ in out], pa.int64()), pa.array([press.compress(x) for _, x in out], pa.binary())], names=["block", "spans"])

    return arrow_map(sent.repartition("part").sortWithinPartitions("part"), search, "block long, spans binary")


def removed(blocks: DataFrame, spans: DataFrame) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, lens, text, spans_of in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                buf, offs = opened(text, lens)
                edge = np.zeros(len(buf) + 1, np.int64)
                for raw in spans_of or ():
                    pairs = np.frombuffer(zstandard.decompress(raw), "<u4").reshape(-1, 2)
                    np.add.at(edge, pairs[:, 0], 1)
                    np.add.at(edge, pairs[:, 1], -1)
                gone = np.cumsum(edge[:-1]) > 0
                rows = []
                for doc_id, a, b in zip(ids, offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                    own = gone[a:b]
                    runs = int(own[:1].sum()) + int((own[1:] & ~own[:-1]).sum())
                    kept = buf[a:b][~own] if runs else buf[a:b]
                    rows.append((doc_id, b - a, b - a - len(kept), runs, hashlib.sha256(kept.tobytes()).hexdigest()))
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True)], names=[c.split()[0] for c in _RESULT.split(", ")])

    told = spans.groupBy("block").agg(F.collect_list("spans").alias("spans"))
    joined = blocks.join(told.hint("merge"), "block", "left").select("ids", "lens", "text", "spans")
    return arrow_map(joined, cut, _RESULT)


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256. ``length`` exceeds K."""
    spark = docs.sparkSession
    sized_batches(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    blocks = written(blocks_of(docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))), "blocks")
    total = blocks.agg(F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda x, y: x + y)).alias("n")).first().n or 0
    parts = max(3 * int(spark.conf.get("spark.sql.shuffle.partitions")), total // PART)
    flags = shared_anchors(blocks, parts, length)
    spans = matched_spans(shared_segments(blocks, flags, parts, length), length)
    return removed(blocks, spans)
