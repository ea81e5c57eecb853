"""Packing token sequences by minimum bin slack.

Each map task encodes its documents. Full windows of a long document become
sequences of their own; its remainder joins a pool. For each window a subset-sum
dynamic programme over the pool's multiset of lengths, kept as the bits of one
integer, finds the sum closest to the capacity; walking back over its stages
gives how many pieces of each length to take, and the same choice is repeated
while the counts last. Where no subset fills a window, a remaining document is
cut to close the gap; what is left at the end of a task is cut at the window and
then at powers of two, so that no padding remains. There is no shuffle, and a
task holds one bounded pool.

Defined cases: a null or empty text is its end identifier alone; rows that repeat
an id are packed each; other columns are ignored; an empty table has no pieces.
Sequence ids are unique, but not without gaps.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.llm.common import arrow_map, sized_batches
from knotwork.llm.encoding import encode_column

WINDOW = 4096
#: Remainders that a pool takes before it is packed, and that stay for the next.
POOL, STAY = 8192, 1024
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def closest_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many pieces of each length to take for the sum closest to ``capacity`` from below.

    ``counts``: pieces of each length. Lengths go from long to short; a count is
    taken in powers of two.
    """
    mask, full = (1 << (capacity + 1)) - 1, 1 << capacity
    bits, stages = 1, []
    for length in sorted(counts, reverse=True):
        if length > capacity:
            continue
        left, part = min(counts[length], capacity // length), 1
        while left > 0:
            take = min(part, left)
            stages.append((bits, length, take))
            bits |= (bits << (length * take)) & mask
            left, part = left - take, part * 2
        if bits & full:
            break
    total, chosen = bits.bit_length() - 1, defaultdict(int)
    for before, length, take in reversed(stages):
        if not before >> total & 1:
            chosen[length] += take
            total -= length * take
    return dict(chosen)


class Packer:
    """Pieces of one task; a remainder is [doc_id, start, identifiers as bytes, doc_tokens]."""

    def __init__(self, first_sequence: int, window: int):
        self.next, self.window = first_sequence, window
        self.pool: dict[int, list] = defaultdict(list)
        self.held = 0
        self.out: list[tuple] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n, step = len(ids) // 4, self.window * 4
        whole = n // self.window * step
        for at in range(0, whole, step):
            self._put([(doc_id, at // 4, ids[at : at + step], n)])
        if whole < len(ids):
            self._hold((doc_id, whole // 4, ids[whole:], n))
        if self.held >= POOL:
            self.pack(STAY)

    def _hold(self, piece: tuple) -> None:
        self.pool[len(piece[2]) // 4].append(piece)
        self.held += 1

    def _take(self, length: int) -> tuple:
        pieces = self.pool[length]
        piece = pieces.pop()
        if not pieces:
            del self.pool[length]
        self.held -= 1
        return piece

    def _put(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, n in pieces:
            length = len(ids) // 4
            self.out.append((doc_id, start, length, zlib.crc32(ids), n, self.next, offset))
            offset += length
        self.next += 1

    def pack(self, stay: int) -> None:
        """Fill windows until ``stay`` remainders or less than a window is left."""
        total = sum(k * len(v) for k, v in self.pool.items())
        while self.held > stay and total >= self.window:
            counts = {k: len(v) for k, v in self.pool.items()}
            chosen = closest_fill(counts, self.window)
            gap = self.window - sum(k * n for k, n in chosen.items())
            repeat = min(counts[k] // n for k, n in chosen.items()) if not gap else 1
            for _ in range(repeat):
                pieces = [self._take(k) for k, n in chosen.items() for _ in range(n)]
                if gap:  # nothing fits: cut the longest remainder
                    doc_id, start, ids, n = self._take(max(self.pool))
                    pieces.append((doc_id, start, ids[: gap * 4], n))
                    if len(ids) > gap * 4:
                        self._hold((doc_id, start + gap, ids[gap * 4 :], n))
                self._put(pieces)
                total -= self.window

    def finish(self) -> None:
        self.pack(0)
        rest = [self._take(k) for k in sorted(self.pool, reverse=True) for _ in range(len(self.pool[k]))]
        left = sum(len(p[2]) // 4 for p in rest)
        while left:
            size = 1 << (left.bit_length() - 1)
            own, need = [], size
            while need:
                doc_id, start, ids, n = rest.pop(0)
                own.append((doc_id, start, ids[: need * 4], n))
                if len(ids) > need * 4:
                    rest.insert(0, (doc_id, start + need, ids[need * 4 :], n))
                need -= len(own[-1][2]) // 4
            self._put(own)
            left -= size


def pack_sequences(docs: DataFrame, tokenizer_path: str, end_id: int = 2, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece; see PIECES. ``window`` must be a power of two."""
    sized_batches(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()
    names = [c.split()[0] for c in PIECES.split(", ")]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(TaskContext.get().partitionId() << 33, window)

        def drained() -> pa.RecordBatch:
            cols = zip(*packer.out, strict=True)
            made = pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=names)
            packer.out = []
            return made

        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), encode_column(batch.column(1), tokenizer_path), strict=True):
                packer.add(doc_id, raw + end)
            if packer.out:
                yield drained()
        packer.finish()
        if packer.out:
            yield drained()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return arrow_map(rows, pack, PIECES, tokens=True)
