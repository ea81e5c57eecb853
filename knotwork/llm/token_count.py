"""Exact token counts of byte-pair encodings without making any identifier.

A text is split as the tokenizer's own pre-tokenizer splits it. The symbols of a
piece stand in a linked list; a heap hands out the lowest-rank adjacent pair,
leftmost first, until no pair has a rank. The count is the symbols at the start
minus the merges. Words repeat, so counts are remembered in two bounded
generations of a dictionary; nothing depends on what is remembered.

Defined cases: a null or empty text has 0 tokens; a special token's string
inside a text counts as one token, as the tokenizer's default has it; rows that
repeat an id are counted each; other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.llm.common import arrow_map, forgettable, sized_batches

# Unicode White_Space, and the published pre-tokenizer pattern of byte-level BPE.
_W = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_W}\p{{L}}\p{{N}}]+|[{_W}]+(?![^{_W}])|[{_W}]+")
#: A blank beside other white space: there a blank isn't just the mark before a word.
_TANGLED = re.compile(rf" [{_W}]|[{_W}] ")
#: Entries in one generation of remembered counts, and characters of the longest chunk remembered.
REMEMBERED, LONGEST = 200_000, 64


class Remembered:
    """Two generations of a bounded dictionary: what is used stays, the rest goes with its generation."""

    def __init__(self, size: int = REMEMBERED):
        self.young, self.old, self.size = {}, {}, size

    def get(self, key):
        found = self.young.get(key)
        if found is None:
            found = self.old.get(key)
            if found is not None:
                self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        self.young[key] = value


def merges_left(piece: bytes, ranks: dict[tuple[bytes, bytes], int]) -> int:
    """Tokens of one piece: its bytes less the merges, lowest rank first, leftmost first."""
    n = len(piece)
    if n < 2:
        return n
    symbols = [piece[i : i + 1] for i in range(n)]
    get = ranks.get
    shift = n.bit_length()
    low = (1 << shift) - 1
    heap = [r << shift | i for i in range(n - 1) if (r := get((symbols[i], symbols[i + 1]))) is not None]
    if not heap:
        return n
    heapq.heapify(heap)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    count, pop, push = n, heapq.heappop, heapq.heappush
    while heap:
        entry = pop(heap)
        i, rank = entry & low, entry >> shift
        left = symbols[i]
        if left is None or (j := after[i]) >= n or get((left, right := symbols[j])) != rank:
            continue
        merged = symbols[i] = left + right
        symbols[j] = None
        k = after[i] = after[j]
        count -= 1
        if k < n:
            before[k] = i
            if (r := get((merged, symbols[k]))) is not None:
                push(heap, r << shift | i)
        if (h := before[i]) >= 0 and (r := get((symbols[h], merged))) is not None:
            push(heap, r << shift | h)
    return count


@forgettable
@lru_cache(1)
def byte_letters() -> dict[str, int]:
    """The published one-letter names of the 256 bytes, made by their rule: printable bytes stand for themselves."""
    named = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    letters = {chr(b): b for b in named}
    rest = [b for b in range(256) if b not in set(named)]
    return letters | {chr(256 + i): b for i, b in enumerate(rest)}


class PairMergeCounter:
    """Counts for one tokenizers file of the byte-level BPE kind."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        plain = model["type"] == "BPE" and not model["dropout"] and not model["end_of_word_suffix"] and not model["continuing_subword_prefix"] and not model.get("ignore_merges")
        if spec["normalizer"] or (spec["pre_tokenizer"] or {}).get("type") != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space") or not spec["pre_tokenizer"].get("use_regex", True) or not plain:
            raise ValueError("counts are made for byte-level pair encodings without a normaliser only")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take in what is beside them are not counted")
        letters = byte_letters()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.ranks = {(as_bytes(a), as_bytes(b)): i for i, (a, b) in enumerate(pairs)}
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.marks = special
        self.chunks, self.pieces = Remembered(), Remembered()

    def count(self, text: str) -> int:
        if any(m in text for m in self.marks):
            return len(self.special.findall(text)) + sum(map(self._plain, self.special.split(text)))
        return self._plain(text)

    def _plain(self, text: str) -> int:
        if not text:
            return 0
        if _TANGLED.search(text):
            return self._by_piece(text)
        first, *rest = text.split(" ")
        total = self._by_piece(first)
        get, old = self.chunks.young.get, self.chunks
        for chunk in rest:
            n = get(chunk)
            if n is None:
                n = old.old.get(chunk)
                if n is None:
                    n = self._by_piece(" " + chunk)
                if len(chunk) <= LONGEST:
                    old.put(chunk, n)
                    get = old.young.get
            total += n
        return total

    def _by_piece(self, text: str) -> int:
        total = 0
        for piece in _PIECES.findall(text):
            n = self.pieces.get(piece)
            if n is None:
                n = merges_left(piece.encode(), self.ranks)
                if len(piece) <= LONGEST:
                    self.pieces.put(piece, n)
            total += n
        return total


@forgettable
@lru_cache(2)
def counter(path: str) -> PairMergeCounter:
    return PairMergeCounter(path)


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit. No shuffle: a scan and one map."""
    sized_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(tokenizer_path)
        for batch in batches:
            n = [own.count(t) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return arrow_map(rows, count, "doc_id long, n_bytes long, n_tokens long", tokens=True).withColumn("over_limit", F.col("n_tokens") > limit)
