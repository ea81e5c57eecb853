"""Exact duplicates by Patricia tries of whole normalised texts.

Texts are equal when identical after deleting every ASCII white-space character
(``[\\x20\\x09-\\x0D]``). A task inserts the whole byte strings of its rows into
one compressed radix trie, whose terminal nodes store the owner; a text that a
third of all rows share leaves a map task as one row. When the trie's labels pass
their bound, its largest subtrees below the root are spilled: written out as rows
and dropped. Those rows are dealt by length and content hash to the second round
of tries, sorted by both, so equal strings come side by side: there a subtree that
is spilled holds finished owners, but for the string that came last.

Owners go back to the documents by an equi-join that deals the rows of hot texts
over many tasks.

Defined cases: a null text counts as empty, and all empty texts are one group;
among equally long originals the smallest id stays, and a null id counts as the
largest; rows that repeat an id are separate members of their group; columns
other than the id and the text are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.llm.common import arrow_map, join_groups, sized_batches, written

#: Bytes of labels and nodes that a trie holds before subtrees are spilled, until half of them are left.
TRIE_BYTES = 16 << 20
#: What a node costs besides its label.
NODE_BYTES = 200
WHITE_SPACE = " \t\n\v\f\r"


class Node:
    __slots__ = ("label", "children", "owner")

    def __init__(self, label: bytes):
        self.label, self.children, self.owner = label, {}, None


def shared_prefix(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def better(a: tuple, b: tuple) -> tuple:
    """Of two (code points, id): more code points, then the smaller id; a null id is last."""
    key = lambda x: (-x[0], x[1] is None, x[1] if x[1] is not None else 0)
    return a if key(a) <= key(b) else b


class PatriciaTrie:
    """Compressed radix trie over bytes; a terminal node holds (code points, id, members) of its owner."""

    def __init__(self, most: int | None = None):
        self.root, self.most = Node(b""), most or TRIE_BYTES
        #: Bytes of each subtree below the root, by its first byte.
        self.sizes: dict[int, int] = {}
        self.bytes = 0

    def insert(self, key: bytes, code_points: int, doc_id: int | None, members: int = 1) -> None:
        node, at, added = self.root, 0, 0
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                child = Node(key[at:])
                node.children[key[at]] = child
                added += len(key) - at + NODE_BYTES
                node, at = child, len(key)
                break
            label = child.label
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            cut = shared_prefix(key[at : at + len(label)], label)
            upper = Node(label[:cut])
            child.label = label[cut:]
            upper.children[child.label[0]] = child
            node.children[key[at]] = upper
            added += NODE_BYTES
            node, at = upper, at + cut
        if node.owner is None:
            node.owner = (code_points, doc_id, members)
        else:
            best = better(node.owner[:2], (code_points, doc_id))
            node.owner = (*best, node.owner[2] + members)
        if added:
            self.sizes[key[0]] = self.sizes.get(key[0], 0) + added
            self.bytes += added

    def terminals(self, subtree: Node | None = None) -> Iterator[tuple[bytes, tuple]]:
        stack = [(subtree or self.root, b"")]
        while stack:
            node, prefix = stack.pop()
            whole = prefix + node.label
            if node.owner is not None:
                yield whole, node.owner
            stack.extend((c, whole) for c in node.children.values())

    def spilled(self) -> Iterator[tuple[bytes, tuple]]:
        """Take out the largest subtrees until half of the bound is left."""
        while self.bytes > self.most // 2 and self.sizes:
            first = max(self.sizes, key=self.sizes.__getitem__)
            self.bytes -= self.sizes.pop(first)
            yield from self.terminals(self.root.children.pop(first))


_PART = "len long, hash long, body binary, code_points long, id long, members long"
_OWNER = "len long, sha string, code_points long, keep_id long, group_size long"


def _columns(rows: list, schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [c.split() for c in schema.split(", ")]
    return pa.record_batch([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])


def _parts(terminals: Iterator[tuple[bytes, tuple]]) -> Iterator[pa.RecordBatch]:
    """Rows of the first round, some megabytes a batch."""
    rows, size = [], 0
    for body, owner in terminals:
        rows.append((len(body), xxhash.xxh64_intdigest(body) - (1 << 63), body, *owner))
        size += len(body) + NODE_BYTES
        if size > 4 << 20:
            yield _columns(rows, _PART)
            rows, size = [], 0
    if rows:
        yield _columns(rows, _PART)


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trie = PatriciaTrie()
    for batch in batches:
        text = batch.column(1).fill_null("")
        points = pc.utf8_length(text).to_pylist()
        for doc_id, raw, cp in zip(batch.column(0).to_pylist(), text.cast(pa.binary()).to_pylist(), points, strict=True):
            trie.insert(raw.translate(None, WHITE_SPACE.encode()), cp, doc_id)
        if trie.bytes > trie.most:
            yield from _parts(trie.spilled())
    yield from _parts(trie.terminals())


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Owners of a partition sorted by (len, hash): strings of an earlier key than the last are finished."""
    trie, key = PatriciaTrie(), None

    def owners(terminals: Iterator[tuple[bytes, tuple]]) -> Iterator[pa.RecordBatch]:
        rows = []
        for body, (points, doc_id, members) in terminals:
            rows.append((len(body), hashlib.sha256(body).hexdigest(), points, doc_id, members))
            if len(rows) == 10_000:
                yield _columns(rows, _OWNER)
                rows = []
        if rows:
            yield _columns(rows, _OWNER)

    for batch in batches:
        for length, h, body, points, doc_id, members in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (length, h) != key:
                key = (length, h)
                if trie.bytes > trie.most:
                    yield from owners(trie.spilled())
            trie.insert(body, points, doc_id, members)
    yield from owners(trie.terminals())


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), WHITE_SPACE, "")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    ``kept`` marks the owner: the row with its id and its number of code points;
    where several rows have both, all of them are marked.
    """
    spark = docs.sparkSession
    sized_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parts = arrow_map(rows, _local, _PART)
    owners = written(arrow_map(parts.repartition("len", "hash").sortWithinPartitions("len", "hash"), _merge, _OWNER), "owners")
    body = normalised(F.col("text"))
    members = rows.select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("points"), F.octet_length(body).cast("long").alias("len"), F.sha2(body, 256).alias("sha"))
    joined = join_groups(members, owners, ["len", "sha"], "group_size", "doc_id")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("code_points"))
    return joined.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"))
