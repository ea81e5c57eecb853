"""Token identifiers as fixed-width bit-packed blocks, written and read by Spark.

File format: a folder of Parquet files, one row per block, so any store Spark
reads will do and a lost task is written again by Spark's own commit. A block
holds whole documents of one shard (shards are ranges of doc_id): ``shard``,
``block``, ``first_id`` (place of its first identifier in the shard), ``width``
(bits per identifier: the fewest that hold the vocabulary), ``n_ids``,
``doc_ids``, ``doc_starts`` (n + 1 places in the block) and ``payload``, where
identifier i takes bits i * width to (i + 1) * width, lowest bit first. Eight
identifiers fill ``width`` whole bytes, so any range is read without the rest.

Defined cases: a null or empty text is the end identifier alone; documents stand
in ascending doc_id order, nulls first; rows that repeat an id stand side by side
in the order of their texts' hashes; other columns are ignored; an empty table
gives no blocks.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from knotwork.llm.common import arrow_map, sized_batches
from knotwork.llm.encoding import encode_column

#: Identifiers at which a block is closed; a longer document has a block of its own.
BLOCK_IDS = 1 << 16
BLOCK_SCHEMA = "shard int, block int, first_id long, width int, n_ids long, doc_ids array<long>, doc_starts array<long>, payload binary"


def vocabulary_bits(tokenizer_path: str) -> int:
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = json.load(f)
    most = max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])])
    return max(1, int(most).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    flat = np.ascontiguousarray(ids, "<u4")
    if width % 8 == 0:
        return np.ascontiguousarray(flat.view(np.uint8).reshape(-1, 4)[:, : width // 8]).tobytes()
    bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(bits[:, :width], axis=None, bitorder="little").tobytes()


def unpack(payload: bytes, width: int, start: int, stop: int) -> np.ndarray:
    """Identifiers start to stop of a block, reading only their bytes."""
    n = stop - start
    if width % 8 == 0:
        step = width // 8
        wide = np.zeros((n, 4), np.uint8)
        wide[:, :step] = np.frombuffer(payload, np.uint8, n * step, start * step).reshape(n, step)
        return wide.reshape(-1).view("<u4")
    group = start // 8
    raw = np.frombuffer(payload, np.uint8, offset=group * width, count=min(len(payload), -(-stop // 8) * width) - group * width)
    bits = np.unpackbits(raw, bitorder="little")[(start - group * 8) * width :][: n * width].reshape(n, width)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :width] = bits
    return np.packbits(wide, axis=1, bitorder="little").reshape(-1).view("<u4")


def write_store(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    spark = docs.sparkSession
    sized_batches(spark)
    width = vocabulary_bits(tokenizer_path)
    end = np.array([end_id], "<u4").tobytes()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        number, first, doc_ids, parts, starts = 0, 0, [], [], [0]

        def closed() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(parts), "<u4")
            row = [shard, number, first, width, len(ids), doc_ids, starts, pack(ids, width)]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.record_batch([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=[c.split()[0] for c in BLOCK_SCHEMA.split(", ")])

        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), encode_column(batch.column(1), tokenizer_path), strict=True):
                doc_ids.append(doc_id)
                parts.append(raw + end)
                starts.append(starts[-1] + len(raw) // 4 + 1)
                if starts[-1] >= BLOCK_IDS:
                    yield closed()
                    number, first = number + 1, first + starts[-1]
                    doc_ids, parts, starts = [], [], [0]
        if doc_ids:
            yield closed()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    keyed = rows.withColumn("tie", F.xxhash64("text"))
    ranged = keyed.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    arrow_map(ranged, blocks, BLOCK_SCHEMA, tokens=True).write.mode("overwrite").parquet(path)


def read_store(df: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the blocks read back.

    Shard totals (one small row a shard) give each shard's place in the whole.
    """
    totals = df.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    order = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("shard", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("shard_start"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, width, doc_ids, starts, payload, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = unpack(payload, width, 0, starts[-1])
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, starts[1:], strict=False)]
                at = np.array(starts, np.int64)
                yield pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array(at[:-1] + first + base), pa.array(np.diff(at)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    blocks = df.join(offsets, "shard").select("first_id", "width", "doc_ids", "doc_starts", "payload", "shard_start")
    return arrow_map(blocks, digests, "doc_id long, start long, n_tokens long, ids_crc32 long")


def fetch(df: DataFrame, doc_id: int, start: int, stop: int) -> list[int]:
    """Random access: identifiers start to stop of one document, by its block's offsets."""
    row = df.where(F.array_contains("doc_ids", doc_id)).select("width", "doc_ids", "doc_starts", "payload").first()
    if row is None:
        return []
    k = row.doc_ids.index(doc_id)
    low, high = row.doc_starts[k], row.doc_starts[k + 1]
    return unpack(row.payload, row.width, min(low + start, high), min(low + stop, high)).tolist()
