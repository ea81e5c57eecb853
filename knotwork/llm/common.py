"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows and bytes of one Arrow batch: whole texts are long, so few rows go at once.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def sized_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch of whole texts can take in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); a temporary one only in local mode, where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="knotwork-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage: a lost executor costs no recomputation of what is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string or binary column and the n + 1 offsets of its rows (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def row_slices(offs: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes each; a longer row stands alone."""
    n, i = len(offs) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        j = min(j, n)
        yield i, j
        i = j


def batches_by_key(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Regroup sorted batches so that all rows of a key stand in one table.

    A table holds the whole groups of about one batch; many small groups cost
    no call each. The input must be sorted by ``keys`` within the partition.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cut = _last_change(batch, keys)
        if held and cut == 0 and not _same_key(held[-1], batch, keys):
            yield pa.Table.from_batches(held)
            held = []
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _same_key(a: pa.RecordBatch, b: pa.RecordBatch, keys: list[str]) -> bool:
    return all(a.column(k)[a.num_rows - 1].as_py() == b.column(k)[0].as_py() for k in keys)


def _last_change(batch: pa.RecordBatch, keys: list[str]) -> int:
    """Row at which the last key of the batch begins."""
    last = [batch.column(k)[batch.num_rows - 1].as_py() for k in keys]
    low, high = 0, batch.num_rows - 1  # sorted, so the last key's rows are a suffix
    while low < high:
        mid = (low + high) // 2
        if [batch.column(k)[mid].as_py() for k in keys] == last:
            high = mid
        else:
            low = mid + 1
    return low


def row_of(docs: DataFrame) -> Column:
    """A document's whole row as one column ``row``, so that it travels with what is found out about it."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("row")


def with_row(schema: str, docs: DataFrame, rows: bool = True) -> StructType:
    """A schema, with that column at its end if ``rows``."""
    made = StructType.fromDDL(schema)
    return made.add("row", docs.schema) if rows else made


#: A group is hot if more than one in so many rows belong to it; its rows are dealt over so many tasks.
HOT, SALTS = 1000, 64


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, spread: str) -> DataFrame:
    """Left join of rows with one row for each group (written before; ``size``: its rows).

    Hot groups are fewer than HOT, whatever the size of the table, so their keys
    are broadcast; their rows are dealt by a hash of ``spread`` and meet a copy of
    the group's row in each task.
    """
    total = groups.agg(F.sum(size).alias("n")).first().n or 0
    hot = F.broadcast(groups.where(F.col(size) * HOT > total).select(*keys, F.lit(SALTS).alias("_salts")))
    salted = rows.join(hot, keys, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(spread), "_salts").cast("int"), F.lit(0))).drop("_salts")
    copies = groups.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return salted.join(copies.hint("merge"), [*keys, "_salt"], "left").drop("_salt")


#: What lets go of memory that a Python worker keeps for the next task of its kind.
_FORGET: list[Callable[[], None]] = []


def forgettable(cached):
    """Have a cached function's cache emptied in workers that turn to other tasks."""
    _FORGET.append(cached.cache_clear)
    return cached


def forget() -> None:
    for clear in _FORGET:
        clear()
    gc.collect()
    pa.default_memory_pool().release_unused()


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType, tokens: bool = False) -> DataFrame:
    """``mapInArrow``. Workers go from one stage to the next; those that don't take ``tokens`` let go of tokenizers first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not tokens:
            forget()
        yield from fn(batches)

    return df.mapInArrow(run, schema)
