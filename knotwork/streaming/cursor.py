"""Work in batches with a durable cursor: what a batch makes is kept under its number.

A log holds a folder of rows and a mark for each finished batch. A batch that was cut
off has no mark; it is done again under the same number and its rows take the place of
what was left of it, so nothing is there twice and nothing is lost, wherever the run
was stopped. Readers see finished batches only. Batches go in order, so the cursor is
one number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType


class Paused(Exception):
    """A run was asked to stop after a batch."""


class BatchLog:
    """Rows of finished batches in a shared folder."""

    def __init__(self, spark: SparkSession, folder: str, schema: str | StructType):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        # the mark of no batch lets the folder be read before the first one
        spark.range(1).select("id").write.mode("overwrite").parquet(f"{self.folder}/marks/batch=-1")
        spark.createDataFrame([], self.schema).write.mode("overwrite").parquet(f"{self.folder}/rows/batch=-1")

    def last(self) -> int:
        """The cursor: number of the last finished batch, -1 before the first."""
        return self.spark.read.schema("id long, batch int").parquet(f"{self.folder}/marks").agg(F.max("batch")).first()[0]

    def put(self, batch: int, rows: DataFrame) -> None:
        rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema]).write.mode("overwrite").parquet(f"{self.folder}/rows/batch={batch}")
        self.spark.range(1).select("id").write.mode("overwrite").parquet(f"{self.folder}/marks/batch={batch}")

    def rows(self, before: int | None = None) -> DataFrame:
        """Rows of all finished batches, or of those before one; with their batch."""
        last = self.last() if before is None else before - 1
        whole = StructType([*self.schema.fields]).add("batch", IntegerType())
        return self.spark.read.schema(whole).parquet(f"{self.folder}/rows").where((F.col("batch") >= 0) & (F.col("batch") <= last))


def run_stream(rows: DataFrame, log: BatchLog, handle: Callable[[DataFrame, DataFrame], DataFrame], checkpoint: str, paused: Callable[[], bool] = lambda: False) -> bool:
    """Take a stream to the end of what is there; returns whether it got there.

    ``handle`` makes a batch's rows of the batch and the rows that earlier batches left.
    Spark's checkpoint keeps the place in the source and gives a batch that was cut off
    the same rows under the same number again. ``paused`` is asked after each batch; the
    run then stops as the next one begins, when Spark has checkpointed the last.
    """
    stop = []

    def each(batch: DataFrame, number: int) -> None:
        if stop:
            raise Paused
        if number > log.last():  # one that was put but not checkpointed stays as it is
            log.put(number, handle(batch, log.rows(number)))
        if paused():
            stop.append(number)

    query = rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except StreamingQueryException:
        if not stop:
            raise
        return False
    return True


def run_batches(n: int, log: BatchLog, handle: Callable[[int, DataFrame], DataFrame], paused: Callable[[], bool] = lambda: False) -> bool:
    """The same over batches that are numbered from 0 to n - 1, where their order matters."""
    for number in range(log.last() + 1, n):
        log.put(number, handle(number, log.rows(number)))
        if number + 1 < n and paused():
            return False
    return True


def backfilled(batch: DataFrame, missing: str, made) -> DataFrame:
    """Rows of a batch that lack a value, with the value made for them."""
    return batch.where(F.col(missing).isNull()).withColumn(missing, made)
