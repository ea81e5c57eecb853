"""Global order without a window over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from knotwork.sources.shared import kept

#: Rows of a partition where sizes in bytes tell little, as numbers that stand close together shrink to a few bytes each.
PART_ROWS = 2_000_000


def numbered(df: DataFrame, *order: Column, name: str = "position") -> DataFrame:
    """Rows with their place (from 1) in a global order that has no ties."""
    return summed_before(df, F.lit(1), *order, name=name).withColumn(name, F.col(name) + 1)


def parts(*frames: DataFrame, rows_each: int = PART_ROWS) -> int:
    """Into how many partitions rows are dealt so that one has about ``rows_each``, and no fewer than shuffles have."""
    rows = sum(df.count() for df in frames)
    return max(int(frames[0].sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_each))


def dealt_join(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """Join of two sides that grow with the input, dealt by the keys.

    Spark else sends a side of few bytes to the driver and every task, and bytes as written tell little:
    rows that repeat each other come to tens of times as much in memory.
    """
    return left.hint("merge").join(right, on, how)


def summed_before(df: DataFrame, value: Column, *order: Column, name: str = "before") -> DataFrame:
    """Rows with the sum of a whole number over those that stand before them in a global order without ties.

    Range partitions are sorted and summed each; what stands before a partition is added
    from the partitions' sums, one row for each partition.
    """
    df = df.withColumn("_v", value.cast("long"))
    ranged = kept(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part").agg(F.sum("_v").alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    earlier = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    own = ranged.withColumn(name, F.coalesce(F.sum("_v").over(earlier), F.lit(0)))
    return own.join(F.broadcast(before), "_part").withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_before", "_v")
