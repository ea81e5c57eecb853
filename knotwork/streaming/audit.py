"""Change-log streams (an extension: the batch engine has no event-time operators of its own).

The log's retention is the watermark, so state for expired windows goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, per_trigger: int = 10, pattern: str = "events*.parquet") -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", pattern).parquet(folder)


def action_counts(events: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events per window and type; rows later than the watermark are dropped."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def append_changes(events: DataFrame, path: str, checkpoint: str):
    """Append a stream to the log exactly once; run to the end of what is there."""
    return events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
