"""The dashboard's counts over a stream of analyses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.staging import new_path


def windowed_counts(events: DataFrame, ts: str = "ts", late: str = "1 hour", window: str = "1 day", key: str = "event_type") -> DataFrame:
    """Counts by tumbling window and type; rows later than ``late`` no longer change a window."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window).alias("window"), key).agg(F.count(F.lit(1)).alias("n"))


def user_counts(events: DataFrame, user: str = "user_id") -> DataFrame:
    """Running count of analyses per user, for update mode."""
    return events.groupBy(user).agg(F.count(F.lit(1)).alias("analysis_count"))


def distinct_events(events: DataFrame, key: str = "event_id", ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Without repeats of a key that come within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def settled(counts: DataFrame, label: str, value: str) -> DataFrame:
    """Run a streaming aggregate over all that is there now, in update mode; the last ``value`` of each other column.

    A micro-batch writes the rows that it changed to a folder of its own in the shared folder, so a batch that is run
    again replaces what it wrote, and neither state nor output is kept for windows that the watermark has closed.
    """
    spark = counts.sparkSession
    path = new_path(spark, label)
    spark.createDataFrame([], counts.schema).write.parquet(f"{path}/batch=-1")

    def put(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={k}")

    query = counts.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", new_path(spark, f"{label}-log")).trigger(availableNow=True).start()
    query.awaitTermination()
    changed = spark.read.option("basePath", path).parquet(path)
    keys = [c for c in counts.columns if c != value]
    return changed.groupBy(*keys).agg(F.max_by(value, "batch").alias(value))
