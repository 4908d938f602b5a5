"""Decisions in force from a growing log, as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def latest_stream(log: DataFrame, by: str, order: str, values: list[str]) -> DataFrame:
    """The last version of each key of a streaming log; run it in update or complete mode."""
    return log.groupBy(by).agg(F.max_by(F.struct(order, *values), order).alias("r")).select(by, "r.*")


def windowed_counts(events: DataFrame, every: str = "1 hour", late: str = "30 minutes", time: str = "ts", by: str = "event_type") -> DataFrame:
    """Counts by window and key, closed when the watermark has passed."""
    return events.withWatermark(time, late).groupBy(F.window(time, every).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def upsert_stream(log: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends each batch to a table with its batch number, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return log.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
