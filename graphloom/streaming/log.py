"""A stream of extraction results into a last-write-wins table, an extension of the batch log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str = "ts", kind: str = "event_type", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per window and kind of a stream or a table; a stream waits `late` for late rows."""
    if events.isStreaming:
        events = events.withWatermark(time, late)
    return events.groupBy(F.window(time, width).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")


def upsert_stream(results: DataFrame, table: str, checkpoint: str):
    """Append each micro-batch once to a Parquet table, with its batch number as the sequence that readers order by."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("seq", F.lit(number)).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return results.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
