"""Streams of requests: counts of status codes in windows, late rows within the watermark. An extension beyond batch reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def status_counts(requests: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, status_code, n) of a stream or table of (created_at timestamp, status_code)."""
    timed = requests.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", late)
    return timed.groupBy(F.window("created_at", window).alias("w"), "status_code").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "status_code", "n")


def flushed(stream: DataFrame, folder: str, checkpoint: str, every: str | None = None):
    """Start writing the stream to `folder`, a batch each `every`, or all that is there once. A batch that runs again replaces its own files."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def first_seen(requests: DataFrame, late: str = "2 days") -> DataFrame:
    """The stream with one row for each id within the watermark."""
    return requests.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", late).dropDuplicatesWithinWatermark(["id"])
