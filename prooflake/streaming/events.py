"""An incremental count of events by day and type: a file stream with a watermark, run until the files are used up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def daily_counts(events: DataFrame, watermark: str = "1 day") -> DataFrame:
    """(day, event_type, n) of a static or streaming table with ts and event_type."""
    rows = events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    if events.isStreaming:
        rows = rows.withWatermark("ts", watermark)
    return rows.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("date").alias("day"), "event_type", "n")


def run_available(spark: SparkSession, folder: str, target: str, checkpoint: str, pattern: str = "events*.parquet") -> DataFrame:
    """All files that match, through the stream, into target; days that the watermark has not closed stay in the state."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    stream = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)
    query = daily_counts(stream).writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)
    query.awaitTermination()
    return spark.read.schema("day date, event_type string, n long").parquet(target)
