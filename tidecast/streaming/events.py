"""An extension: events as a stream, with late rows bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema, max_files: int = 64) -> DataFrame:
    """Events from a growing folder of Parquet files; ts becomes a timestamp, which a watermark asks for."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, event_type, n, total) by window; works on streams and tables alike."""
    by = events.withWatermark("ts", late) if events.isStreaming else events
    return by.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def run_once(result: DataFrame, path: str, checkpoint: str) -> None:
    """All data there is now, then stop; windows that the watermark has passed are appended as Parquet."""
    result.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
