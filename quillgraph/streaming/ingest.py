"""Incremental ingestion with Structured Streaming: late rows, repeated deliveries, windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 16, glob: str | None = None) -> DataFrame:
    """New parquet files of a folder, or those that ``glob`` names, a bounded number per micro-batch."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return (reader.option("pathGlobFilter", glob) if glob else reader).parquet(path)


def once(stream: DataFrame, key: str, time: str, late: str = "10 days") -> DataFrame:
    """Each key once, however often it is delivered within ``late``; state older than that is dropped."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp"))
    return timed.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def arrivals(stream: DataFrame, time: str, window: str = "1 day", late: str = "10 days", by: str | None = None) -> DataFrame:
    """Rows per tumbling window of event time, final once the watermark passed it."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    keys = [F.window(time, window).alias("w")] + ([F.col(by).alias(by)] if by else [])
    return timed.groupBy(*keys).agg(F.count("*").alias("n_rows")).select("w.start", *([by] if by else []), "n_rows")


def append_table(stream: DataFrame, path: str, checkpoint: str):
    """Run what is there into a parquet table and stop; a rerun continues where this one ended."""
    return stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
