"""Event-time windows over streams of Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream(spark: SparkSession, folder: str, schema, files_a_trigger: int = 1) -> DataFrame:
    """Files of a folder as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(folder)


def windowed(events: DataFrame, time: str, width: str, late: str, *keys: str, value: str) -> DataFrame:
    """Counts and sums of a value by window and keys; rows later than the watermark are left out."""
    at = F.col(time).cast("timestamp")
    grouped = events.withColumn(time, at).withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *keys)
    return grouped.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")
