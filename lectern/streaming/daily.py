"""Running counts of a stream of dated events: the daily counts, kept up to date with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def daily_counts(events: DataFrame, at: str = "ts", kind: str = "event_type", late: str = "2 days") -> DataFrame:
    """Counts by day and kind; days older than the watermark are final and leave the state."""
    stamped = events.withColumn(at, F.col(at).cast("timestamp"))
    return stamped.withWatermark(at, late).groupBy(F.window(at, "1 day").alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.to_date("w.start").alias("day"), kind, "n")
