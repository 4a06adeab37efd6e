"""The service's event log as a stream: latency by window, event and status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.sources.schemas import EVENT


def log_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New JSON-lines files of a folder as they come."""
    return spark.readStream.schema(EVENT).json(folder)


def latency(df: DataFrame, time: str, by: list[str], value: str, window: str = "1 hour", late: str | None = None) -> DataFrame:
    """(window_start, by, n, mean_latency, max_latency); works on streams, with `late` as watermark, and on tables."""
    df = df.withWatermark(time, late) if late else df
    grouped = df.groupBy(F.window(time, window).alias("w"), *by)
    out = grouped.agg(F.count("*").alias("n"), F.avg(value).alias("mean_latency"), F.max(value).alias("max_latency"))
    return out.select(F.col("w.start").alias("window_start"), *by, "n", "mean_latency", "max_latency")
