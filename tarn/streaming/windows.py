"""Event-time windows as Structured Streaming: the same functions take a batch or a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def events_stream(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """A folder of Parquet files as a stream, with the schema of what lies there."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def _timed(df: DataFrame, ts: str, late: str) -> DataFrame:
    df = df.withColumn(ts, F.col(ts).cast("timestamp"))
    return df.withWatermark(ts, late) if df.isStreaming else df


def tumbling(df: DataFrame, ts: str, size: str, keys: list[str], *aggs: Column, late: str = "1 hour") -> DataFrame:
    """Aggregates by window of `size` and keys; a stream's windows close `late` after their end."""
    out = _timed(df, ts, late).groupBy(F.window(ts, size), *keys).agg(*aggs)
    return out.select(F.col("window.start").alias("window_start"), *keys, *out.columns[1 + len(keys) :])


def sliding(df: DataFrame, ts: str, size: str, slide: str, keys: list[str], *aggs: Column, late: str = "1 hour") -> DataFrame:
    out = _timed(df, ts, late).groupBy(F.window(ts, size, slide), *keys).agg(*aggs)
    return out.select(F.col("window.start").alias("window_start"), *keys, *out.columns[1 + len(keys) :])


def session(df: DataFrame, ts: str, gap: str, keys: list[str], *aggs: Column, late: str = "1 hour") -> DataFrame:
    out = _timed(df, ts, late).groupBy(F.session_window(ts, gap), *keys).agg(*aggs)
    return out.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *keys, *out.columns[1 + len(keys) :])


def deduplicated(df: DataFrame, ts: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    df = _timed(df, ts, late)
    return df.dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)
