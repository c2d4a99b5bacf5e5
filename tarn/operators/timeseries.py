"""Time buckets, gap filling and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def date_bin(seconds: int, ts: Column, origin: str = "2000-01-01 00:00:00") -> Column:
    """date_bin(stride, ts, origin) for strides of a fixed length; the session's zone must be UTC."""
    o, k = micros(F.lit(origin).cast("timestamp_ntz")), seconds * 1_000_000
    return F.timestamp_micros(o + F.floor((micros(ts) - o) / F.lit(k)) * k).cast("timestamp_ntz")


def gap_fill(df: DataFrame, keys: list[str], bucket: str, seconds: int) -> DataFrame:
    """df with a row for each bucket between the first and last of its key; other columns are null in added rows."""
    ends = df.groupBy(*keys).agg(F.min(bucket).alias("__a__"), F.max(bucket).alias("__b__"))
    every = ends.select(*keys, F.explode(F.sequence("__a__", "__b__", F.expr(f"interval {seconds} seconds"))).alias(bucket))
    return every.join(df, [*keys, bucket], "left")


def sessions(df: DataFrame, keys: list[str], ts: str, gap_seconds: int, tie: str, name: str = "session_no") -> DataFrame:
    """df with the number of its session: a new one begins after a gap of more than gap_seconds."""
    w = Window.partitionBy(*keys).orderBy(ts, tie)
    gap = micros(F.col(ts)) - micros(F.lag(ts).over(w))
    new = F.when(gap.isNull() | (gap > gap_seconds * 1_000_000), 1).otherwise(0)
    return df.withColumn("__new__", new).withColumn(name, F.sum("__new__").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new__")
