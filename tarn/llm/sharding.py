"""Uniform shuffle into shards of exact sizes through a hypergeometric communication matrix.

Rows lie in buckets of a random hash. How many rows of each bucket go to each shard is drawn
exactly (multivariate hypergeometric, so all assignments are equally likely), every bucket
permutes its rows and deals them out by those counts, and each shard permutes what it got.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.common import Scratch, maybe_broadcast, numbered, packed, sqrt_bits, stage, top_bits, unpacked


def hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """How many of `sample` draws without replacement are good; by inversion where NumPy's range ends."""
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, sample))
    low, high = max(0, sample - bad), min(sample, good)
    p, n = good / (good + bad), good + bad
    mean, sd = sample * p, math.sqrt(max(1.0, sample * p * (1 - p) * (n - sample) / max(1, n - 1)))
    k = np.arange(max(low, int(mean - 40 * sd)), min(high, int(mean + 40 * sd) + 1) + 1)
    step = np.log(good - k[:-1]) + np.log(sample - k[:-1]) - np.log(k[1:]) - np.log(bad - sample + k[1:])
    log_p = np.concatenate(([0.0], np.cumsum(step)))
    cdf = np.cumsum(np.exp(log_p - log_p.max()))
    return int(k[np.searchsorted(cdf, rng.random() * cdf[-1])])


def matrix(counts: np.ndarray, shards: np.ndarray, seed: int) -> np.ndarray:
    """Exact counts from each bucket (row) to each shard (column) with the given sums."""
    rng, left, out = np.random.default_rng(seed), shards.astype(object), np.zeros((len(counts), len(shards)), np.int64)
    for i, n in enumerate(counts.tolist()):
        rest = int(left.sum())
        for s in range(len(shards)):
            if n == 0:
                break
            rest -= int(left[s])
            x = hypergeometric(rng, int(left[s]), rest, n) if rest else n
            out[i, s] = x
            left[s] -= x
            n -= x
    return out


def shuffle_into_shards(df: DataFrame, key: list[Column], n_shards: int = 16, seed: int = 1) -> DataFrame:
    """df with shard (0 to n_shards - 1; sizes at most one apart) and slot (gapless from 0 in each shard).

    key: what tells rows apart; it decides, with `seed`, where a row goes. Rows with the same
    key are interchangeable and get different slots. Nulls in the key are values like others;
    an empty table gives an empty one. Columns of df named shard or slot are replaced.
    Bucket counts on the driver and rows in a bucket are each about the square root of the rows.
    """
    spark = df.sparkSession
    scratch = Scratch(spark)
    base = scratch.stage(df.select(packed(df), F.xxhash64(F.lit(seed), *key).alias("h1"), F.xxhash64(F.lit(seed + 1), *key).alias("h2")), "shard-rows")
    repeated = base.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1")
    base = numbered(base, ["h1", "h2"], repeated)  # rows with the same key go separate ways
    base = base.select("row", *[F.when(F.col("copy") == 1, F.col(h)).otherwise(F.xxhash64(h, "copy")).alias(h) for h in ("h1", "h2")])
    n = base.count()
    base = base.withColumn("bucket", top_bits("h1", sqrt_bits(n)))
    counts = sorted(base.groupBy("bucket").count().collect())
    sizes = np.array([n // n_shards + (s < n % n_shards) for s in range(n_shards)], np.int64)
    bounds = np.cumsum(matrix(np.array([r["count"] for r in counts], np.int64), sizes, seed), axis=1)
    deal = spark.createDataFrame([(r["bucket"], b) for r, b in zip(counts, bounds.tolist())], "bucket long, bounds array<long>")
    local = F.row_number().over(Window.partitionBy("bucket").orderBy("h1", "h2"))
    dealt = base.withColumn("place", local).join(maybe_broadcast(deal), "bucket")
    dealt = dealt.withColumn("shard", F.size(F.filter("bounds", lambda b: b < F.col("place"))))
    bits = sqrt_bits(max(1, n // n_shards))
    dealt = stage(dealt.select("row", "h1", "h2", "shard").withColumn("part", top_bits("h2", bits)), "shard-dealt")
    scratch.drop()

    offsets = dealt.groupBy("shard", "part").count()
    before = F.sum("count").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = offsets.select("shard", "part", F.coalesce(before, F.lit(0)).alias("before"))
    slot = F.col("before") + F.row_number().over(Window.partitionBy("shard", "part").orderBy("h2", "h1")) - 1
    placed = dealt.join(offsets, ["shard", "part"]).withColumn("slot", slot.cast("long"))
    return unpacked(placed, F.col("shard"), F.col("slot"))
