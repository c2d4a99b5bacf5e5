"""Mixing sources to target weights by weighted fair queueing.

Every draw of a document has a virtual finish time: the words its source has given up to and
including it, in a shuffled order, divided by the source's target. Draws are ordered by finish
time over all sources and cut where the budget is spent, so each source ends near its target.
Running sums are taken in two levels (buckets of a random hash, then rows of a bucket), both
about the square root of the rows, so that no task holds a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.common import Scratch, copies, maybe_broadcast, numbered, packed, sqrt_bits, stage, top_bits, unpacked


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, repeats: int = 2) -> DataFrame:
    """sizes(source, source_size, ...) with weight and target.

    Sources in code point order, null last, take the weights in turn. Targets share
    `share` of all sizes by weight, none above `repeats` times its source's size: the water
    level is the largest of the levels at which the first k sources (by cap over weight) are full.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    w = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((place - 1) % len(weights) + 1).cast("int")))
    w = w.withColumn("cap", F.col("source_size") * float(repeats)).withColumn("ratio", F.col("cap") / F.col("weight"))
    by = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    full = F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.orderBy("ratio").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = w.withColumn("level", (F.sum("source_size").over(everything) * float(share) - full) / open_weight)
    w = w.withColumn("target", F.least("cap", F.max("level").over(everything) * F.col("weight")))
    return w.drop("cap", "ratio", "level")


def mix(docs: DataFrame, size: Column, source: Column, key: list[Column], weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, repeats: int = 2, seed: int = 1) -> DataFrame:
    """docs with size, source_size, target and draws, the virtual finish times at which the mix takes the row.

    size: words of a row; key: what tells rows apart, hashed with `seed` into the shuffled
    order. A row is drawn up to `repeats` times, always whole. Rows of size 0 or of a source
    without words have no draws. Null sources are one source. Repeated rows are separate rows
    of the same place; equal finish times are ordered by hash. An empty table gives an empty one.
    Columns of docs with these names are replaced.
    """
    keys = [source.alias("source"), size.cast("long").alias("size"), F.xxhash64(F.lit(seed), *key).alias("h")]
    scratch = Scratch(docs.sparkSession)
    units = scratch.stage(docs.select(*keys).groupBy("source", "size", "h").agg(F.count("*").alias("m")), "mix-units")
    words = F.col("m") * F.col("size")
    sources = units.groupBy("source").agg(F.sum(words).alias("source_size"), F.sum("m").alias("n"))
    sources = stage(targets(sources, weights, share, repeats), "mix-sources")
    n, budget = sources.agg(F.sum("n"), F.sum("source_size")).first()
    bits, budget = sqrt_bits(n or 0), (budget or 0) * share

    units = units.withColumn("bucket", top_bits("h", bits))
    offsets = units.groupBy("source", "bucket").agg(F.sum(words).alias("s"))
    before = F.coalesce(F.sum("s").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = offsets.select(F.col("source").alias("o_source"), F.col("bucket").alias("o_bucket"), before.alias("before"))
    units = units.join(offsets, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("bucket") == F.col("o_bucket"))).drop("o_source", "o_bucket")
    inside = Window.partitionBy("source", "bucket").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, -1)
    units = units.withColumn("given", F.col("before") + F.coalesce(F.sum(words).over(inside), F.lit(0))).drop("before", "bucket")
    small = maybe_broadcast(sources.select(F.col("source").alias("t_source"), "source_size", "target"))
    units = stage(units.join(small, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source"), "mix-given")
    scratch.drop()

    def finish(copy: Column) -> Column:
        return F.array(*[(F.col("given") + copy * F.col("size") + k * F.col("source_size")) / F.col("target") for k in range(repeats)])

    drawn = (F.col("target") > 0) & (F.col("size") > 0)
    draws = copies(units.where(drawn), "m").select("h", "size", F.explode(finish(F.col("copy"))).alias("f")).withColumn("grid", F.floor(F.col("f") * float(1 << bits)))
    grid = draws.groupBy("grid").agg(F.sum("size").alias("s"))
    grid = grid.select("grid", "s", F.sum("s").over(Window.orderBy("grid").rowsBetween(Window.unboundedPreceding, 0)).alias("run"))
    over = grid.where(F.col("run") > F.lit(budget)).agg(F.min_by(F.struct("grid", (F.col("run") - F.col("s")).alias("before")), "grid").alias("x")).first()["x"]
    taken = finish(F.col("copy"))
    if over is not None:
        run = F.sum("size").over(Window.orderBy("f", "h", "size").rowsBetween(Window.unboundedPreceding, 0)) + F.lit(over["before"])
        last = draws.where(F.col("grid") == over["grid"]).select("f", "h", run.alias("run")).where(F.col("run") <= F.lit(budget))
        last = last.agg(F.max(F.struct("f", "h")).alias("x")).first()["x"]

        def accepted_at(f: Column) -> Column:
            if last is None:
                return F.floor(f * float(1 << bits)) < F.lit(over["grid"])
            return (f < F.lit(last["f"])) | ((f == F.lit(last["f"])) & (F.col("h") <= F.lit(last["h"])))

        taken = F.filter(taken, accepted_at)

    # whole rows travel once, to the numbers of their key; only repeated rows have to be told apart
    known = units.withColumnsRenamed({"source": "u_source", "size": "u_size", "h": "u_h"})
    same = (F.col("h") == F.col("u_h")) & (F.col("size") == F.col("u_size")) & F.col("source").eqNullSafe(F.col("u_source"))
    rows = numbered(docs.select(packed(docs), *keys), ["h", "size", "source"], units.where("m > 1")).join(known, same)
    rows = rows.withColumn("draws", F.when(drawn, taken).otherwise(F.array().cast("array<double>")))
    return unpacked(rows, F.col("size"), F.col("source_size"), F.col("target"), F.col("draws"))


def in_order(mixed: DataFrame) -> DataFrame:
    """The mix as a training sequence: one row a draw, range-sorted by its finish time (column `finish`)."""
    drawn = mixed.withColumn("finish", F.explode("draws")).drop("draws")
    return drawn.repartitionByRange(F.col("finish")).sortWithinPartitions("finish")
