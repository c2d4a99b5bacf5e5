"""Joins that Spark has no single operator for."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.operators.sorting import pg_order


def using(left: DataFrame, right: DataFrame, columns: list[str], how: str = "inner") -> DataFrame:
    """JOIN … USING: the named columns once (coalesced for outer joins), then the rest of both sides."""
    return left.join(right, columns, how)


def natural(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """NATURAL JOIN on all columns of the same name; a cross join if there are none, as the standard says."""
    common = [c for c in left.columns if c in set(right.columns)]
    return using(left, right, common, how) if common else left.crossJoin(right)


def semi(left: DataFrame, right: DataFrame, on: Column | list[str]) -> DataFrame:
    """WHERE EXISTS."""
    return left.join(right, on, "left_semi")


def anti(left: DataFrame, right: DataFrame, on: Column | list[str]) -> DataFrame:
    """WHERE NOT EXISTS."""
    return left.join(right, on, "left_anti")


def not_in(left: DataFrame, value: str, right: DataFrame, member: str) -> DataFrame:
    """WHERE value NOT IN (SELECT member …), three-valued: nothing if member holds a null, nulls in value only if right is empty.

    Two flags of the right side (has rows, has nulls) decide; the join itself stays a hashable anti join.
    """
    flags = right.agg(F.count("*").alias("n"), F.count_if(F.col(member).isNull()).alias("nulls")).first()
    if flags["n"] == 0:
        return left
    if flags["nulls"]:
        return left.limit(0)
    return left.where(F.col(value).isNotNull()).join(right.select(F.col(member).alias(value)).distinct(), value, "left_anti")


def quantified(left: DataFrame, x: str, op: str, how: str, right: DataFrame, member: str, name: str) -> DataFrame:
    """left with `name`: x op ANY | ALL (SELECT member …), three-valued.

    All but = ANY and <> ALL need only the ends of the members (one row, broadcast); these two ask whether x is one of them.
    """
    m = F.col(member)
    ends = right.agg(F.min(m).alias("__low__"), F.max(m).alias("__high__"), F.count("*").alias("__n__"), F.count_if(m.isNull()).alias("__nulls__"))
    rows, v, low, high = left.crossJoin(F.broadcast(ends)), F.col(x), F.col("__low__"), F.col("__high__")
    how = how.lower()
    if (op, how) in (("=", "any"), ("<>", "all")):
        members = right.where(m.isNotNull()).select(m.alias("__m__")).distinct()
        rows = rows.join(members, v == F.col("__m__"), "left")
        held = F.col("__m__").isNotNull()
        some = held if how == "any" else ~held
        sure = held
    else:
        ends_of = {(">", "any"): v > low, (">=", "any"): v >= low, ("<", "any"): v < high, ("<=", "any"): v <= high, ("<>", "any"): (v != low) | (v != high), (">", "all"): v > high, (">=", "all"): v >= high, ("<", "all"): v < low, ("<=", "all"): v <= low, ("=", "all"): (v == low) & (v == high)}
        some = ends_of[op, how]
        sure = some if how == "any" else ~some
    unknown = v.isNull() | ((F.col("__nulls__") > 0) & ~F.coalesce(sure, F.lit(False)))
    value = F.when(F.col("__n__") == 0, F.lit(how == "all")).when(~unknown, some)
    return rows.select(*[F.col(f"`{c}`") for c in left.columns], value.alias(name))


def lateral_top_n(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], order: list[str], n: int, outer: bool = False) -> DataFrame:
    """[LEFT] JOIN LATERAL (SELECT … WHERE right.k = left.k ORDER BY order LIMIT n): ranked once per key, then an equi-join."""
    keys = [r for _, r in on]
    w = Window.partitionBy(*keys).orderBy(*pg_order(*order))
    best = right.withColumn("__n__", F.row_number().over(w)).where(F.col("__n__") <= n).drop("__n__")
    cond = [left[a] == best[b] for a, b in on]
    return left.join(best, cond, "left" if outer else "inner")


def asof(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, take: list[str], cell: Callable[[Column], Column] | None = None) -> DataFrame:
    """Each left row with the columns `take` of the last right row of the same key at or before its time (null if none).

    One shuffle and a running last value over both sides together, instead of a range join. `cell` cuts a key's
    time into ordered stretches (lambda t: F.date_trunc("day", t)), each a task's work by itself, to which
    the last row of the stretches before is handed on: no key is one task.
    """
    pick = F.struct(F.col(right_time), *[F.col(c) for c in take])
    r = right.na.drop(subset=[*by, right_time]).select(*by, F.col(right_time).alias("__t__"), F.lit(0).alias("__side__"), pick.alias("__right__"), F.lit(None).cast(left.select(F.struct("*").alias("s")).schema["s"].dataType).alias("__left__"))
    lf = left.select(*by, F.col(left_time).alias("__t__"), F.lit(1).alias("__side__"), F.lit(None).cast(r.schema["__right__"].dataType).alias("__right__"), F.struct("*").alias("__left__"))
    both = r.unionByName(lf).withColumn("__cell__", cell(F.col("__t__")) if cell else F.lit(0))
    keys = [*by, "__cell__"]
    w = Window.partitionBy(*keys).orderBy(F.col("__t__").asc_nulls_first(), "__side__").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("__right__", F.last("__right__", ignorenulls=True).over(w)).where(F.col("__side__") == 1)
    if cell:
        ends = both.groupBy(*keys).agg(F.max_by("__right__", F.when(F.col("__side__") == 0, F.col("__t__"))).alias("__end__"))
        before = Window.partitionBy(*by).orderBy(F.col("__cell__").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.withColumn("__end__", F.last("__end__", ignorenulls=True).over(before)).where("__end__ is not null")
        ends = ends.select(*[F.col(k).alias(f"__e{i}__") for i, k in enumerate(keys)], "__end__")
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__e{i}__")) for i, k in enumerate(keys)])
        out = out.join(ends, same, "left").withColumn("__right__", F.when(F.col("__t__").isNotNull(), F.coalesce("__right__", "__end__")))
    return out.select("__left__.*", F.col(f"__right__.{right_time}").alias(f"asof_{right_time}"), *[F.col(f"__right__.{c}").alias(c) for c in take])


def interval_join(points: DataFrame, spans: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """points with low <= point < high, as an equi-join on buckets of the given width: no nested loop.

    A span is copied to each bucket that it crosses, so choose a width near the usual span.
    """
    cell = F.floor(F.col(point) / F.lit(width)).alias("__cell__")
    cells = F.explode(F.sequence(F.floor(F.col(low) / F.lit(width)), F.floor(F.col(high) / F.lit(width))))
    p = points.withColumn("__cell__", cell)
    s = spans.where(F.col(low) < F.col(high)).withColumn("__cell__", cells)
    return p.join(s, "__cell__").where((F.col(low) <= F.col(point)) & (F.col(point) < F.col(high))).drop("__cell__")
