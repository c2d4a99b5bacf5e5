"""Aggregates with PostgreSQL's rules: nulls kept by array_agg, ordered input, hypothetical sets, ranges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def array_agg(x: Column, *order: Column) -> Column:
    """array_agg(x ORDER BY order): nulls stay; null (not an empty array) over no rows."""
    rows = F.collect_list(F.struct(*[o.alias(f"k{i}") for i, o in enumerate(order)], x.alias("x")))
    rows = F.array_sort(rows) if order else rows
    return F.when(F.count(F.lit(1)) > 0, F.transform(rows, lambda r: r["x"]))


def string_agg(x: Column, delimiter: str, *order: Column) -> Column:
    """string_agg(x, delimiter ORDER BY order): nulls are left out; null if nothing is left."""
    rows = F.collect_list(F.when(x.isNotNull(), F.struct(*[o.alias(f"k{i}") for i, o in enumerate(order)], x.cast("string").alias("x"))))
    joined = F.array_join(F.transform(F.array_sort(rows), lambda r: r["x"]), delimiter)
    return F.when(F.count(x) > 0, joined)


def json_agg(x: Column, *order: Column) -> Column:
    """json_agg(x ORDER BY order): JSON text of an array, nulls as null."""
    return F.to_json(array_agg(x, *order), {"ignoreNullFields": "false"})


def _json_value(x: Column) -> Column:
    """JSON text of a value, null as null."""
    listed = F.to_json(F.array(x), {"ignoreNullFields": "false"})
    return F.substring(listed, 2, 1 << 30).substr(F.lit(1), F.length(listed) - 2)


def json_object_agg(key: Column, value: Column, unique: bool = False) -> Column:
    """json_object_agg(key, value), in key order; a key that repeats stays as often, or (`unique`, as in jsonb) with its largest value."""
    entries = F.array_sort(F.collect_list(F.struct(key.cast("string").alias("key"), _json_value(value).alias("value"))))
    if unique:
        entries = F.filter(entries, lambda e, i: ~F.coalesce(F.get(entries, i + 1)["key"] == e["key"], F.lit(False)))
    members = F.transform(entries, lambda e: F.concat(_json_value(e["key"]), F.lit(":"), e["value"]))
    return F.when(F.count(F.lit(1)) > 0, F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}")))


def rank_of(h: object, x: Column) -> Column:
    """rank(h) WITHIN GROUP (ORDER BY x): where h would stand; nulls come after it."""
    return (F.count_if(x < F.lit(h)) + 1).cast("long")


def dense_rank_of(h: object, x: Column) -> Column:
    return (F.count_distinct(F.when(x < F.lit(h), x)) + 1).cast("long")


def percent_rank_of(h: object, x: Column) -> Column:
    n = F.count(F.lit(1))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.count_if(x < F.lit(h)) / n)


def cume_dist_of(h: object, x: Column) -> Column:
    return (F.count_if(x <= F.lit(h)) + 1) / (F.count(F.lit(1)) + 1)


def mode(x: Column) -> Column:
    """mode() WITHIN GROUP (ORDER BY x): the smallest of the most frequent values."""
    return F.mode(x, True)


def grouping_sets(df: DataFrame, sets: list[list[str]], *aggs: Column) -> DataFrame:
    """GROUP BY GROUPING SETS in one pass over the data."""
    keys = list(dict.fromkeys(c for s in sets for c in s))
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in keys]).agg(*aggs)


def range_agg(df: DataFrame, keys: list[str], low: str, high: str) -> DataFrame:
    """range_agg by key: maximal disjoint [low, high) ranges (touching ones join), by gaps and islands."""
    w = Window.partitionBy(*keys).orderBy(low, high)
    before = F.max(high).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = df.where(F.col(low) < F.col(high)).withColumn("__new__", F.coalesce((F.col(low) > before).cast("int"), F.lit(1)))
    rows = rows.withColumn("__island__", F.sum("__new__").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "__island__").agg(F.min(low).alias(low), F.max(high).alias(high)).drop("__island__")


def range_intersect_agg(low: Column, high: Column) -> Column:
    """The part that all [low, high) share, null if none."""
    a, b = F.max(low), F.min(high)
    return F.when(a < b, F.struct(a.alias("lower"), b.alias("upper")))


def user_aggregate(initial: object, step: Callable[[Column, Column], Column], final: Callable[[Column], Column] | None = None) -> Callable[..., Column]:
    """CREATE AGGREGATE (SFUNC, STYPE, FINALFUNC, INITCOND) whose result depends on the order: a fold over the group's values, which meet in one row."""

    def aggregate(x: Column, *order: Column) -> Column:
        values = F.coalesce(array_agg(x, *order), F.array().cast("array<double>"))
        state = F.aggregate(values, F.lit(initial), step)
        return final(state) if final else state

    return aggregate


#: Values that one row gathers of a group at most (about).
CHUNK = 4096


def combining_aggregate(df: DataFrame, keys: list[str], x: Column, name: str, initial: Column, step: Callable[[Column, Column], Column], combine: Callable[[Column, Column], Column], final: Callable[[Column], Column] | None = None) -> DataFrame:
    """CREATE AGGREGATE with a COMBINEFUNC, by key: stretches of about CHUNK values are folded by themselves, and their states combined in rounds.

    Null values are passed to `step` as they are; `initial` has the type of the state.
    """
    rows = df.select(*keys, x.alias("__x__"), F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).alias("__h__"))
    most = rows.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    part = F.pmod(F.col("__h__"), F.lit(-(-most // CHUNK))).alias("__part__")
    states = rows.groupBy(*keys, part).agg(F.collect_list(F.struct("__x__")).alias("__v__"))
    states = states.select(*keys, "__part__", F.aggregate("__v__", initial, lambda s, v: step(s, v["__x__"])).alias("__s__"))
    parts = -(-most // CHUNK)
    while parts > 1:
        parts = -(-parts // CHUNK)
        states = states.groupBy(*keys, F.pmod("__part__", F.lit(parts)).alias("__part__")).agg(F.collect_list(F.struct("__s__")).alias("__v__"))
        states = states.select(*keys, "__part__", F.aggregate("__v__", initial, lambda s, v: combine(s, v["__s__"])).alias("__s__"))
    state = F.col("__s__")
    return states.select(*keys, (final(state) if final else state).alias(name))
