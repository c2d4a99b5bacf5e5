"""Constraints as queries for the rows that break them, and partition routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


def unique_violations(df: DataFrame, keys: list[str], nulls_distinct: bool = True) -> DataFrame:
    """Keys (UNIQUE) that several rows have, and how many."""
    rows = df.na.drop(subset=keys) if nulls_distinct else df
    return rows.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def primary_key_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """As unique_violations, and null keys as well."""
    some_null = F.lit(False)
    for k in keys:
        some_null = some_null | F.col(k).isNull()
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where((F.col("n_rows") > 1) | some_null)


def foreign_key_violations(child: DataFrame, columns: list[str], parent: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of child whose key (if it has no null) isn't in parent."""
    return child.na.drop(subset=columns).join(parent.select(*[F.col(k).alias(c) for c, k in zip(columns, keys)]), columns, "left_anti")


def check_violations(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is false (unknown passes)."""
    return df.where(~condition)


def not_null_violations(df: DataFrame, columns: list[str]) -> DataFrame:
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.col(c).isNull()
    return df.where(bad)


def exclusion_violations(df: DataFrame, key: str, low: str, high: str, identity: str) -> DataFrame:
    """Pairs (a, b) of identities with equal key whose [low, high) overlap: EXCLUDE USING gist (key WITH =, range WITH &&).

    Rows meet by cells as wide as the longest range, so two that overlap begin in the same cell or in neighbouring
    ones: a key with many rows is compared cell by cell, not each with all. Bounds are numbers, dates or timestamps.
    """
    number = (lambda c: F.col(c).cast("double")) if isinstance(df.schema[low].dataType, NumericType) else (lambda c: F.unix_micros(F.col(c).cast("timestamp")).cast("double"))
    rows = df.where(F.col(low) < F.col(high)).select(F.col(key).alias("k"), F.col(identity).alias("a"), F.col(low).alias("al"), F.col(high).alias("ah"), number(low).alias("at"), number(high).alias("until"))
    width = rows.agg(F.max(F.col("until") - F.col("at"))).first()[0] or 1.0
    cell = F.floor(F.col("at") / F.lit(float(width)))
    a = rows.select("k", "a", "al", "ah", cell.alias("cell"))
    b = rows.select("k", F.col("a").alias("b"), F.col("al").alias("bl"), F.col("ah").alias("bh"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    return a.join(b, ["k", "cell"]).where((F.col("a") < F.col("b")) & (F.col("al") < F.col("bh")) & (F.col("bl") < F.col("ah"))).select("a", "b")


def route_range(value: Column, bounds: list[tuple[str, object, object]], default: str | None = None) -> Column:
    """Partition name of PARTITION BY RANGE: the first (name, low, high) with low <= value < high."""
    out = F.lit(default)
    for name, low, high in reversed(bounds):
        out = F.when((value >= F.lit(low)) & (value < F.lit(high)), name).otherwise(out)
    return out


def route_list(value: Column, lists: dict[str, list], default: str | None = None) -> Column:
    out = F.lit(default)
    for name, members in reversed(lists.items()):
        out = F.when(value.isin(members), name).otherwise(out)
    return out


def route_hash(value: Column, modulus: int) -> Column:
    """Remainder of a hash partition (Spark's hash, not PostgreSQL's)."""
    return F.pmod(F.xxhash64(value), F.lit(modulus)).cast("int")
