"""Definitions: enums, domains, generated and identity columns, ALTER TABLE, referential actions, prepared statements, SQL functions.

Tables stay DataFrames: a definition is a function from one table to the next.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Enum:
    """CREATE TYPE name AS ENUM (labels): values are texts that compare by the place of their label."""

    name: str
    labels: tuple[str, ...]

    def cast(self, x: Column) -> Column:
        """The value itself; anything but a label is an error."""
        wrong = F.raise_error(F.concat(F.lit(f"invalid input value for enum {self.name}: "), x)).cast("string")
        return F.when(x.isNull() | x.isin(list(self.labels)), x).otherwise(wrong)

    def place(self, x: Column) -> Column:
        """What ORDER BY and comparisons go by."""
        return F.nullif(F.array_position(F.array(*map(F.lit, self.labels)), x), F.lit(0).cast("long"))

    def compare(self, a: Column, b: Column) -> Column:
        """enum_cmp: -1, 0 or 1."""
        return F.signum((self.place(a) - self.place(b)).cast("double")).cast("int")

    def first(self) -> Column:
        return F.lit(self.labels[0])

    def last(self) -> Column:
        return F.lit(self.labels[-1])

    def range(self, low: str | None = None, high: str | None = None) -> Column:
        a = self.labels.index(low) if low else 0
        b = self.labels.index(high) if high else len(self.labels) - 1
        return F.array(*map(F.lit, self.labels[a : b + 1])) if a <= b else F.array().cast("array<string>")

    def renamed(self, old: str, new: str) -> Enum:
        return Enum(self.name, tuple(new if x == old else x for x in self.labels))

    def added(self, label: str, before: str | None = None, after: str | None = None) -> Enum:
        """ALTER TYPE … ADD VALUE."""
        at = self.labels.index(before) if before else self.labels.index(after) + 1 if after else len(self.labels)
        return Enum(self.name, (*self.labels[:at], label, *self.labels[at:]))


@dataclass(frozen=True)
class Domain:
    """CREATE DOMAIN name AS kind [NOT NULL] CHECK (check(VALUE))."""

    name: str
    kind: str
    check: Callable[[Column], Column] | None = None
    not_null: bool = False

    def cast(self, x: Column) -> Column:
        """The value as the domain's type; a value that fails a constraint is an error (an unknown check passes)."""
        v = x.cast(self.kind)
        bad = F.coalesce(~self.check(v), F.lit(False)) if self.check else F.lit(False)
        bad = bad | v.isNull() if self.not_null else bad
        return F.when(bad, F.raise_error(F.lit(f"value for domain {self.name} violates a constraint")).cast(self.kind)).otherwise(v)


def add_column(df: DataFrame, name: str, kind: str, default: Column | None = None) -> DataFrame:
    """ALTER TABLE ADD COLUMN name kind [DEFAULT default]."""
    return df.withColumn(name, (F.lit(None) if default is None else default).cast(kind))


def alter_type(df: DataFrame, name: str, kind: str, using: Column | None = None) -> DataFrame:
    """ALTER TABLE ALTER COLUMN name TYPE kind [USING using]."""
    return df.withColumn(name, (F.col(name) if using is None else using).cast(kind))


def drop_column(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f'column "{missing[0]}" does not exist')
    return df.drop(*names)


def generated(df: DataFrame, **columns: Column) -> DataFrame:
    """GENERATED ALWAYS AS (expression) columns; none may refer to another, so all are worked out at once."""
    return df.withColumns(columns)


def like(df: DataFrame) -> DataFrame:
    """CREATE TABLE (LIKE table): its columns without rows."""
    return df.limit(0)


def identity(df: DataFrame, name: str, start: int = 1, increment: int = 1) -> DataFrame:
    """GENERATED AS IDENTITY, and nextval of a sequence for each row: distinct, without gaps, in no stated order.

    Rows are numbered in buckets of a hash and buckets by their sizes, so no task numbers the table. Rows that
    agree in all columns may take their numbers either way.
    """
    rows = df.select(F.struct("*").alias("__row__"), F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).alias("__h__"))
    n = rows.count()
    buckets = max(1, int(n**0.5))
    rows = rows.withColumn("__b__", F.pmod("__h__", F.lit(buckets)))
    sizes = rows.groupBy("__b__").agg(F.count("*").alias("__n__"))
    before = F.sum("__n__").over(Window.orderBy("__b__").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(F.col("__b__").alias("__c__"), F.coalesce(before, F.lit(0)).alias("__before__"))
    place = F.col("__before__") + F.row_number().over(Window.partitionBy("__b__").orderBy("__h__")) - 1
    numbered = rows.join(sizes, F.col("__b__") == F.col("__c__")).withColumn("__i__", place)
    return numbered.select("__row__.*", (F.lit(start) + F.col("__i__") * increment).cast("long").alias(name))


def delete_cascading(parent: DataFrame, child: DataFrame, keys: list[tuple[str, str]], condition: Column, action: str = "cascade", default: object = None) -> tuple[DataFrame, DataFrame]:
    """DELETE FROM parent WHERE condition, with what the child's foreign key does: cascade, set null, set default or restrict.

    keys: (parent column, child column). Children with a null in their key refer to no row.
    """
    gone = parent.where(F.coalesce(condition, F.lit(False))).select(*[F.col(p).alias(f"__p{i}__") for i, (p, _) in enumerate(keys)]).distinct()
    kept = parent.where(~F.coalesce(condition, F.lit(False)))
    same = [F.col(c) == F.col(f"__p{i}__") for i, (_, c) in enumerate(keys)]
    if action == "cascade":
        return kept, child.join(gone, same, "left_anti")
    hit = child.join(gone.withColumn("__hit__", F.lit(True)), same, "left")
    if action == "restrict":
        guard = F.raise_error(F.lit("update or delete violates a foreign key constraint"))
        first = keys[0][1]
        made = {first: F.when(F.col("__hit__"), guard.cast(child.schema[first].dataType)).otherwise(F.col(first))}
    else:
        value = F.lit(None if action == "set null" else default)
        made = {c: F.when(F.col("__hit__"), value.cast(child.schema[c].dataType)).otherwise(F.col(c)) for _, c in keys}
    return kept, hit.select(*[made.get(c, F.col(f"`{c}`")).alias(c) for c in child.columns])


def truncate(df: DataFrame) -> DataFrame:
    """TRUNCATE: the table without rows."""
    return df.limit(0)


class Prepared:
    """PREPARE: a statement over named tables with $1, $2, …; execute gives the result for values."""

    def __init__(self, spark: SparkSession, text: str, **tables: DataFrame) -> None:
        self.spark, self.tables = spark, tables
        self.text = re.sub(r"\$(\d+)", r":p\1", text)

    def execute(self, *values: object) -> DataFrame:
        return self.spark.sql(self.text, args={f"p{i}": v for i, v in enumerate(values, 1)}, **self.tables)


def sql_function(spark: SparkSession, name: str, arguments: str, returns: str, body: str) -> None:
    """CREATE FUNCTION name(arguments) RETURNS returns RETURN body, for the session; RETURNS TABLE (…) makes a table function."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {returns} RETURN {body}")


def fetch(df: DataFrame, order: list[Column], count: int, position: int = 0) -> DataFrame:
    """FETCH count FROM a cursor at `position` of an ordered result."""
    return df.orderBy(*order).offset(position).limit(count)
