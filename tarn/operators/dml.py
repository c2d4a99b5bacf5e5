"""INSERT, UPDATE, DELETE, MERGE and RETURNING as functions from tables to a new table and the rows returned."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Changed:
    """What a statement made: the table after it, and the rows it touched, with action, old and new."""

    table: DataFrame
    returning: DataFrame


@dataclass(frozen=True)
class When:
    """A clause of MERGE. on: 'matched', 'not matched' or 'not matched by source'; do: 'update', 'delete', 'insert' or 'nothing'.

    In `condition` and `values` the target's columns are under t, the source's under s.
    """

    on: str
    do: str
    values: dict[str, Column] | None = None
    condition: Column | None = None


def with_count(source: DataFrame, keys: list[str]) -> DataFrame:
    """source with __n__, how many rows have its key; a key with a null matches none, so it counts once."""
    known = source.na.drop(subset=keys).groupBy(*keys).agg(F.count("*").alias("__n__")).where("__n__ > 1")
    several = known.select(*[F.col(k).alias(f"__m_{k}") for k in keys], "__n__")
    return source.join(several, [F.col(k) == F.col(f"__m_{k}") for k in keys], "left").select(*[F.col(f"`{c}`") for c in source.columns], F.coalesce("__n__", F.lit(1)).alias("__n__"))


def one_of_each(source: DataFrame, keys: list[str]) -> DataFrame:
    """One row of source for each key; rows whose key has a null all stay."""
    some = F.lit(True)
    for k in keys:
        some = some & F.col(k).isNotNull()
    return source.where(some).dropDuplicates(keys).unionByName(source.where(~some))


def merge(target: DataFrame, source: DataFrame, keys: list[str], clauses: list[When], proposed_twice: bool = False) -> Changed:
    """MERGE INTO target USING source ON equal keys: one full outer join; the first clause that fits acts.

    A null key matches nothing. Fails (cardinality violation, 21000) if a target row is to be changed by several source
    rows, with `proposed_twice` also if several source rows have a key that the target lacks.
    """
    t = target.select(F.struct("*").alias("t"), *[F.col(k).alias(f"__t_{k}") for k in keys])
    s = with_count(source, keys).select(F.struct(*[F.col(f"`{c}`") for c in source.columns]).alias("s"), "__n__", *[F.col(k).alias(f"__s_{k}") for k in keys])
    both = t.join(s, [F.col(f"__t_{k}") == F.col(f"__s_{k}") for k in keys], "full").select("t", "s", "__n__")
    kind = F.when(F.col("t").isNotNull() & F.col("s").isNotNull(), "matched").when(F.col("s").isNotNull(), "not matched").otherwise("not matched by source")
    both = both.withColumn("kind", kind)
    row = target.schema
    action, new = F.lit(None).cast("string"), F.when(F.col("t").isNotNull(), F.col("t"))
    for c in reversed(clauses):
        fits = F.col("kind") == c.on
        if c.condition is not None:
            fits = fits & F.coalesce(c.condition, F.lit(False))
        values = c.values or {}
        if c.do == "update":
            made = F.struct(*[values.get(f.name, F.col(f"t.`{f.name}`")).cast(f.dataType).alias(f.name) for f in row])
        elif c.do == "insert":
            made = F.struct(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in row])
        else:
            made = F.lit(None).cast(row) if c.do == "delete" else F.col("t")
        action = F.when(fits, F.lit(None if c.do == "nothing" else c.do.upper()).cast("string")).otherwise(action)
        new = F.when(fits, made).otherwise(new)
    again = (F.col("__n__") > 1) & (F.lit(proposed_twice) | F.col("t").isNotNull()) & action.isin("UPDATE", "DELETE", "INSERT")
    action = F.when(again, F.raise_error(F.lit("command cannot affect row a second time")).cast("string")).otherwise(action)
    done = both.select(action.alias("action"), F.col("t").alias("old"), new.alias("new"), "s")
    table = done.where((F.col("old").isNotNull() & F.col("action").isNull()) | F.col("action").isin("UPDATE", "INSERT"))
    return Changed(table.select("new.*"), done.where("action is not null"))


def insert(target: DataFrame, rows: DataFrame) -> Changed:
    rows = rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in target.schema])
    return Changed(target.unionByName(rows), rows.select(F.lit("INSERT").alias("action"), F.struct("*").alias("new")))


def upsert(target: DataFrame, rows: DataFrame, keys: list[str], update: dict[str, Column] | None = None, where: Column | None = None) -> Changed:
    """INSERT … ON CONFLICT (keys) DO NOTHING, or DO UPDATE SET update [WHERE where]; s is `excluded`, t the stored row."""
    every = {f.name: F.col(f"s.`{f.name}`") for f in target.schema if f.name in rows.columns}
    insert_rest = When("not matched", "insert", every)
    if update:
        return merge(target, rows, keys, [When("matched", "update", update, where), insert_rest], proposed_twice=True)
    return merge(target, one_of_each(rows, keys), keys, [When("matched", "nothing"), insert_rest])


def update_from(target: DataFrame, source: DataFrame, keys: list[str], values: dict[str, Column], where: Column | None = None) -> Changed:
    """UPDATE target SET values FROM source WHERE equal keys [AND where]; of several source rows for a key any one counts.

    With `where`, which may see both sides, several source rows for a target row are an error.
    """
    return merge(target, one_of_each(source, keys) if where is None else source, keys, [When("matched", "update", values, where)])


def delete_using(target: DataFrame, source: DataFrame, keys: list[str], where: Column | None = None) -> Changed:
    """DELETE FROM target USING source WHERE equal keys [AND where]."""
    return merge(target, one_of_each(source, keys) if where is None else source, keys, [When("matched", "delete", None, where)])
