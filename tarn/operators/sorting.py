"""Order, limit and distinct with PostgreSQL's placing of nulls (last ascending, first descending)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_HIDDEN = "__rank__"


def pg_order(*keys: str) -> list[Column]:
    """'a', 'a asc' or 'a desc', with an optional 'nulls first' or 'nulls last'."""
    out = []
    for key in keys:
        name, *rest = key.split()
        how = " ".join(rest).lower()
        down = how.startswith("desc")
        first = "nulls first" in how or (down and "nulls last" not in how)
        c = F.col(name)
        out.append((c.desc_nulls_first() if first else c.desc_nulls_last()) if down else (c.asc_nulls_first() if first else c.asc_nulls_last()))
    return out


def order_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.orderBy(*pg_order(*keys))


def limit(df: DataFrame, keys: list[str], count: int | None = None, offset: int = 0) -> DataFrame:
    """ORDER BY keys OFFSET offset LIMIT count; Spark plans it as a top-k."""
    out = order_by(df, *keys)
    out = out.offset(offset) if offset else out
    return out if count is None else out.limit(count)


def with_ties(df: DataFrame, keys: list[str], count: int) -> DataFrame:
    """FETCH FIRST count ROWS WITH TIES: the first rows and all that equal the last of them in the keys.

    The k-th row's keys come from a distributed top-k; the table is then filtered against that one row.
    """
    names = [k.split()[0] for k in keys]
    edge = order_by(df.select(*names), *keys).limit(count)
    last = edge.withColumn(_HIDDEN, F.row_number().over(Window.orderBy(*pg_order(*keys)))).where(F.col(_HIDDEN) == F.lit(count)).first()
    if last is None:
        return df
    before, equal = F.lit(False), F.lit(True)
    for key, name in zip(keys, names):
        how = key.lower()
        down = " desc" in how
        first = "nulls first" in how or (down and "nulls last" not in how)
        c, v = F.col(name), F.lit(last[name])
        if last[name] is None:
            less = F.lit(False) if first else c.isNotNull()
        else:
            less = (c > v) if down else (c < v)
            less = F.coalesce(less, F.lit(first))
        before = before | (equal & less)
        equal = equal & c.eqNullSafe(v)
    return df.where(before | equal)


def distinct_on(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """DISTINCT ON (keys) … ORDER BY keys, order: the first row of each key; Spark prunes each map task to one row a key."""
    w = Window.partitionBy(*keys).orderBy(*pg_order(*order))
    return df.withColumn(_HIDDEN, F.row_number().over(w)).where(F.col(_HIDDEN) == 1).drop(_HIDDEN)


def top_n(df: DataFrame, keys: list[str], order: list[str], n: int, ties: bool = False) -> DataFrame:
    """The first n rows of each key (with ties: all that rank within n)."""
    w = Window.partitionBy(*keys).orderBy(*pg_order(*order))
    rank = (F.rank() if ties else F.row_number()).over(w)
    return df.withColumn(_HIDDEN, rank).where(F.col(_HIDDEN) <= n).drop(_HIDDEN)
