"""Window features that Spark doesn't have: GROUPS frames, EXCLUDE, FILTER, DISTINCT, FROM LAST."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tarn.operators.sorting import pg_order


def groups_frame(df: DataFrame, name: str, agg: Column, by: list[str], order: list[str], before: int | None, after: int | None) -> DataFrame:
    """agg OVER (PARTITION BY by ORDER BY order GROUPS BETWEEN before PRECEDING AND after FOLLOWING); None: unbounded."""
    dense = df.withColumn("__g__", F.dense_rank().over(Window.partitionBy(*by).orderBy(*pg_order(*order))))
    w = Window.partitionBy(*by).orderBy("__g__").rangeBetween(Window.unboundedPreceding if before is None else -before, Window.unboundedFollowing if after is None else after)
    return dense.withColumn(name, agg.over(w)).drop("__g__")


def sum_excluding(x: Column, w: WindowSpec, peers: WindowSpec, what: str) -> Column:
    """sum(x) over w with EXCLUDE CURRENT ROW, GROUP or TIES; `peers` partitions by partition and order keys."""
    whole, own, tied = F.sum(x).over(w), F.coalesce(x, F.lit(0)), F.coalesce(F.sum(x).over(peers), F.lit(0))
    n, mine, alike = F.count(x).over(w), x.isNotNull().cast("long"), F.count(x).over(peers)
    out, left = {"current row": (whole - own, n - mine), "group": (whole - tied, n - alike), "ties": (whole - tied + own, n - alike + mine)}[what.lower()]
    return F.when(left > 0, out)


def filtered(agg, x: Column, condition: Column, w: WindowSpec) -> Column:
    """agg(x) FILTER (WHERE condition) OVER w, for aggregates that leave nulls out."""
    return agg(F.when(condition, x)).over(w)


def count_distinct(x: Column, w: WindowSpec) -> Column:
    """count(DISTINCT x) OVER w."""
    return F.size(F.collect_set(x).over(w)).cast("long")


def nth_from_last(x: Column, n: int, by: list[str], order: list[str], before: int | None = None, after: int | None = None) -> Column:
    """nth_value(x, n) FROM LAST over ROWS BETWEEN before PRECEDING AND after FOLLOWING (None: unbounded), nulls counted: the n-th of the order reversed."""
    down = [k + " desc" if len(k.split()) == 1 else re.sub(r"\b(asc|desc)\b", lambda m: {"asc": "desc", "desc": "asc"}[m[0].lower()], re.sub(r"\b(first|last)\b", lambda m: {"first": "last", "last": "first"}[m[0].lower()], k, flags=re.I), flags=re.I) for k in order]
    w = Window.partitionBy(*by).orderBy(*pg_order(*down))
    return F.nth_value(x, n).over(w.rowsBetween(Window.unboundedPreceding if after is None else -after, Window.unboundedFollowing if before is None else before))


def aggregate_excluding(df: DataFrame, name: str, x: str, by: list[str], order: list[str], before: int | None, after: int | None, what: str, agg: str = "sum") -> DataFrame:
    """df with agg(x) (sum, count, min, max or avg) OVER (PARTITION BY by ORDER BY order ROWS BETWEEN before PRECEDING AND after FOLLOWING EXCLUDE what).

    The frame is cut around the rows excluded: what is before them and what is after them are two plain frames.
    Peers are counted in their place, so bounded frames keep their bounds.
    """
    w = Window.partitionBy(*by).orderBy(*pg_order(*order))
    place, peers = F.row_number().over(w), Window.partitionBy(*by, *[k.split()[0] for k in order])
    rows = df.withColumn("__i__", place)
    rows = rows.withColumn("__a__", F.min("__i__").over(peers)).withColumn("__b__", F.max("__i__").over(peers))
    low = F.lit(1) if before is None else F.greatest(F.lit(1), F.col("__i__") - before)
    high = F.count("*").over(Window.partitionBy(*by)) if after is None else F.least(F.count("*").over(Window.partitionBy(*by)), F.col("__i__") + after)
    rows = rows.withColumn("__low__", low).withColumn("__high__", high)
    gone = {"current row": ("__i__", "__i__"), "group": ("__a__", "__b__"), "ties": ("__a__", "__b__"), "no others": (None, None)}[what.lower()]
    # running sums up to a place: a frame is the difference of two
    if agg not in ("sum", "count", "avg"):
        raise ValueError("min and max can't be taken out of a frame again")
    run = Window.partitionBy(*by).orderBy("__i__").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__s__", F.coalesce(F.sum(x).over(run), F.lit(0))).withColumn("__n__", F.count(x).over(run))
    ends = rows.select(*[F.col(k).alias(f"__k{i}__") for i, k in enumerate(by)], F.col("__i__").alias("__p__"), F.col("__s__").alias("__ps__"), F.col("__n__").alias("__pn__"))

    def upto(df: DataFrame, at: Column, s: str) -> DataFrame:
        """The sums up to a place (0: none) of the same partition."""
        named = ends.withColumnsRenamed({"__p__": f"__p{s}__", "__ps__": f"__s{s}__", "__pn__": f"__n{s}__", **{f"__k{i}__": f"__k{i}{s}__" for i in range(len(by))}})
        same = at == F.col(f"__p{s}__")
        for i, k in enumerate(by):
            same = same & F.col(k).eqNullSafe(F.col(f"__k{i}{s}__"))
        return df.join(named, same, "left")

    def between(s: str) -> Column:
        return F.coalesce(F.col(f"__s{s}__"), F.lit(0))

    def number(s: str) -> Column:
        return F.coalesce(F.col(f"__n{s}__"), F.lit(0))

    rows = upto(upto(rows, F.col("__low__") - 1, "l"), F.col("__high__"), "h")
    total, count = between("h") - between("l"), number("h") - number("l")
    if gone[0]:
        first, last = F.greatest(F.col(gone[0]), F.col("__low__")), F.least(F.col(gone[1]), F.col("__high__"))
        rows = upto(upto(rows, first - 1, "f"), last, "t")
        some = first <= last
        total = total - F.when(some, between("t") - between("f")).otherwise(0)
        count = count - F.when(some, number("t") - number("f")).otherwise(0)
    if what.lower() == "ties":
        inside = F.col("__i__").between(F.col("__low__"), F.col("__high__"))
        total = total + F.when(inside, F.coalesce(F.col(x), F.lit(0))).otherwise(0)
        count = count + F.when(inside, F.col(x).isNotNull().cast("long")).otherwise(0)
    out = {"sum": F.when(count > 0, total), "count": count, "avg": F.when(count > 0, total / count)}[agg]
    return rows.select(*[F.col(f"`{c}`") for c in df.columns], out.alias(name))
