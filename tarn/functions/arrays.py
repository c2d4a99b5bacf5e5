"""PostgreSQL's array functions and operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType


def array_length(a: Column) -> Column:
    """Null for an empty array."""
    return F.when(F.size(a) > 0, F.size(a))


def subscript(a: Column, i: Column | int) -> Column:
    """a[i]: null outside of the bounds."""
    i = F.lit(i) if isinstance(i, int) else i
    return F.when(i >= 1, F.get(a, i - 1))


def slice_(a: Column, low: int, high: int) -> Column:
    low = max(1, low)
    return F.slice(a, low, max(0, high - low + 1))


def contains(a: Column, b: Column) -> Column:
    """a @> b."""
    return F.size(F.array_except(b, a)) == 0


def overlap(a: Column, b: Column) -> Column:
    """a && b."""
    return F.size(F.array_intersect(a, b)) > 0


def array_cat(a: Column, b: Column) -> Column:
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.concat(a, b))


def array_position(a: Column, x: Column) -> Column:
    return F.nullif(F.array_position(a, x), F.lit(0).cast("long"))


def array_positions(a: Column, x: Column) -> Column:
    return F.filter(F.transform(a, lambda v, i: F.when(v.eqNullSafe(x), i + 1)), lambda v: v.isNotNull())


def array_replace(a: Column, old: Column, new: Column) -> Column:
    return F.transform(a, lambda v: F.when(v.eqNullSafe(old), new).otherwise(v))


def trim_array(a: Column, n: int) -> Column:
    return F.slice(a, F.lit(1), F.size(a) - n)


def array_fill(x: Column, *dims: int) -> Column:
    for n in reversed(dims):
        x = F.array_repeat(x, n)
    return x


def array_dims(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.concat(F.lit("[1:"), F.size(a).cast("string"), F.lit("]")))


def any_of(x: Column, op: str, a: Column) -> Column:
    """x op ANY (array), three-valued."""
    return F.exists(a, lambda v: _compare(x, op, v))


def all_of(x: Column, op: str, a: Column) -> Column:
    """x op ALL (array), three-valued."""
    return F.forall(a, lambda v: _compare(x, op, v))


def _compare(x: Column, op: str, v: Column) -> Column:
    return {"=": x == v, "<>": x != v, "<": x < v, "<=": x <= v, ">": x > v, ">=": x >= v}[op]


def array_lower(a: Column) -> Column:
    """1, null for an empty array."""
    return F.when(F.size(a) > 0, 1)


def array_upper(a: Column) -> Column:
    return array_length(a)


def array_ndims(df: DataFrame, name: str) -> Column:
    """Dimensions of an array column, by its type; null for an empty array."""
    kind, n = df.schema[name].dataType, 0
    while isinstance(kind, ArrayType):
        kind, n = kind.elementType, n + 1
    return F.when(F.size(name) > 0, n)


def num_nulls(*values: Column) -> Column:
    return reduce(lambda a, b: a + b, [v.isNull().cast("int") for v in values])


def num_nonnulls(*values: Column) -> Column:
    return reduce(lambda a, b: a + b, [v.isNotNull().cast("int") for v in values])


def between_symmetric(x: Column, a: Column, b: Column) -> Column:
    """x BETWEEN SYMMETRIC a AND b."""
    return ((x >= a) & (x <= b)) | ((x >= b) & (x <= a))
