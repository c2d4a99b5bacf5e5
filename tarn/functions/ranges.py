"""Range values as structs lower, upper, lower_inc, upper_inc, empty; a null bound is infinite."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def make(lower: Column, upper: Column, bounds: str = "[)", discrete: bool = False) -> Column:
    """A range; discrete ones (whole numbers, dates) are brought to [lower, upper)."""
    low_inc, high_inc = bounds[0] == "[", bounds[1] == "]"
    if discrete:
        lower = lower if low_inc else lower + 1
        upper = upper + 1 if high_inc else upper
        low_inc, high_inc = True, False
    empty = F.coalesce((lower > upper) | ((lower == upper) & F.lit(not (low_inc and high_inc))), F.lit(False))
    return F.struct(F.when(~empty, lower).alias("lower"), F.when(~empty, upper).alias("upper"), (F.lit(low_inc) & lower.isNotNull() & ~empty).alias("lower_inc"), (F.lit(high_inc) & upper.isNotNull() & ~empty).alias("upper_inc"), empty.alias("empty"))


def contains(r: Column, x: Column) -> Column:
    """r @> element."""
    low = r["lower"].isNull() | (r["lower"] < x) | (r["lower_inc"] & (r["lower"] == x))
    high = r["upper"].isNull() | (x < r["upper"]) | (r["upper_inc"] & (r["upper"] == x))
    return ~r["empty"] & low & high


def _before(a: Column, b: Column) -> Column:
    """a ends before b begins (a << b without the check for empty ranges)."""
    return F.coalesce((a["upper"] < b["lower"]) | ((a["upper"] == b["lower"]) & ~(a["upper_inc"] & b["lower_inc"])), F.lit(False))


def overlaps(a: Column, b: Column) -> Column:
    """a && b."""
    return ~a["empty"] & ~b["empty"] & ~_before(a, b) & ~_before(b, a)


def strictly_left(a: Column, b: Column) -> Column:
    """a << b."""
    return ~a["empty"] & ~b["empty"] & _before(a, b)


def adjacent(a: Column, b: Column) -> Column:
    """a -|- b."""
    def touch(x: Column, y: Column) -> Column:
        return F.coalesce((x["upper"] == y["lower"]) & (x["upper_inc"] != y["lower_inc"]), F.lit(False))

    return ~a["empty"] & ~b["empty"] & (touch(a, b) | touch(b, a))


def intersection(a: Column, b: Column) -> Column:
    """a * b for half-open ranges."""
    low = F.greatest(a["lower"], b["lower"])
    high = F.least(a["upper"], b["upper"])
    out = make(low, high)
    return F.when(overlaps(a, b), out).otherwise(out.withField("empty", F.lit(True)))


def merge(a: Column, b: Column) -> Column:
    """range_merge: the smallest range with both."""
    low = F.when(a["lower"].isNotNull() & b["lower"].isNotNull(), F.least(a["lower"], b["lower"]))
    high = F.when(a["upper"].isNotNull() & b["upper"].isNotNull(), F.greatest(a["upper"], b["upper"]))
    return F.when(a["empty"], b).when(b["empty"], a).otherwise(make(low, high))


def text(r: Column) -> Column:
    """The value as PostgreSQL writes it."""
    return F.when(r["empty"], "empty").otherwise(F.concat(F.when(r["lower_inc"], "[").otherwise("("), F.coalesce(r["lower"].cast("string"), F.lit("")), F.lit(","), F.coalesce(r["upper"].cast("string"), F.lit("")), F.when(r["upper_inc"], "]").otherwise(")")))


def upper_inf(r: Column) -> Column:
    return ~r["empty"] & r["upper"].isNull()


def lower_inf(r: Column) -> Column:
    return ~r["empty"] & r["lower"].isNull()


def difference(a: Column, b: Column) -> Column:
    """a - b for half-open ranges; what is cut in two is an error, as there."""
    left = F.coalesce(a["lower"] < b["lower"], a["lower"].isNull() & b["lower"].isNotNull())
    right = F.coalesce(b["upper"] < a["upper"], a["upper"].isNull() & b["upper"].isNotNull())
    none = make(a["lower"], a["upper"]).withField("empty", F.lit(True))
    cut = F.when(left & right, none.withField("lower", F.raise_error(F.lit("result of range difference would not be contiguous")).cast("int")))
    return F.when(~overlaps(a, b), a).when(left & right, cut).when(left, make(a["lower"], b["lower"])).when(right, make(b["upper"], a["upper"])).otherwise(none)


def multirange(*ranges: Column) -> Column:
    """Half-open ranges as a sorted array of disjoint ones; those that overlap or touch are joined."""
    given = F.filter(F.array(*ranges), lambda r: ~r["empty"])
    # an infinite lower bound is null, which sorts first; an infinite upper bound ends every later range
    ordered = F.array_sort(given)

    def add(done: Column, r: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        meets = (F.size(done) > 0) & (last["upper"].isNull() | r["lower"].isNull() | (r["lower"] <= last["upper"]))
        upper = F.when(last["upper"].isNotNull() & r["upper"].isNotNull(), F.greatest(last["upper"], r["upper"]))
        joined = last.withField("upper", upper).withField("upper_inc", F.lit(False))
        return F.when(meets, F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(done, F.array(r)))

    return F.aggregate(ordered, F.filter(given, lambda r: F.lit(False)), add)


def multirange_contains(m: Column, x: Column) -> Column:
    """m @> element."""
    return F.exists(m, lambda r: contains(r, x))


def multirange_text(m: Column) -> Column:
    return F.concat(F.lit("{"), F.array_join(F.transform(m, text), ","), F.lit("}"))
