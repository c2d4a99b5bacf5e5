"""PostgreSQL's numeric functions that differ from, or are missing in, Spark's."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType


def log(x: Column, base: Column | None = None) -> Column:
    """log(x) is the logarithm to base 10; log(b, x) that to base b."""
    return F.log10(x) if base is None else F.ln(x) / F.ln(base)


def trunc(x: Column, scale: int | None = None) -> Column:
    """Towards zero: to a whole number as a double, or to `scale` decimal digits as a decimal (numbers are read by their shortest digits)."""
    if scale is None:
        whole = F.when(F.abs(x) < float(1 << 53), F.signum(x) * F.floor(F.abs(x)))
        return F.coalesce(whole, x.cast("double"))  # larger ones have no fraction
    return F.when(x < 0, F.ceil(x, F.lit(scale))).otherwise(F.floor(x, F.lit(scale)))


def div(a: Column, b: Column) -> Column:
    """Integer quotient of whole numbers, towards zero; division by zero is an error."""
    return F.call_function("div", a, b)


def to_int(x: Column) -> Column:
    """Cast of a double to a whole number: halves go to the even one."""
    return F.rint(x).cast("long")


def sign(x: Column) -> Column:
    return F.signum(x).cast("int")


def _degrees(f):
    return lambda x: f(F.radians(x))


sind, cosd, tand = _degrees(F.sin), _degrees(F.cos), _degrees(F.tan)


def asind(x: Column) -> Column:
    return F.degrees(F.asin(x))


def acosd(x: Column) -> Column:
    return F.degrees(F.acos(x))


def atand(x: Column) -> Column:
    return F.degrees(F.atan(x))


def atan2d(y: Column, x: Column) -> Column:
    return F.degrees(F.atan2(y, x))


@F.pandas_udf(LongType())
def gcd(a: pd.Series, b: pd.Series) -> pd.Series:
    known = a.notna() & b.notna()
    out = pd.Series(pd.NA, index=a.index, dtype="Int64")
    out[known] = np.gcd(a[known].astype("int64"), b[known].astype("int64"))
    return out


@F.pandas_udf(LongType())
def lcm(a: pd.Series, b: pd.Series) -> pd.Series:
    known = a.notna() & b.notna()
    out = pd.Series(pd.NA, index=a.index, dtype="Int64")
    out[known] = np.lcm(a[known].astype("int64"), b[known].astype("int64"))
    return out


@F.pandas_udf(StringType())
def factorial(n: pd.Series) -> pd.Series:
    """As digits, since numeric has no bound."""
    return n.map(lambda x: None if pd.isna(x) else str(math.factorial(int(x))))


def width_bucket(x: Column, low: float, high: float, count: int) -> Column:
    return F.width_bucket(x, F.lit(low), F.lit(high), F.lit(count).cast("long"))


def width_bucket_of(x: Column, thresholds: list[float]) -> Column:
    """Number of thresholds at or below x."""
    return F.when(x.isNotNull(), reduce(lambda a, t: a + F.when(x >= t, 1).otherwise(0), thresholds, F.lit(0)))


def scale(digits: Column) -> Column:
    """Digits after the point of a number's text."""
    return F.length(F.split_part(digits, F.lit("."), F.lit(2)))


def min_scale(digits: Column) -> Column:
    return F.length(F.rtrim(F.split_part(digits, F.lit("."), F.lit(2)), F.lit("0")))


def trim_scale(digits: Column) -> Column:
    return F.when(F.instr(digits, ".") > 0, F.rtrim(F.rtrim(digits, F.lit("0")), F.lit("."))).otherwise(digits)
