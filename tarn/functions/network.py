"""inet and cidr values as text: IPv4 by bit arithmetic on whole numbers, IPv6 (network6 and others) in Arrow batches."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

_ALL = (1 << 32) - 1


def host(a: Column) -> Column:
    return F.split_part(a, F.lit("/"), F.lit(1))


def masklen(a: Column) -> Column:
    return F.when(F.contains(a, F.lit("/")), F.split_part(a, F.lit("/"), F.lit(2)).cast("int")).otherwise(F.when(F.contains(a, F.lit(":")), 128).otherwise(32))


def number(a: Column) -> Column:
    return reduce(lambda n, i: n * 256 + F.split_part(host(a), F.lit("."), F.lit(i)).cast("long"), range(2, 5), F.split_part(host(a), F.lit("."), F.lit(1)).cast("long"))


def address(n: Column) -> Column:
    return F.concat_ws(".", *[F.shiftright(n, k).bitwiseAND(F.lit(255)).cast("string") for k in (24, 16, 8, 0)])


def _mask(a: Column) -> Column:
    return F.lit(_ALL + 1) - F.pow(F.lit(2.0), 32 - masklen(a)).cast("long")


def netmask(a: Column) -> Column:
    return address(_mask(a))


def hostmask(a: Column) -> Column:
    return address(F.lit(_ALL) - _mask(a))


def network(a: Column) -> Column:
    return F.concat(address(number(a).bitwiseAND(_mask(a))), F.lit("/"), masklen(a).cast("string"))


def broadcast(a: Column) -> Column:
    return F.concat(address(number(a).bitwiseOR(F.lit(_ALL) - _mask(a))), F.lit("/"), masklen(a).cast("string"))


def set_masklen(a: Column, n: int) -> Column:
    return F.concat(host(a), F.lit(f"/{n}"))


def family(a: Column) -> Column:
    return F.when(F.contains(a, F.lit(":")), 6).otherwise(4)


def inet_same_family(a: Column, b: Column) -> Column:
    return family(a) == family(b)


def contained(a: Column, b: Column, strict: bool = True) -> Column:
    """a << b (strict) or a <<= b."""
    inside = number(a).bitwiseAND(_mask(b)) == number(b).bitwiseAND(_mask(b))
    return inside & ((masklen(a) > masklen(b)) if strict else (masklen(a) >= masklen(b)))


def inet_merge(a: Column, b: Column) -> Column:
    """The smallest network with both."""
    differ = number(a).bitwiseXOR(number(b))
    common = F.when(differ == 0, 32).otherwise(31 - F.floor(F.log2(differ.cast("double"))).cast("int"))
    n = F.least(common, masklen(a), masklen(b))
    return network(F.concat(host(a), F.lit("/"), n.cast("string")))


def abbrev(a: Column) -> Column:
    return F.when(masklen(a) == 32, host(a)).otherwise(a)


def _six(f: Callable[[ipaddress.IPv6Interface], object], kind: object) -> Callable[[Column], Column]:
    @F.pandas_udf(kind)
    def apply(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else f(ipaddress.IPv6Interface(v)))

    return apply


def network6(a: Column) -> Column:
    return _six(lambda x: str(x.network), StringType())(a)


def netmask6(a: Column) -> Column:
    return _six(lambda x: str(x.netmask), StringType())(a)


def broadcast6(a: Column) -> Column:
    return _six(lambda x: f"{x.network.broadcast_address}/{x.network.prefixlen}", StringType())(a)


def contained6(a: Column, within: str, strict: bool = True) -> Column:
    """a << within (strict) or a <<= within."""
    outer = ipaddress.IPv6Network(within)
    return _six(lambda x: x.network.subnet_of(outer) and (not strict or x.network.prefixlen > outer.prefixlen), BooleanType())(a)


def macaddr8(a: Column) -> Column:
    """A MAC address of six or eight bytes as one of eight."""
    digits = F.regexp_replace(F.lower(a), "[^0-9a-f]", "")
    eight = F.when(F.length(digits) == 12, F.concat(F.substring(digits, 1, 6), F.lit("fffe"), F.substring(digits, 7, 6))).otherwise(digits)
    return F.concat_ws(":", *[F.substring(eight, k, 2) for k in range(1, 17, 2)])


def macaddr8_set7bit(a: Column) -> Column:
    """The seventh bit of an address of eight bytes set to one."""
    first = F.conv(F.substring(a, 1, 2), 16, 10).cast("int").bitwiseOR(F.lit(2))
    return F.concat(F.lpad(F.lower(F.hex(first)), 2, "0"), F.substring(a, 3, 1 << 30))
