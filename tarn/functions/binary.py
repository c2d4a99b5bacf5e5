"""Byte strings, digests, identifiers and XML text."""

from __future__ import annotations

import hmac as _hmac
import uuid
import xml.etree.ElementTree as ET
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, LongType, StringType


def encode(b: Column, form: str) -> Column:
    return {"hex": lambda: F.lower(F.hex(b)), "base64": lambda: F.base64(b)}[form]()


def decode(s: Column, form: str) -> Column:
    return {"hex": lambda: F.unhex(s), "base64": lambda: F.unbase64(s)}[form]()


def sha(b: Column, bits: int) -> Column:
    return F.unhex(F.sha2(b, bits))


def get_byte(b: Column, i: int) -> Column:
    return F.conv(F.hex(F.substring(b, i + 1, 1)), 16, 10).cast("int")


def set_byte(b: Column, i: int, value: int) -> Column:
    return F.overlay(b, F.lit(bytes([value])), F.lit(i + 1), F.lit(1))


def hmac(b: Column, key: bytes, kind: str = "sha256") -> Column:
    @F.pandas_udf(BinaryType())
    def apply(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else _hmac.new(key, bytes(v), kind).digest())

    return apply(b.cast("binary"))


def digest(b: Column, kind: str) -> Column:
    """md5, sha1, sha224, sha256, sha384 or sha512."""
    b = b.cast("binary")
    if kind == "md5":
        return F.unhex(F.md5(b))
    return F.unhex(F.sha1(b)) if kind == "sha1" else F.unhex(F.sha2(b, int(kind[3:])))


def _dashed(h: Column, version: int) -> Column:
    """A UUID of 32 hex digits with the version and variant set."""
    nibble = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit(f"-{version}"), F.substring(h, 14, 3), F.lit("-"), nibble, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def uuid_v3(namespace: str, name: Column) -> Column:
    """Name-based by MD5."""
    return _dashed(F.md5(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), name.cast("binary"))), 3)


def uuid_v5(namespace: str, name: Column) -> Column:
    """Name-based by SHA-1."""
    return _dashed(F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), name.cast("binary"))), 5)


def uuid_nil() -> Column:
    return F.lit(str(uuid.UUID(int=0)))


def uuid_namespace(name: str) -> Column:
    """uuid_ns_dns, uuid_ns_url, uuid_ns_oid and uuid_ns_x500."""
    return F.lit(str({"dns": uuid.NAMESPACE_DNS, "url": uuid.NAMESPACE_URL, "oid": uuid.NAMESPACE_OID, "x500": uuid.NAMESPACE_X500}[name]))


def uuid_v7() -> Column:
    """A random UUID that begins with the time in milliseconds."""
    random = F.replace(F.expr("uuid()"), F.lit("-"), F.lit(""))
    millis = F.lpad(F.lower(F.hex(F.unix_millis(F.current_timestamp()))), 12, "0")
    return _dashed(F.concat(millis, F.substring(random, 13, 20)), 7)


def uuid_v1() -> Column:
    """A UUID of the time in steps of 100 ns since 1582, and a random node."""
    ticks = F.unix_micros(F.current_timestamp()) * 10 + F.lit(0x01B21DD213814000)
    t = F.lpad(F.lower(F.hex(ticks)), 16, "0")
    random = F.replace(F.expr("uuid()"), F.lit("-"), F.lit(""))
    return _dashed(F.concat(F.substring(t, 9, 8), F.substring(t, 5, 4), F.substring(t, 1, 4), F.substring(random, 17, 16)), 1)


def get_bit(b: Column, n: int) -> Column:
    """Bit n, counted from the lowest of the first byte."""
    return F.shiftright(get_byte(b, n // 8), n % 8).bitwiseAND(F.lit(1))


def set_bit(b: Column, n: int, value: int) -> Column:
    byte, bit = get_byte(b, n // 8), 1 << n % 8
    byte = byte.bitwiseOR(F.lit(bit)) if value else byte.bitwiseAND(F.lit(255 - bit))
    return F.overlay(b, F.unhex(F.lpad(F.hex(byte), 2, "0")), F.lit(n // 8 + 1), F.lit(1))


def bit_count(b: Column) -> Column:
    """Bits set in a byte string."""
    per = F.transform(F.split(F.hex(b), ""), lambda d: F.when(d != "", F.bit_count(F.conv(d, 16, 10).cast("int"))).otherwise(0))
    return F.aggregate(per, F.lit(0), lambda s, x: s + x)


@lru_cache(maxsize=1)
def _crc32c_table() -> list[int]:
    table = []
    for n in range(256):
        for _ in range(8):
            n = (n >> 1) ^ 0x82F63B78 if n & 1 else n >> 1
        table.append(n)
    return table


@F.pandas_udf(LongType())
def crc32c(b: pd.Series) -> pd.Series:
    table = _crc32c_table()

    def one(v):
        c = 0xFFFFFFFF
        for x in bytes(v):
            c = table[(c ^ x) & 255] ^ (c >> 8)
        return c ^ 0xFFFFFFFF

    return b.map(lambda v: None if v is None else one(v)).astype("Int64")


def xmltext(s: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        s = F.replace(s, F.lit(raw), F.lit(safe))
    return s


def xmlelement(name: str, *content: Column, **attributes: Column) -> Column:
    parts = [F.lit(f"<{name}")]
    for k, v in attributes.items():
        parts.append(F.when(v.isNotNull(), F.concat(F.lit(f' {k}="'), F.replace(xmltext(v.cast("string")), F.lit('"'), F.lit("&quot;")), F.lit('"'))).otherwise(""))
    body = F.concat_ws("", *content) if content else F.lit("")
    return F.concat(*parts, F.when(body == "", "/>").otherwise(F.concat(F.lit(">"), body, F.lit(f"</{name}>"))))


def xmlforest(**columns: Column) -> Column:
    return F.concat_ws("", *[F.when(v.isNotNull(), F.concat(F.lit(f"<{k}>"), xmltext(v.cast("string")), F.lit(f"</{k}>"))) for k, v in columns.items()])


def xmlconcat(*parts: Column) -> Column:
    return F.concat_ws("", *parts)


def xmlcomment(s: Column) -> Column:
    return F.concat(F.lit("<!--"), s, F.lit("-->"))


def xmlpi(name: str, content: Column) -> Column:
    return F.concat(F.lit(f"<?{name} "), content, F.lit("?>"))


def xpath(x: Column, path: str) -> Column:
    return F.xpath(x, F.lit(path))


def xpath_exists(x: Column, path: str) -> Column:
    return F.xpath_boolean(x, F.lit(path))


@F.pandas_udf(BooleanType())
def xml_is_well_formed(x: pd.Series) -> pd.Series:
    def one(v):
        try:
            ET.fromstring(v)
        except ET.ParseError:
            return False
        return True

    return x.map(lambda v: None if v is None else one(v))


def xmlroot(x: Column, version: str = "1.0") -> Column:
    return F.concat(F.lit(f'<?xml version="{version}"?>'), x)


def xmlagg(x: Column, *order: Column) -> Column:
    """xmlagg(x ORDER BY order): null over no rows."""
    rows = F.array_sort(F.collect_list(F.struct(*[o.alias(f"k{i}") for i, o in enumerate(order)], x.alias("x"))))
    return F.when(F.count(x) > 0, F.array_join(F.transform(rows, lambda r: r["x"]), ""))


def xmltable(df: DataFrame, x: Column, row: str, columns: dict[str, tuple[str, str]], ordinality: str | None = None) -> DataFrame:
    """XMLTABLE(row PASSING x COLUMNS name kind PATH path, ordinality FOR ORDINALITY): a row for each node that `row` selects."""
    n = F.xpath_int(x, F.lit(f"count({row})"))
    rows = df.select("*", x.alias("__x__"), F.explode(F.when(n > 0, F.sequence(F.lit(1), n))).alias("__i__"))

    def at(path: str, kind: str) -> Column:
        every = F.xpath(F.col("__x__"), F.lit(f"{row}/{path}"))
        return F.get(every, F.col("__i__") - 1).cast(kind)

    made = [at(path, kind).alias(name) for name, (path, kind) in columns.items()]
    number = [F.col("__i__").cast("long").alias(ordinality)] if ordinality else []
    return rows.select(*[F.col(f"`{c}`") for c in df.columns], *number, *made)
