"""PostgreSQL's date and time functions; timestamps are without zone, the session's zone is UTC."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


FIELDS = {
    "year": F.year, "quarter": F.quarter, "month": F.month, "day": F.dayofmonth, "doy": F.dayofyear, "hour": F.hour, "minute": F.minute, "week": F.weekofyear,
    "dow": lambda t: F.dayofweek(t) - 1, "isodow": lambda t: F.weekday(t) + 1, "isoyear": lambda t: F.extract(F.lit("YEAROFWEEK"), t),
    "decade": lambda t: F.floor(F.year(t) / 10), "century": lambda t: F.ceil(F.year(t) / 100), "millennium": lambda t: F.ceil(F.year(t) / 1000),
    "second": lambda t: F.pmod(_micros(t), F.lit(60_000_000)) / 1e6, "milliseconds": lambda t: F.pmod(_micros(t), F.lit(60_000_000)) / 1e3,
    "microseconds": lambda t: F.pmod(_micros(t), F.lit(60_000_000)), "epoch": lambda t: _micros(t) / 1e6, "julian": lambda t: F.datediff(t, F.lit("1970-01-01").cast("date")) + 2440588,
}


def extract(field: str, ts: Column) -> Column:
    return FIELDS[field.lower()](ts).cast("double")


def age(a: Column, b: Column) -> Column:
    """age(a, b) as a struct of months, days and micros, all of one sign: field by field, borrowing days from the earlier one's month."""
    hi, lo = F.greatest(a, b), F.least(a, b)
    day = F.lit(86_400_000_000)
    micros = F.pmod(_micros(hi), day) - F.pmod(_micros(lo), day)
    days = F.dayofmonth(hi) - F.dayofmonth(lo) - F.when(micros < 0, 1).otherwise(0)
    months = (F.year(hi) - F.year(lo)) * 12 + F.month(hi) - F.month(lo) - F.when(days < 0, 1).otherwise(0)
    days = F.when(days < 0, days + F.dayofmonth(F.last_day(lo))).otherwise(days)
    s = F.when(a < b, -1).otherwise(1)
    return F.struct((s * months).cast("long").alias("months"), (s * days).cast("long").alias("days"), (s * F.pmod(micros, day)).cast("long").alias("micros"))


def justify_hours(i: Column) -> Column:
    day = F.lit(86_400_000_000)
    more = F.signum(i["micros"].cast("double")) * F.floor(F.abs(i["micros"]) / day)
    return F.struct(i["months"].alias("months"), (i["days"] + more).cast("long").alias("days"), (i["micros"] - more * day).cast("long").alias("micros"))


def justify_days(i: Column) -> Column:
    more = F.signum(i["days"].cast("double")) * F.floor(F.abs(i["days"]) / 30)
    return F.struct((i["months"] + more).cast("long").alias("months"), (i["days"] - more * 30).cast("long").alias("days"), i["micros"].alias("micros"))


def overlaps(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """(a1, a2) OVERLAPS (b1, b2): half-open, ends in any order, a point counts at its place."""
    s1, e1, s2, e2 = F.least(a1, a2), F.greatest(a1, a2), F.least(b1, b2), F.greatest(b1, b2)
    return ((s1 < e2) & (s2 < e1)) | (s1 == s2)


def at_time_zone(ts: Column, zone: str) -> Column:
    """timestamp AT TIME ZONE zone: the instant (as UTC) of that wall clock."""
    return F.to_utc_timestamp(ts, zone)


#: Template patterns of to_char and to_timestamp, and Spark's letters for them (fixed values).
TEMPLATES = {"YYYY": "yyyy", "YY": "yy", "MM": "MM", "Month": "MMMM", "Mon": "MMM", "DDD": "DDD", "DD": "dd", "Day": "EEEE", "Dy": "EEE", "HH24": "HH", "HH12": "hh", "HH": "hh", "MI": "mm", "SS": "ss", "MS": "SSS", "US": "SSSSSS", "AM": "a", "PM": "a", "Q": "q"}


def template(fmt: str) -> str:
    pattern = "|".join(sorted(map(re.escape, TEMPLATES), key=len, reverse=True))
    return re.sub(rf"{pattern}|[A-Za-z]+", lambda m: TEMPLATES.get(m[0]) or f"'{m[0]}'", fmt)


def to_char(ts: Column, fmt: str) -> Column:
    return F.date_format(ts, template(fmt))


def to_timestamp(s: Column, fmt: str) -> Column:
    return F.to_timestamp(s, template(fmt)).cast("timestamp_ntz")


def to_date(s: Column, fmt: str) -> Column:
    return F.to_date(s, template(fmt))
