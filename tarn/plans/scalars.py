"""Queries over scalar functions, predicates and small clauses, beside the DuckDB SQL that their results are held against.

`known` holds a function against values that the standard library gives (digests, identifiers, addresses),
listed as VALUES in the SQL.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import unicodedata
import uuid
import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions import arrays, binary, datetime, geometry, json, math, network, ranges, string
from tarn.operators import aggregates, constraints, joins, recursive, series, windows
from tarn.plans.catalog import query, same
from tarn.session import Tables


def literal(v: object) -> str:
    """A value as SQL."""
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    return str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"


def known(name: str, inputs: list[str], results: dict[str, tuple[Callable[[Column], Column], Callable[[str], object]]]) -> None:
    """Registers functions of a text, each with a plain Python function that gives the same."""
    rows = ", ".join("(" + ", ".join(literal(v) for v in (x, *(plain(x) for _, plain in results.values()))) + ")" for x in inputs)

    @query(name, f"SELECT * FROM (VALUES {rows}) AS v(x, {', '.join(results)})")
    def _(t: Tables) -> DataFrame:
        given = t.region.sparkSession.createDataFrame([(x,) for x in inputs], "x string")
        return given.select("x", *[f(F.col("x")).alias(k) for k, (f, _) in results.items()])


# Numbers -------------------------------------------------------------------------------------------

same("fn_math_rounding", """SELECT p_partkey, abs(p_size - 25) AS ab, CAST(ceil(p_retailprice) AS BIGINT) AS ce, CAST(floor(p_retailprice) AS BIGINT) AS fl, round(power(p_size, 3), 2) AS pw, round(sqrt(p_size), 10) AS sq,
round(ln(p_retailprice), 10) AS l, round(exp(p_size / 10.0), 6) AS ex, round(pi(), 10) AS p, round(degrees(p_size), 8) AS dg, round(radians(p_size), 10) AS rd FROM {part}""")
same("fn_math_trigonometry", """SELECT p_partkey, round(sin(p_size), 10) AS si, round(cos(p_size), 10) AS co, round(tan(p_size), 8) AS ta, round(asin(p_size / 100.0), 10) AS asi, round(acos(p_size / 100.0), 10) AS aco, round(atan(p_size), 10) AS at, round(atan2(p_size, 7), 10) AS at2,
round(sinh(p_size / 10.0), 8) AS sh, round(cosh(p_size / 10.0), 8) AS ch, round(tanh(p_size / 10.0), 10) AS th, round(asinh(p_size), 10) AS ash, round(acosh(p_size + 1.0), 10) AS ach, round(atanh(p_size / 100.0), 10) AS ath FROM {part}""")


@query("fn_math_degrees", """SELECT p_partkey, round(cos(radians(p_size)), 10) AS c, round(tan(radians(p_size)), 8) AS t, round(degrees(asin(p_size / 100.0)), 8) AS s, round(degrees(acos(p_size / 100.0)), 8) AS ac, round(degrees(atan(p_size)), 8) AS at FROM {part}""")
def _(t: Tables) -> DataFrame:
    s, x = F.col("p_size"), F.col("p_size") / 100.0
    return t.part.select("p_partkey", F.round(math.cosd(s), 10).alias("c"), F.round(math.tand(s), 8).alias("t"), F.round(math.asind(x), 8).alias("s"), F.round(math.acosd(x), 8).alias("ac"), F.round(math.atand(s), 8).alias("at"))


@query("fn_math_whole", """SELECT p_partkey, (p_partkey + 9007199254740992) // 3 AS dv, CASE WHEN p_size < 5 THEN 0 WHEN p_size >= 45 THEN 9 ELSE (p_size - 5) // 5 + 1 END AS wb, CAST((p_size >= 10) AS BIGINT) + CAST((p_size >= 20) AS BIGINT) AS wo,
CAST(factorial(p_size % 20) AS VARCHAR) AS f, CAST(trunc(p_retailprice * 100) / 100 AS DOUBLE) AS tr FROM {part}""")
def _(t: Tables) -> DataFrame:
    k, s, price = F.col("p_partkey"), F.col("p_size"), F.col("p_retailprice")
    return t.part.select("p_partkey", math.div(k + 9007199254740992, F.lit(3)).alias("dv"), math.width_bucket(s.cast("double"), 5.0, 45.0, 8).alias("wb"), math.width_bucket_of(s, [10, 20]).cast("long").alias("wo"), math.factorial(s % 20).alias("f"), math.trunc(price, 2).cast("double").alias("tr"))


@query("fn_math_bits", "SELECT p_partkey, p_partkey & 12 AS a, p_partkey | 12 AS o, xor(p_partkey, CAST(12 AS BIGINT)) AS x, p_partkey << 3 AS l, p_partkey >> 2 AS r, -p_partkey - 1 AS n, CAST(bit_count(p_partkey) AS INTEGER) AS c FROM {part}")
def _(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    return t.part.select("p_partkey", k.bitwiseAND(12).alias("a"), k.bitwiseOR(12).alias("o"), k.bitwiseXOR(12).alias("x"), F.shiftleft(k, 3).alias("l"), F.shiftright(k, 2).alias("r"), F.bitwise_not(k).alias("n"), F.bit_count(k).alias("c"))


@query("fn_math_scale", r"SELECT p_partkey, CAST(length(split_part(d, '.', 2)) AS INTEGER) AS s, CAST(length(rtrim(split_part(d, '.', 2), '0')) AS INTEGER) AS m, rtrim(rtrim(d, '0'), '.') AS t FROM (SELECT p_partkey, (p_size // 10) || '.' || (p_size % 10) || '00' AS d FROM {part})")
def _(t: Tables) -> DataFrame:
    s = F.col("p_size")
    d = F.concat(math.div(s, F.lit(10)).cast("string"), F.lit("."), (s % 10).cast("string"), F.lit("00"))
    return t.part.select("p_partkey", math.scale(d).alias("s"), math.min_scale(d).alias("m"), math.trim_scale(d).alias("t"))


# Texts ---------------------------------------------------------------------------------------------

same("fn_string_trim", """SELECT p_partkey, lower(p_brand) AS lo, trim('  ' || p_name || ' ') AS tr, ltrim('  ' || p_name) AS lt, rtrim(p_name || '  ') AS rt, rpad(p_brand, 12, '-') AS rp, repeat(p_brand, 2) AS re, ascii(p_name) AS asc, p_brand || '/' || p_type AS cc FROM {part}""")


@query("fn_string_bytes", "SELECT doc_id, CAST(strlen(text) AS INTEGER) AS o, CAST(strlen(text) * 8 AS INTEGER) AS b, unicode(text) AS u, length(text) AS n, substr(text, 3) AS r FROM {documents}")
def _(t: Tables) -> DataFrame:
    x = F.col("text")
    code = F.when(x == "", -1).otherwise(F.conv(F.hex(F.encode(F.substring(x, 1, 1), "UTF-32")), 16, 10).cast("int"))
    return t.documents.select("doc_id", F.octet_length(x).alias("o"), F.bit_length(x).alias("b"), code.alias("u"), F.length(x).cast("long").alias("n"), string.substring(x, 3).alias("r"))


@query("fn_string_pieces", """SELECT p_partkey, substr(p_name, 1, 2) || 'XY' || substr(p_name, 5) AS ov, lower(to_hex(p_partkey)) AS hx, chr(CAST(8000 + p_size AS INTEGER)) AS ch, array_to_string(string_split(p_type, ' '), '|') AS ar, p_name || '' AS co, len(regexp_extract_all(p_name, '[aeiou]')) AS rc,
nullif(regexp_extract(p_name, '[b-d]+'), '') AS rs, array_to_string(regexp_split_to_array(p_name, '[ae]'), '|') AS sp, regexp_extract(p_brand, '([A-Za-z]+)#([0-9])', 1) || regexp_extract(p_brand, '([A-Za-z]+)#([0-9])', 2) AS rm FROM {part}""")
def _(t: Tables) -> DataFrame:
    n, b = F.col("p_name"), F.col("p_brand")
    groups = string.regexp_match(b, "([A-Za-z]+)#([0-9])", 2)
    return t.part.select("p_partkey", F.overlay(n, F.lit("XY"), F.lit(3), F.lit(2)).alias("ov"), string.to_hex(F.col("p_partkey")).alias("hx"), string.chr_(F.lit(8000) + F.col("p_size")).alias("ch"), F.array_join(string.string_to_array(F.col("p_type"), " "), "|").alias("ar"), string.concat(n, F.lit(None).cast("string")).alias("co"), F.regexp_count(n, F.lit("[aeiou]")).cast("long").alias("rc"), string.regexp_substr(n, "[b-d]+").alias("rs"), F.array_join(string.regexp_split_to_array(n, "[ae]"), "|").alias("sp"), F.concat(F.get(groups, 0), F.get(groups, 1)).alias("rm"))


@query("fn_string_quotes", """SELECT p_partkey, '''' || replace(p_name, '''', '''''') || '''' AS ql, 'NULL' AS qn, '"' || replace(p_brand, '"', '""') || '"' AS qi, 'x_' || p_partkey AS plain, '"select"' AS word FROM {part}""")
def _(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", string.quote_literal(F.col("p_name")).alias("ql"), string.quote_nullable(F.lit(None).cast("string")).alias("qn"), string.quote_ident(F.col("p_brand")).alias("qi"), string.quote_ident(F.concat(F.lit("x_"), F.col("p_partkey").cast("string"))).alias("plain"), string.quote_ident(F.lit("select")).alias("word"))


@query("fn_regex_groups", r"SELECT p_partkey, regexp_replace(p_brand, '([a-z]+)#([0-9])', '\2-\1') AS swapped, regexp_replace(p_name, '[aeiou]', '<\0>', 'g') AS marked, instr(p_name, nullif(regexp_extract(p_name, '[m-z]'), '')) AS at FROM {part}")
def _(t: Tables) -> DataFrame:
    n = F.col("p_name")
    at = F.nullif(string.regexp_instr(n, "[m-z]"), F.lit(0)).cast("long")
    return t.part.select("p_partkey", string.regexp_replace(F.col("p_brand"), "([a-z]+)#([0-9])", r"\2-\1").alias("swapped"), string.regexp_replace(n, "[aeiou]", r"<\&>", "g").alias("marked"), at.alias("at"))


@query("fn_similar_classes", "SELECT p_partkey, regexp_full_match(p_brand, '[A-Za-z]+#[0-9]+') AS s, regexp_extract(p_brand, '#([0-9]+)', 1) AS part FROM {part}")
def _(t: Tables) -> DataFrame:
    b = F.col("p_brand")
    return t.part.select("p_partkey", string.similar_to(b, "[[:alpha:]]+#[[:digit:]]+").alias("s"), string.substring_similar(b, '[[:alpha:]]+#!"[0-9]+!"', "!").alias("part"))


same("predicate_patterns", """SELECT count(*) FILTER (WHERE p_name ILIKE '%A%') AS il, count(*) FILTER (WHERE p_name NOT ILIKE '%A%') AS nil, count(*) FILTER (WHERE p_name NOT LIKE '%e%') AS nl FROM {part}""")


same("predicate_escape", "SELECT n_nationkey FROM {nation} WHERE n_name LIKE '%!_1%' ESCAPE '!'")


@query("predicate_regex", "SELECT count(*) FILTER (WHERE regexp_matches(p_name, '^[a-m]')) AS t, count(*) FILTER (WHERE regexp_matches(p_brand, 'bRAND', 'i')) AS ti, count(*) FILTER (WHERE NOT regexp_matches(p_name, '^[a-m]')) AS n, count(*) FILTER (WHERE NOT regexp_matches(p_brand, 'bRAND#1', 'i')) AS ni FROM {part}")
def _(t: Tables) -> DataFrame:
    like = lambda c, p: F.regexp_like(F.col(c), F.lit(p))
    return t.part.agg(F.count_if(like("p_name", "^[a-m]")).alias("t"), F.count_if(like("p_brand", "(?i)bRAND")).alias("ti"), F.count_if(~like("p_name", "^[a-m]")).alias("n"), F.count_if(~like("p_brand", "(?i)bRAND#1")).alias("ni"))


known(
    "fn_unicode",
    ["Hôtel", "état", "ŁÓDŹ", "straße", "hello wORLD-foo", "ﬁne", "x"],
    {
        "nfc": (string.normalize, lambda x: unicodedata.normalize("NFC", x)),
        "nfkd": (lambda c: string.normalize(c, "NFKD"), lambda x: unicodedata.normalize("NFKD", x)),
        "is_nfc": (lambda c: string.normalize(c) == c, lambda x: unicodedata.is_normalized("NFC", x)),
        "bytes": (F.octet_length, lambda x: len(x.encode())),
        "hexed": (lambda c: F.lower(F.hex(F.encode(c, "UTF-8"))), lambda x: x.encode().hex()),
    },
)
known("fn_initcap", ["hello wORLD-foo", "a1b 2c", "", "éa ÉB"], {"i": (string.initcap, lambda x: {"hello wORLD-foo": "Hello World-Foo", "a1b 2c": "A1b 2c", "": "", "éa ÉB": "Éa Éb"}[x])})
known("fn_unaccent", ["Hôtel", "Ça été", "Łódź", "plain"], {"u": (string.unaccent, lambda x: {"Hôtel": "Hotel", "Ça été": "Ca ete", "Łódź": "Łodz", "plain": "plain"}[x])})
known("fn_unistr", [r"d\0061t\+000061", r"ét\\x", "plain"], {"u": (string.unistr, lambda x: {r"d\0061t\+000061": "data", r"ét\\x": "ét\\x", "plain": "plain"}[x])})
known("fn_soundex", ["Robert", "Rupert", "Tymczak", "Pfister", "Honeyman"], {"s": (F.soundex, lambda x: {"Robert": "R163", "Rupert": "R163", "Tymczak": "T522", "Pfister": "P236", "Honeyman": "H555"}[x])})

_WORDS = "list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda w: w <> '')"
_TRIGRAMS = f"list_sort(list_distinct(flatten(list_transform({_WORDS}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))))"


@query("fn_trigrams", f"SELECT p_partkey, array_to_string({_TRIGRAMS.format('p_name')}, '|') AS t, round(len(list_intersect({_TRIGRAMS.format('p_name')}, {_TRIGRAMS.format('p_type')})) / len(list_distinct(list_concat({_TRIGRAMS.format('p_name')}, {_TRIGRAMS.format('p_type')}))), 8) AS s, levenshtein(p_name, p_type) AS d FROM {{part}}")
def _(t: Tables) -> DataFrame:
    n, k = F.col("p_name"), F.col("p_type")
    return t.part.select("p_partkey", F.array_join(string.trigrams(n), "|").alias("t"), F.round(string.similarity(n, k), 8).alias("s"), F.levenshtein(n, k).cast("long").alias("d"))


# Digests, identifiers, byte strings -------------------------------------------------------------------

_TEXTS = ["", "a", "abc", "message digest", "Grüße", "123456789"]


def _crc32c(x: str) -> int:
    c = 0xFFFFFFFF
    for byte in x.encode():
        c ^= byte
        for _ in range(8):
            c = c >> 1 ^ 0x82F63B78 * (c & 1)
    return c ^ 0xFFFFFFFF


known(
    "fn_digest",
    _TEXTS,
    {
        **{k: (lambda c, k=k: binary.encode(binary.digest(c, k), "hex"), lambda x, k=k: hashlib.new(k, x.encode()).hexdigest()) for k in ("md5", "sha1", "sha224", "sha256", "sha384", "sha512")},
        "hmac256": (lambda c: binary.encode(binary.hmac(c, b"key"), "hex"), lambda x: hmac.new(b"key", x.encode(), "sha256").hexdigest()),
        "crc": (lambda c: F.crc32(c.cast("binary")), lambda x: zlib.crc32(x.encode())),
        "crcc": (lambda c: binary.crc32c(c.cast("binary")), _crc32c),
    },
)
_DNS, _URL = str(uuid.NAMESPACE_DNS), str(uuid.NAMESPACE_URL)
known(
    "fn_uuid",
    _TEXTS,
    {
        "v3": (lambda c: binary.uuid_v3(_DNS, c), lambda x: str(uuid.uuid3(uuid.NAMESPACE_DNS, x))),
        "v5": (lambda c: binary.uuid_v5(_URL, c), lambda x: str(uuid.uuid5(uuid.NAMESPACE_URL, x))),
        "nil": (lambda c: binary.uuid_nil(), lambda x: str(uuid.UUID(int=0))),
        "dns": (lambda c: binary.uuid_namespace("dns"), lambda x: _DNS),
        "url": (lambda c: binary.uuid_namespace("url"), lambda x: _URL),
    },
)
known(
    "fn_bytes",
    ["abc", "Grüße", "xyz!"],
    {
        "hexed": (lambda c: binary.encode(c.cast("binary"), "hex"), lambda x: x.encode().hex()),
        "back": (lambda c: binary.decode(binary.encode(c.cast("binary"), "base64"), "base64").cast("string"), lambda x: x),
        "byte": (lambda c: binary.get_byte(c.cast("binary"), 1), lambda x: x.encode()[1]),
        "put": (lambda c: binary.encode(binary.set_byte(c.cast("binary"), 1, 0x5A), "hex"), lambda x: (x.encode()[:1] + b"Z" + x.encode()[2:]).hex()),
        "bit": (lambda c: binary.get_bit(c.cast("binary"), 9), lambda x: x.encode()[1] >> 1 & 1),
        "put_bit": (lambda c: binary.encode(binary.set_bit(c.cast("binary"), 8, 1), "hex"), lambda x: (x.encode()[:1] + bytes([x.encode()[1] | 1]) + x.encode()[2:]).hex()),
        "bits": (lambda c: binary.bit_count(c.cast("binary")), lambda x: sum(b.bit_count() for b in x.encode())),
        "latin": (lambda c: binary.encode(F.encode(c, "ISO-8859-1"), "hex"), lambda x: x.encode("latin-1").hex()),
        "from_latin": (lambda c: F.decode(F.encode(c, "ISO-8859-1"), "ISO-8859-1"), lambda x: x),
    },
)


@query("fn_uuid_random", "SELECT count(DISTINCT n_nationkey) AS n, true AS v4, true AS v7, true AS v1 FROM {nation}")
def _(t: Tables) -> DataFrame:
    shape = lambda c, v: F.bool_and(F.regexp_like(c, F.lit(f"^[0-9a-f]{{8}}-[0-9a-f]{{4}}-{v}[0-9a-f]{{3}}-[89ab][0-9a-f]{{3}}-[0-9a-f]{{12}}$")))
    rows = t.nation.select(F.expr("uuid()").alias("four"), binary.uuid_v7().alias("seven"), binary.uuid_v1().alias("one"))
    return rows.agg(F.count_distinct("four").alias("n"), shape(F.col("four"), 4).alias("v4"), shape(F.col("seven"), 7).alias("v7"), shape(F.col("one"), 1).alias("v1"))


# Dates and times --------------------------------------------------------------------------------------

same("fn_date_make", "SELECT event_id, make_date(year(ts), month(ts), day(ts)) AS d, make_date(2024, 1, CAST(day(ts) AS INTEGER)) AS shifted, year(ts) * 100 + month(ts) AS ym FROM {events}")


@query("fn_date_arithmetic", """SELECT event_id, CAST(CAST(ts AS DATE) + 10 AS DATE) AS plus, CAST(ts AS DATE) - DATE '2024-01-01' AS days, ts + INTERVAL 90 MINUTE AS later, CAST((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) // 1000000 AS BIGINT) AS secs, CAST(last_day(ts) AS DATE) AS month_end, make_timestamp(CAST(year(ts) AS BIGINT), CAST(month(ts) AS BIGINT), CAST(day(ts) AS BIGINT), 5, 30, 15.5) AS mt FROM {events}""")
def _(t: Tables) -> DataFrame:
    ts = F.col("ts")
    secs = math.div(F.unix_micros(ts.cast("timestamp")) - F.lit(1704067200000000), F.lit(1000000))
    return t.events.select("event_id", F.date_add(ts.cast("date"), 10).alias("plus"), F.datediff(ts, F.lit("2024-01-01").cast("date")).cast("long").alias("days"), (ts + F.expr("interval 90 minutes")).alias("later"), secs.alias("secs"), F.last_day(ts).alias("month_end"), F.make_timestamp_ntz(F.year(ts), F.month(ts), F.dayofmonth(ts), F.lit(5), F.lit(30), F.lit(15.5)).alias("mt"))


@query("fn_date_fields", """SELECT event_id, CAST(quarter(ts) AS DOUBLE) AS q, CAST(dayofyear(ts) AS DOUBLE) AS doy, CAST(decade(ts) AS DOUBLE) AS de, CAST(century(ts) AS DOUBLE) AS ce, CAST(millennium(ts) AS DOUBLE) AS mi, CAST(isoyear(ts) AS DOUBLE) AS iy, CAST(microsecond(ts) AS DOUBLE) AS us, CAST(floor(julian(ts)) AS DOUBLE) AS j, date_trunc('month', ts) AS m, date_trunc('week', ts) AS w FROM {events}""")
def _(t: Tables) -> DataFrame:
    ts = F.col("ts")
    part = lambda f: datetime.extract(f, ts)
    cut = lambda f: F.date_trunc(f, ts).cast("timestamp_ntz")
    return t.events.select("event_id", part("quarter").alias("q"), part("doy").alias("doy"), part("decade").alias("de"), part("century").alias("ce"), part("millennium").alias("mi"), part("isoyear").alias("iy"), part("microseconds").alias("us"), part("julian").alias("j"), cut("month").alias("m"), cut("week").alias("w"))


@query("fn_date_age", """SELECT event_id, CAST(datepart('year', age) * 12 + datepart('month', age) AS BIGINT) AS months, CAST(datepart('day', age) AS BIGINT) AS days FROM (SELECT event_id, age(ts, TIMESTAMP '2023-11-15 00:00:00') AS age FROM {events})""")
def _(t: Tables) -> DataFrame:
    a = datetime.age(F.col("ts"), F.lit("2023-11-15").cast("timestamp_ntz"))
    return t.events.select("event_id", a.alias("a")).select("event_id", "a.months", "a.days")


@query("fn_date_parse", "SELECT event_id, strptime(strftime(ts, '%Y/%m/%d %H'), '%Y/%m/%d %H') AS t, CAST(ts AS DATE) AS d, strftime(ts, '%d.%m.%Y') AS c, to_timestamp(1704067200 + event_id) AT TIME ZONE 'UTC' AS e FROM {events}")
def _(t: Tables) -> DataFrame:
    ts = F.col("ts")
    epoch = F.timestamp_seconds(F.lit(1704067200) + F.col("event_id")).cast("timestamp_ntz")
    return t.events.select("event_id", datetime.to_timestamp(datetime.to_char(ts, "YYYY/MM/DD HH24"), "YYYY/MM/DD HH24").alias("t"), datetime.to_date(datetime.to_char(ts, "DD.MM.YYYY"), "DD.MM.YYYY").alias("d"), datetime.to_char(ts, "DD.MM.YYYY").alias("c"), epoch.alias("e"))


@query("fn_interval_justify", "SELECT event_id, CAST(event_id % 100 // 24 AS BIGINT) AS d, CAST((event_id % 100 % 24) * 3600 AS BIGINT) AS s, CAST(event_id % 100 // 30 AS BIGINT) AS m, CAST(event_id % 100 % 30 AS BIGINT) AS r FROM {events}")
def _(t: Tables) -> DataFrame:
    k, zero = (F.col("event_id") % 100).cast("long"), F.lit(0).cast("long")
    h = datetime.justify_hours(F.struct(zero.alias("months"), zero.alias("days"), (k * 3_600_000_000).alias("micros")))
    d = datetime.justify_days(F.struct(zero.alias("months"), k.alias("days"), zero.alias("micros")))
    return t.events.select("event_id", h["days"].alias("d"), math.div(h["micros"], F.lit(1_000_000)).alias("s"), d["months"].alias("m"), d["days"].alias("r"))


@query("fn_time_zone", "SELECT event_id, ts AT TIME ZONE 'Asia/Tokyo' AT TIME ZONE 'UTC' AS utc FROM {events}")
def _(t: Tables) -> DataFrame:
    return t.events.select("event_id", datetime.at_time_zone(F.col("ts"), "Asia/Tokyo").cast("timestamp_ntz").alias("utc"))


@query("srf_series_dates", "SELECT CAST(x AS DATE) AS d FROM generate_series(DATE '2024-01-01', DATE '2024-12-31', INTERVAL 1 MONTH) AS s(x)")
def _(t: Tables) -> DataFrame:
    return series.date_series(t.region.sparkSession, "2024-01-01", "2024-12-31", "1 month", "d", "date")


@query("srf_series_timestamps", "SELECT x AS ts FROM generate_series(TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-02-01 00:00:00', INTERVAL 90 MINUTE) AS s(x)")
def _(t: Tables) -> DataFrame:
    return series.date_series(t.region.sparkSession, "2024-01-01 00:00:00", "2024-02-01 00:00:00", "90 minutes", "ts")


# Arrays ------------------------------------------------------------------------------------------------

@query("fn_array_edit", """WITH a AS (SELECT p_partkey, [p_size, 7, p_size % 5, 7] AS a FROM {part}) SELECT p_partkey, array_to_string(list_append(a, 1), ',') AS ap, array_to_string(list_prepend(1, a), ',') AS pp, array_to_string(list_concat(a, [9]), ',') AS ca, array_to_string(list_filter(a, lambda x: x <> 7), ',') AS rm,
array_to_string(list_transform(a, lambda x: CASE WHEN x = 7 THEN 0 ELSE x END), ',') AS rp, array_to_string(list_sort(a), ',') AS so, array_to_string(list_reverse(a), ',') AS rv, array_to_string(a[1:2], ',') AS tr, array_to_string(list_filter([1, 2, 3, 4], lambda i: a[i] = 7), ',') AS ps, '[1:4]' AS di, CAST(4 AS BIGINT) AS up, CAST(1 AS BIGINT) AS lo, CAST(4 AS BIGINT) AS ca_n, 1 AS nd, list_has_any(a, [7]) AS ov FROM a""")
def _(t: Tables) -> DataFrame:
    a, s, seven = F.col("a"), F.col("p_size"), F.lit(7)
    text = lambda c: F.array_join(c.cast("array<string>"), ",")
    rows = t.part.select("p_partkey", F.array(s, seven, s % 5, seven).alias("a"))
    return rows.select("p_partkey", text(F.array_append(a, 1)).alias("ap"), text(F.array_prepend(a, 1)).alias("pp"), text(arrays.array_cat(a, F.array(F.lit(9)))).alias("ca"), text(F.array_remove(a, 7)).alias("rm"), text(arrays.array_replace(a, seven, F.lit(0))).alias("rp"), text(F.array_sort(a)).alias("so"), text(F.reverse(a)).alias("rv"), text(arrays.trim_array(a, 2)).alias("tr"), text(arrays.array_positions(a, seven)).alias("ps"), arrays.array_dims(a).alias("di"), arrays.array_upper(a).cast("long").alias("up"), arrays.array_lower(a).cast("long").alias("lo"), F.cardinality(a).cast("long").alias("ca_n"), arrays.array_ndims(rows, "a").alias("nd"), arrays.overlap(a, F.array(seven)).alias("ov"))


@query("fn_array_fill", "SELECT n_nationkey, array_to_string(list_transform(range(3), lambda i: n_nationkey), ',') AS f, 2 AS rows_, 3 AS per FROM {nation}")
def _(t: Tables) -> DataFrame:
    k = F.col("n_nationkey")
    return t.nation.select("n_nationkey", F.array_join(arrays.array_fill(k, 3).cast("array<string>"), ",").alias("f"), F.size(arrays.array_fill(k, 2, 3)).alias("rows_"), F.size(F.get(arrays.array_fill(k, 2, 3), 0)).alias("per"))


@query("srf_generate_subscripts", "SELECT p_partkey, CAST(unnest(range(1, len(string_split(p_type, ' ')) + 1)) AS INTEGER) AS i FROM {part}")
def _(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", series.generate_subscripts(F.split("p_type", " ")).alias("i"))


@query("srf_regexp_split", "SELECT p_partkey, unnest(string_split_regex(p_name, '[aeiou]+')) AS w FROM {part}")
def _(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", series.regexp_split_to_table(F.col("p_name"), "[aeiou]+").alias("w"))


@query("srf_regexp_matches", "SELECT p_partkey, unnest(regexp_extract_all(p_name, '[aeiou][a-z]')) AS w FROM {part}")
def _(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.explode(F.regexp_extract_all("p_name", F.lit("([aeiou][a-z])"), F.lit(1))).alias("w"))


@query("fn_array_shuffle", "SELECT count(*) AS n, true AS same_set, true AS sampled FROM {part}")
def _(t: Tables) -> DataFrame:
    a = F.split("p_type", " ")
    rows = t.part.select(a.alias("a"), F.shuffle(a).alias("s"), F.slice(F.shuffle(a), 1, 2).alias("two"))
    return rows.agg(F.count("*").alias("n"), F.bool_and(F.array_sort("a") == F.array_sort("s")).alias("same_set"), F.bool_and((F.size("two") <= 2) & (F.size(F.array_except("two", "a")) == 0)).alias("sampled"))


@query("fn_num_nulls", """SELECT l_orderkey, l_linenumber, CAST(l_linenumber = 1 AS INTEGER) + CAST(l_linenumber = 2 AS INTEGER) AS num, 2 - CAST(l_linenumber = 1 AS INTEGER) - CAST(l_linenumber = 2 AS INTEGER) AS num_non FROM {lineitem}""")
def _(t: Tables) -> DataFrame:
    a, b = F.nullif("l_linenumber", F.lit(1)), F.nullif("l_linenumber", F.lit(2))
    return t.lineitem.select("l_orderkey", "l_linenumber", arrays.num_nulls(a, b).alias("num"), arrays.num_nonnulls(a, b).alias("num_non"))


# JSON ---------------------------------------------------------------------------------------------------

@query("fn_json_build", """SELECT n_nationkey, '{"k":' || n_nationkey || ',"name":"' || n_name || '","none":null}' AS o, '[' || n_nationkey || ',"' || n_name || '",null]' AS a, '"' || n_name || '"' AS s, '{"n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}' AS r, 3 AS len FROM {nation}""")
def _(t: Tables) -> DataFrame:
    k, n, none = F.col("n_nationkey"), F.col("n_name"), F.lit(None).cast("string")
    array = json.build_array(k, n, none)
    return t.nation.select("n_nationkey", json.build_object(k=k, name=n, none=none).alias("o"), array.alias("a"), json.to_json(n).alias("s"), json.row_to_json("n_nationkey", "n_regionkey").alias("r"), F.json_array_length(array).alias("len"))


@query("srf_json_elements", "SELECT n_nationkey, unnest([CAST(n_nationkey AS VARCHAR), n_name]) AS e FROM {nation}")
def _(t: Tables) -> DataFrame:
    doc = json.build_array(F.col("n_nationkey"), F.col("n_name"))
    return t.nation.select("n_nationkey", F.explode(json.array_elements_text(doc)).alias("e"))


@query("srf_json_keys", "SELECT event_id, unnest(json_keys(props)) AS k FROM {events}")
def _(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.explode(F.json_object_keys("props")).alias("k"))


@query("srf_json_record", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS z FROM {events}")
def _(t: Tables) -> DataFrame:
    return json.to_record(t.events.select("event_id", "props"), F.col("props"), "k long, z string").select("event_id", "k", "z")


@query("srf_json_recordset", "SELECT n_nationkey, a, b FROM (SELECT n_nationkey, unnest([n_nationkey, n_regionkey]) AS a, unnest(['x', 'y']) AS b FROM {nation})")
def _(t: Tables) -> DataFrame:
    one = lambda c, v: json.build_object(a=F.col(c), b=F.lit(v))
    doc = F.concat(F.lit("["), one("n_nationkey", "x"), F.lit(","), one("n_regionkey", "y"), F.lit("]"))
    return json.to_recordset(t.nation.withColumn("doc", doc), F.col("doc"), "a int, b string").select("n_nationkey", "a", "b")


@query("fn_json_path", """SELECT n_nationkey, '[' || n_nationkey || ',' || n_regionkey || ',5]' AS every, CAST(n_nationkey AS VARCHAR) AS first, n_nationkey > 3 OR n_regionkey > 3 OR true AS ex, n_nationkey = n_regionkey AS m, 3 AS size FROM {nation}""")
def _(t: Tables) -> DataFrame:
    k, r = F.col("n_nationkey"), F.col("n_regionkey")
    doc = F.concat(F.lit('{"v":['), k.cast("string"), F.lit(","), r.cast("string"), F.lit(',5],"k":'), k.cast("string"), F.lit(',"r":'), r.cast("string"), F.lit("}"))
    return t.nation.select("n_nationkey", json.path_query_array(doc, "$.v[*]").alias("every"), json.path_query_first(doc, "$.v[0]").alias("first"), json.path_exists(doc, "$.v[*] ? (@ > 3)").alias("ex"), json.path_match(doc, "$.k == $.r").alias("m"), json.path_query_first(doc, "$.v.size()").cast("int").alias("size"))


@query("srf_json_path_query", "SELECT n_nationkey, CAST(unnest(list_filter([n_nationkey, n_regionkey, 5], lambda x: x > 3)) AS VARCHAR) AS x FROM {nation}")
def _(t: Tables) -> DataFrame:
    doc = F.concat(F.lit("["), F.col("n_nationkey").cast("string"), F.lit(","), F.col("n_regionkey").cast("string"), F.lit(",5]"))
    return t.nation.select("n_nationkey", F.explode(json.path_query(doc, "$[*] ? (@ > 3)")).alias("x"))


@query("fn_json_sql", """SELECT event_id, json_extract_string(props, '$.k') AS v, 'none' AS d, '[' || json_extract_string(props, '$.k') || ']' AS w, true AS e, false AS z FROM {events}""")
def _(t: Tables) -> DataFrame:
    p = F.col("props")
    return t.events.select("event_id", json.value(p, "$.k").alias("v"), json.value(p, "$.z", on_empty="none").alias("d"), json.query(p, "$.k", wrapper=True).alias("w"), json.path_exists(p, "$.k").alias("e"), json.path_exists(p, "$.z").alias("z"))


@query("fn_json_insert", """SELECT event_id, '{"k": ' || json_extract_string(props, '$.k') || ', "n": {"a": 1}}' AS i, '{}' AS d, '{"k": ' || json_extract_string(props, '$.k') || '}' AS s FROM {events}""")
def _(t: Tables) -> DataFrame:
    p = F.col("props")
    return t.events.select("event_id", json.insert(p, ["n"], {"a": 1}).alias("i"), json.delete_path(p, ["k"]).alias("d"), json.strip_nulls(json.set_(p, ["x"], None)).alias("s"))


@query("fn_is_json", "SELECT event_id, true AS v, true AS o, false AS a, false AS s, false AS bad, true AS u FROM {events}")
def _(t: Tables) -> DataFrame:
    p = F.col("props")
    return t.events.select("event_id", json.is_json(p).alias("v"), json.is_json(p, "object").alias("o"), json.is_json(p, "array").alias("a"), json.is_json(p, "scalar").alias("s"), json.is_json(F.concat(p, F.lit("}"))).alias("bad"), json.has_unique_keys(p).alias("u"))


# Ranges ---------------------------------------------------------------------------------------------------

@query("fn_range_parts", """SELECT p_partkey, p_size AS lo, p_size + 10 AS up, true AS li, false AS ui, false AS em, true AS inf, false AS fin, '[' || least(p_size, 20) || ',' || greatest(p_size + 10, 30) || ')' AS me, p_size + 10 = 20 OR p_size = 30 AS adj, p_size + 10 <= 20 AS lf, p_size >= 30 AS rt FROM {part}""")
def _(t: Tables) -> DataFrame:
    s, o = F.col("p_size"), ranges.make(F.lit(20), F.lit(30))
    r = ranges.make(s, s + 10)
    open_ = ranges.make(s, F.lit(None).cast("int"))
    return t.part.select("p_partkey", r["lower"].alias("lo"), r["upper"].alias("up"), r["lower_inc"].alias("li"), r["upper_inc"].alias("ui"), r["empty"].alias("em"), ranges.upper_inf(open_).alias("inf"), ranges.lower_inf(open_).alias("fin"), ranges.text(ranges.merge(r, o)).alias("me"), ranges.adjacent(r, o).alias("adj"), ranges.strictly_left(r, o).alias("lf"), ranges.strictly_left(o, r).alias("rt"))


@query("fn_multirange", """SELECT p_partkey, CASE WHEN p_size + 5 < 20 OR p_size > 30 THEN '{' || CASE WHEN p_size < 20 THEN '[' || p_size || ',' || (p_size + 5) || '),[20,30)' ELSE '[20,30),[' || p_size || ',' || (p_size + 5) || ')' END || '}' ELSE '{[' || least(p_size, 20) || ',' || greatest(p_size + 5, 30) || ')}' END AS u,
(p_size <= 25 AND 25 < p_size + 5) OR true AS c, CASE WHEN p_size + 5 < 20 OR p_size > 30 THEN 2 ELSE 1 END AS n FROM {part}""")
def _(t: Tables) -> DataFrame:
    s = F.col("p_size")
    m = ranges.multirange(ranges.make(s, s + 5), ranges.make(F.lit(20), F.lit(30)))
    return t.part.select("p_partkey", ranges.multirange_text(m).alias("u"), ranges.multirange_contains(m, F.lit(25)).alias("c"), F.size(m).alias("n"))


# Geometry and networks --------------------------------------------------------------------------------------

@query("fn_geometry_parts", """SELECT p_partkey, p_size / 2.0 AS cx, CAST(p_size AS DOUBLE) AS w, CAST(4 AS DOUBLE) AS h, round(sqrt(p_size * p_size + 16), 8) AS dg, CAST(2 * p_size AS DOUBLE) AS di, CAST(p_size AS DOUBLE) AS ra, round(4.0 / p_size, 8) AS sl, false AS ho, false AS ve, true AS pa, true AS pe, 4 AS np, round(pi() * p_size * p_size, 6) AS ar FROM {part}""")
def _(t: Tables) -> DataFrame:
    s = F.col("p_size")
    p, o = geometry.point(s, F.lit(4)), geometry.point(F.lit(0), F.lit(0))
    b, c, line = geometry.box(p, o), geometry.circle(o, s.cast("double")), geometry.lseg(o, p)
    across = geometry.lseg(o, geometry.point(F.lit(-4), s))
    return t.part.select("p_partkey", geometry.center(b)["x"].alias("cx"), geometry.width(b).alias("w"), geometry.height(b).alias("h"), F.round(geometry.length(geometry.diagonal(b)), 8).alias("dg"), geometry.diameter(c).alias("di"), geometry.radius(c).alias("ra"), F.round(geometry.slope(o, p), 8).alias("sl"), geometry.is_horizontal(line).alias("ho"), geometry.is_vertical(line).alias("ve"), geometry.is_parallel(line, line).alias("pa"), geometry.is_perpendicular(line, across).alias("pe"), geometry.npoints(geometry.polygon_of(b)).alias("np"), F.round(geometry.circle_area(c), 6).alias("ar"))


_NETS = ["10.1.2.3/12", "192.168.5.77/20", "172.16.0.1", "0.0.0.0/0", "255.255.255.255/32"]
_v4 = ipaddress.IPv4Interface
known(
    "fn_network_parts",
    _NETS,
    {
        "h": (network.host, lambda x: str(_v4(x).ip)),
        "m": (network.masklen, lambda x: _v4(x).network.prefixlen),
        "nm": (network.netmask, lambda x: str(_v4(x).netmask)),
        "hm": (network.hostmask, lambda x: str(_v4(x).hostmask)),
        "net": (network.network, lambda x: str(_v4(x).network)),
        "sm": (lambda c: network.set_masklen(c, 16), lambda x: f"{_v4(x).ip}/16"),
        "fam": (network.family, lambda x: 4),
        "same": (lambda c: network.inet_same_family(c, F.lit("::1")), lambda x: False),
        "ab": (network.abbrev, lambda x: str(_v4(x).ip) if _v4(x).network.prefixlen == 32 else x),
    },
)
known(
    "fn_network_six",
    ["2001:db8::1/64", "::1", "fe80::a:b:c:d/10", "::ffff:1:2/120", "2001:db8:0:0:1:0:0:1"],
    {
        "m": (network.masklen, lambda x: ipaddress.IPv6Interface(x).network.prefixlen),
        "net": (network.network6, lambda x: str(ipaddress.IPv6Interface(x).network)),
        "nm": (network.netmask6, lambda x: str(ipaddress.IPv6Interface(x).netmask)),
        "inside": (lambda c: network.contained6(c, "2001:db8::/32", strict=False), lambda x: ipaddress.IPv6Interface(x).network.subnet_of(ipaddress.IPv6Network("2001:db8::/32"))),
        "fam": (network.family, lambda x: 6),
    },
)


# XML -----------------------------------------------------------------------------------------------------------

@query("fn_xml_parts", """SELECT r_regionkey, '<!--' || r_name || '-->' AS c, '<?x ' || r_name || '?>' AS p, '<a>1</a><b>2</b>' AS cc, 'a &lt; b &amp; c' AS t, true AS w, false AS bad, r_name AS xp, true AS ex, '<?xml version="1.0"?><r>' || r_name || '</r>' AS rt FROM {region}""")
def _(t: Tables) -> DataFrame:
    n = F.col("r_name")
    x = binary.xmlelement("r", binary.xmltext(n))
    return t.region.select("r_regionkey", binary.xmlcomment(n).alias("c"), binary.xmlpi("x", n).alias("p"), binary.xmlconcat(F.lit("<a>1</a>"), F.lit("<b>2</b>")).alias("cc"), binary.xmltext(F.lit("a < b & c")).alias("t"), binary.xml_is_well_formed(x).alias("w"), binary.xml_is_well_formed(F.lit("<a><b></a>")).alias("bad"), F.get(binary.xpath(x, "/r/text()"), 0).alias("xp"), binary.xpath_exists(x, "/r").alias("ex"), binary.xmlroot(x).alias("rt"))


@query("agg_xml", "SELECT n_regionkey, string_agg('<n>' || n_name || '</n>', '' ORDER BY n_name) AS x FROM {nation} GROUP BY n_regionkey")
def _(t: Tables) -> DataFrame:
    return t.nation.groupBy("n_regionkey").agg(binary.xmlagg(binary.xmlelement("n", F.col("n_name")), F.col("n_name")).alias("x"))


@query("srf_xmltable", "SELECT r_regionkey, CAST(i AS BIGINT) AS ord, r_name || i AS name FROM {region}, (SELECT unnest([1, 2, 3]) AS i)")
def _(t: Tables) -> DataFrame:
    rows = [binary.xmlelement("row", F.concat(F.col("r_name"), F.lit(str(i)))) for i in (1, 2, 3)]
    doc = binary.xmlelement("rows", *rows)
    return binary.xmltable(t.region.withColumn("doc", doc), F.col("doc"), "/rows/row", {"name": ("text()", "string")}, ordinality="ord").select("r_regionkey", "ord", "name")


# Predicates, clauses, small aggregates ----------------------------------------------------------------------------

_UNSURE = "(nullif(l_linenumber, 1) > 3)"
same("predicate_truth", f"SELECT count(*) FILTER (WHERE {_UNSURE} IS NOT DISTINCT FROM true) AS t, count(*) FILTER (WHERE {_UNSURE} IS NOT DISTINCT FROM false) AS f, count(*) FILTER (WHERE {_UNSURE} IS NULL) AS u, count(*) FILTER (WHERE {_UNSURE} IS DISTINCT FROM true) AS nt, count(*) FILTER (WHERE {_UNSURE} IS DISTINCT FROM false) AS nf FROM {{lineitem}}")


@query("predicate_is", f"SELECT count(*) FILTER (WHERE {_UNSURE}) AS t, count(*) FILTER (WHERE NOT {_UNSURE}) AS f, count(*) FILTER (WHERE {_UNSURE} IS NULL) AS u FROM {{lineitem}}")
def _(t: Tables) -> DataFrame:
    return t.sql(f"SELECT count(*) FILTER (WHERE {_UNSURE} IS TRUE) AS t, count(*) FILTER (WHERE {_UNSURE} IS FALSE) AS f, count(*) FILTER (WHERE {_UNSURE} IS UNKNOWN) AS u FROM {{lineitem}}")


@query("predicate_symmetric", "SELECT count(*) AS n FROM {part} WHERE p_size BETWEEN least(30, p_partkey % 50) AND greatest(30, p_partkey % 50)")
def _(t: Tables) -> DataFrame:
    return t.part.where(arrays.between_symmetric(F.col("p_size"), F.lit(30), F.col("p_partkey") % 50)).agg(F.count("*").alias("n"))


same("sub_row_in", "SELECT count(*) AS n FROM {customer} WHERE (c_nationkey, c_mktsegment) IN (SELECT s_nationkey, 'BUILDING' FROM {supplier})")
same("sub_any", "SELECT count(*) AS n FROM {part} WHERE p_size < (SELECT max(s_nationkey) FROM {supplier})")


@query("sub_quantified", """SELECT count(*) FILTER (WHERE p_size > ANY (SELECT s_nationkey FROM {supplier})) AS gt_any, count(*) FILTER (WHERE p_size <= ALL (SELECT s_nationkey + 3 FROM {supplier})) AS le_all, count(*) FILTER (WHERE p_size = ANY (SELECT s_nationkey FROM {supplier})) AS eq_any, count(*) FILTER (WHERE p_size <> ALL (SELECT s_nationkey FROM {supplier})) AS ne_all FROM {part}""")
def _(t: Tables) -> DataFrame:
    s = t.supplier.selectExpr("s_nationkey m", "s_nationkey + 3 more")
    rows = t.part.select("p_size")
    for op, how, of, name in ((">", "any", "m", "gt_any"), ("<=", "all", "more", "le_all"), ("=", "any", "m", "eq_any"), ("<>", "all", "m", "ne_all")):
        rows = joins.quantified(rows, "p_size", op, how, s.select(of), of, name)
    return rows.agg(*[F.count_if(c).alias(c) for c in ("gt_any", "le_all", "eq_any", "ne_all")])


same("setop_precedence", "SELECT r_regionkey AS k FROM {region} UNION SELECT n_nationkey FROM {nation} INTERSECT SELECT s_nationkey FROM {supplier}")
same("setop_order_limit", "SELECT k FROM (SELECT n_nationkey AS k FROM {nation} UNION ALL SELECT r_regionkey + 100 FROM {region}) u ORDER BY k DESC LIMIT 7")
same("group_mixed_rollup", "SELECT o_orderstatus, o_orderpriority, year(o_orderdate) AS y, count(*) AS n FROM {orders} GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority, year(o_orderdate)), (o_orderstatus, o_orderpriority), (o_orderstatus))")
same("agg_any_value", "SELECT n_regionkey, any_value(n_regionkey + 1) AS v, count(*) AS n FROM {nation} GROUP BY n_regionkey")
same("values_list", "SELECT k, v FROM (VALUES (1, 'one'), (2, 'two'), (NULL, 'none')) AS t(k, v)")
same("select_without_from", "SELECT 1 + 2 AS three, 'x' || 'y' AS xy")
same("sub_array", "SELECT r_regionkey, (SELECT max(n_name) FROM {nation} WHERE n_regionkey = r_regionkey) AS top FROM {region}")
same("join_comma", "SELECT n_name, count(*) AS n FROM {customer}, {nation} WHERE c_nationkey = n_nationkey AND c_acctbal > 0 GROUP BY n_name")
same("win_in_expression", "SELECT o_orderkey, round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey), 10) AS share FROM {orders}")
same("order_by_window", "SELECT c_custkey, r FROM (SELECT c_custkey, rank() OVER (ORDER BY c_acctbal DESC, c_custkey) AS r FROM {customer}) x ORDER BY r LIMIT 25")
same("cast_types", "SELECT p_partkey, CAST(p_partkey AS STRING) AS s, CAST(CAST(p_size AS STRING) AS INTEGER) AS i, CAST('2024-02-29' AS DATE) AS dt, CAST(p_size AS BOOLEAN) AS b FROM {part}")


@query("agg_range_intersect", "SELECT user_id, CASE WHEN max(value) < min(value + 40) THEN max(value) END AS low FROM {events} GROUP BY user_id")
def _(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(aggregates.range_intersect_agg(F.col("value"), F.col("value") + 40).alias("r")).select("user_id", F.col("r.lower").alias("low"))


@query("frame_exclude_bounded", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW), 6) AS s FROM {events}")
def _(t: Tables) -> DataFrame:
    out = windows.aggregate_excluding(t.events, "s", "value", ["user_id"], ["ts", "event_id"], 3, 2, "current row")
    return out.select("event_id", F.round("s", 6).alias("s"))


@query("frame_exclude_count_ties", "SELECT o_orderkey, count(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE TIES) AS n FROM {orders}")
def _(t: Tables) -> DataFrame:
    return windows.aggregate_excluding(t.orders, "n", "o_totalprice", ["o_custkey"], ["o_orderpriority"], None, None, "ties", "count").select("o_orderkey", "n")


@query("cte_search_breadth_first", "WITH RECURSIVE e AS (SELECT n_nationkey AS child, CASE WHEN n_nationkey = 0 THEN NULL ELSE (n_nationkey - 1) // 2 END AS parent FROM {nation}), r AS (SELECT child AS node, 0 AS depth FROM e WHERE parent IS NULL UNION ALL SELECT child, depth + 1 FROM r JOIN e ON parent = node) SELECT node, depth, row_number() OVER (ORDER BY depth, node) AS seq FROM r")
def _(t: Tables) -> DataFrame:
    e = t.nation.selectExpr("n_nationkey child", "CASE WHEN n_nationkey = 0 THEN NULL ELSE (n_nationkey - 1) DIV 2 END parent")
    out = recursive.walk(e, e.where("parent is null").selectExpr("child node"), "parent", "child")
    return out.select("node", "depth", F.row_number().over(Window.orderBy(recursive.breadth_first(F.col("depth"), F.col("node")))).alias("seq"))


@query("join_using_inner", "SELECT c_custkey AS k, c_name, s_name FROM {customer} JOIN {supplier} ON c_custkey = s_suppkey")
def _(t: Tables) -> DataFrame:
    return joins.using(t.customer.selectExpr("c_custkey k", "c_name"), t.supplier.selectExpr("s_suppkey k", "s_name"), ["k"])


@query("join_natural_left", "SELECT c_custkey AS k, c_name, s_name FROM {customer} LEFT JOIN {supplier} ON c_custkey = s_suppkey")
def _(t: Tables) -> DataFrame:
    return joins.natural(t.customer.selectExpr("c_custkey k", "c_name"), t.supplier.selectExpr("s_suppkey k", "s_name"), "left")


@query("partition_route_list", "SELECT CASE WHEN o_orderstatus IN ('F') THEN 'done' WHEN o_orderstatus IN ('O', 'P') THEN 'open' ELSE 'rest' END AS part, count(*) AS n FROM {orders} GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.orders.groupBy(constraints.route_list(F.col("o_orderstatus"), {"done": ["F"], "open": ["O", "P"]}, "rest").alias("part")).agg(F.count("*").alias("n"))


@query("chk_not_null", "SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE l_linenumber = 2")
def _(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.nullif("l_linenumber", F.lit(2)).alias("v"))
    return constraints.not_null_violations(rows, ["v"]).select("l_orderkey", "l_linenumber")
