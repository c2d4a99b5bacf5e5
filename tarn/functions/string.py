"""PostgreSQL's string functions that differ from, or are missing in, Spark's."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def concat(*parts: Column) -> Column:
    """Nulls count as empty."""
    return F.concat_ws("", *[p.cast("string") for p in parts])


def substring(s: Column, start: int, length: int | None = None) -> Column:
    """Positions below 1 count towards the length."""
    if length is None:
        return F.substring(s, max(1, start), 1 << 30)
    if length < 0:
        raise ValueError("negative substring length not allowed")
    end = start + length
    return F.substring(s, max(1, start), max(0, end - max(1, start)))


def left(s: Column, n: int) -> Column:
    return F.substring(s, 1, n) if n >= 0 else F.when(s.isNotNull(), s.substr(F.lit(1), F.greatest(F.lit(0), F.length(s) + F.lit(n))))


def right(s: Column, n: int) -> Column:
    return F.right(s, F.lit(n)) if n >= 0 else F.when(s.isNotNull(), s.substr(F.lit(1 - n), F.length(s)))


def _shifted(pattern: str, by: int) -> str:
    """The pattern with its back references raised by groups that are put in front of it."""
    return re.sub(r"\\(.)", lambda m: f"\\{int(m[1]) + by}" if m[1] in "123456789" else m[0], pattern, flags=re.S)


def _replacement(text: str, whole: int, shift: int) -> str:
    """A replacement for Java: \\1 to \\9 are groups, \\& is the whole match, two backslashes are one; all else is literal."""
    out, i = [], 0
    while i < len(text):
        c = text[i]
        if c == "\\" and i + 1 < len(text):
            i += 1
            c = text[i]
            out.append(f"${whole}" if c == "&" else f"${int(c) + shift}" if c in "123456789" else "\\\\" if c == "\\" else "\\\\" + re.escape(c))
        else:
            out.append("\\" + c if c in "\\$" else c)
        i += 1
    return "".join(out)


def regexp_replace(s: Column, pattern: str, replacement: str, flags: str = "") -> Column:
    """Only the first match, unless the flags have g; i: in any case. \\1 to \\9 and \\& in the replacement stand for groups and the match."""
    options = "(?si)" if "i" in flags else "(?s)"
    if "g" in flags:
        return F.regexp_replace(s, options + pattern, _replacement(replacement, 0, 0))
    return F.regexp_replace(s, f"{options}\\A(.*?)({_shifted(pattern, 2)})", "$1" + _replacement(replacement, 2, 2))


def regexp_match(s: Column, pattern: str, groups: int = 0) -> Column:
    """Groups of the first match (the match itself if there are none), null without a match."""
    found = F.array(*[F.regexp_extract(s, pattern, i) for i in (range(1, groups + 1) if groups else [0])])
    return F.when(F.regexp_like(s, F.lit(pattern)), found)


#: POSIX classes and Java's names for them (fixed values).
POSIX = {"alpha": "\\p{Alpha}", "digit": "0-9", "alnum": "\\p{Alnum}", "upper": "\\p{Upper}", "lower": "\\p{Lower}", "space": "\\s", "punct": "\\p{Punct}", "blank": " \\t", "cntrl": "\\p{Cntrl}", "graph": "\\p{Graph}", "print": "\\p{Print}", "xdigit": "0-9A-Fa-f", "word": "\\w"}


def bracket(pattern: str, i: int) -> tuple[str, int]:
    """The bracket expression that begins at pattern[i] for Java, and the place after it."""
    out, j = "[", i + 1
    if pattern[j : j + 1] == "^":
        out, j = "[^", j + 1
    first = True
    while j < len(pattern) and (first or pattern[j] != "]"):
        named = re.match(r"\[:(\w+):\]", pattern[j:])
        if named and named[1] in POSIX:
            out += POSIX[named[1]]
            j += named.end()
        else:
            out += "\\" + pattern[j] if pattern[j] in "[]\\&^" else pattern[j]
            j += 1
        first = False
    if j >= len(pattern):
        raise ValueError("brackets [] not balanced")
    return out + "]", j + 1


def similar_to_regexp(pattern: str, escape: str = "\\") -> str:
    """A SIMILAR TO pattern as an unanchored regular expression."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == escape and i + 1 < len(pattern):
            out.append(re.escape(pattern[i + 1]))
            i += 2
        elif c == "[":
            part, i = bracket(pattern, i)
            out.append(part)
        else:
            out.append(".*" if c == "%" else "." if c == "_" else "\\" + c if c in ".^$\\" else c)
            i += 1
    return "".join(out)


def similar_to(s: Column, pattern: str, escape: str = "\\") -> Column:
    """SIMILAR TO, as an anchored regular expression."""
    return F.regexp_like(s, F.lit(f"(?s)\\A(?:{similar_to_regexp(pattern, escape)})\\z"))


def substring_similar(s: Column, pattern: str, escape: str = "#") -> Column:
    """SUBSTRING(s SIMILAR pattern ESCAPE escape): the part between escape and double quote marks, null if s isn't similar."""
    parts = pattern.split(f'{escape}"')
    before, middle, after = (similar_to_regexp(p, escape) for p in (parts if len(parts) == 3 else ["", pattern, ""]))
    whole = f"(?s)\\A(?:{before})((?:{middle}))(?:{after})\\z"
    return F.when(F.regexp_like(s, F.lit(whole)), F.regexp_extract(s, whole, 1))


def regexp_substr(s: Column, pattern: str) -> Column:
    """The first match, null without one."""
    return F.regexp_substr(s, F.lit(pattern))


def regexp_instr(s: Column, pattern: str) -> Column:
    """Where the first match begins, 0 without one."""
    found = F.regexp_substr(s, F.lit(pattern))
    return F.when(s.isNotNull(), F.coalesce(F.call_function("locate", found, s), F.lit(0)))


def regexp_split_to_array(s: Column, pattern: str) -> Column:
    return F.split(s, pattern)


def split_part(s: Column, delimiter: str, n: int) -> Column:
    return F.split_part(s, F.lit(delimiter), F.lit(n))


def string_to_array(s: Column, delimiter: str, null_string: str | None = None) -> Column:
    parts = F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, "\\Q" + delimiter + "\\E"))
    return parts if null_string is None else F.transform(parts, lambda x: F.when(x != null_string, x))


def quote_literal(s: Column) -> Column:
    s = s.cast("string")
    body = F.concat(F.lit("'"), F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("''")), F.lit("'"))
    return F.when(F.instr(s, "\\") > 0, F.concat(F.lit(" E"), body)).otherwise(body)


def quote_nullable(s: Column) -> Column:
    return F.coalesce(quote_literal(s), F.lit("NULL"))


#: Key words that can't stand as a name without quotes (fixed values).
RESERVED = (
    "all analyse analyze and any array as asc asymmetric authorization between bigint binary bit boolean both case cast char character check coalesce collate collation column concurrently"
    " constraint create cross current_catalog current_date current_role current_schema current_time current_timestamp current_user dec decimal default deferrable desc distinct do else end except"
    " exists extract false fetch float for foreign freeze from full grant greatest group grouping having ilike in initially inner inout int integer intersect interval into is isnull join lateral"
    " leading least left like limit localtime localtimestamp national natural nchar none normalize not notnull null nullif numeric offset on only or order out outer overlaps overlay placing position"
    " precision primary real references returning right row select session_user setof similar smallint some substring symmetric system_user table tablesample then time timestamp to trailing treat"
    " trim true union unique user using values varchar variadic verbose when where window with xmlattributes xmlconcat xmlelement xmlexists xmlforest xmlnamespaces xmlparse xmlpi xmlroot xmlserialize xmltable"
).split()


def quote_ident(s: Column) -> Column:
    """Quoted unless it is a lower-case name that is no key word."""
    plain = F.regexp_like(s, F.lit("^[a-z_][a-z0-9_$]*$")) & ~s.isin(RESERVED)
    return F.when(plain, s).otherwise(F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"')))


def format_(template: str, *args: Column) -> Column:
    """format(template, …) with %s, %I, %L, %% and %n$s."""
    parts: list[Column] = []
    at = used = 0
    for m in re.finditer(r"%(?:(\d+)\$)?([sIL%])", template):
        parts.append(F.lit(template[at : m.start()]))
        at = m.end()
        if m[2] == "%":
            parts.append(F.lit("%"))
            continue
        k = int(m[1]) - 1 if m[1] else used
        used = k + 1
        a = args[k]
        parts.append({"s": F.coalesce(a.cast("string"), F.lit("")), "I": quote_ident(a.cast("string")), "L": quote_nullable(a)}[m[2]])
    return F.concat(*parts, F.lit(template[at:]))


def initcap(s: Column) -> Column:
    """Each run of letters and digits gets a capital, whatever separates them."""
    pieces = F.split(F.lower(s), r"(?<![\p{L}\p{N}])(?=[\p{L}\p{N}])")
    return F.array_join(F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))), "")


def chr_(n: Column) -> Column:
    """The character with a code point."""
    return F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")


def unistr(s: Column) -> Column:
    """Text with \\XXXX, \\+XXXXXX, \\uXXXX and \\UXXXXXXXX for code points, and two backslashes for one."""
    token = r"\\(?:u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|\+[0-9A-Fa-f]{6}|[0-9A-Fa-f]{4}|\\)|[^\\]+"

    def one(t: Column) -> Column:
        code = F.regexp_extract(t, r"^\\[uU+]?([0-9A-Fa-f]+)$", 1)
        return F.when(t == "\\\\", "\\").when(code != "", F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32")).otherwise(t)

    return F.array_join(F.transform(F.regexp_extract_all(s, F.lit(token), F.lit(0)), one), "")


def to_hex(n: Column) -> Column:
    return F.lower(F.hex(n))


def normalize(s: Column, form: str = "NFC") -> Column:
    @F.pandas_udf(StringType())
    def apply(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else unicodedata.normalize(form, v))

    return apply(s)


def _unaccented() -> tuple[str, str]:
    """Latin letters with marks that decompose to one letter, and those letters."""
    marked = [c for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if unicodedata.normalize("NFD", c)[0].isascii()]
    return "".join(marked), "".join(unicodedata.normalize("NFD", c)[0] for c in marked)


def unaccent(s: Column) -> Column:
    return F.translate(s, *_unaccented())


def trigrams(s: Column) -> Column:
    """show_trgm of a text of letters, digits and separators: three-letter pieces of '  word ' for each word."""
    words = F.filter(F.split(F.lower(s), "[^\\p{L}\\p{N}]+"), lambda w: w != "")
    per = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.concat(F.lit("  "), w, F.lit(" ")).substr(i, F.lit(3))))
    return F.array_sort(F.array_distinct(F.flatten(per)))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams."""
    x, y = trigrams(a), trigrams(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(0.0))
