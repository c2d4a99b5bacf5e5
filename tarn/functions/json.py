"""JSON functions on JSON text."""

from __future__ import annotations

import json as _json
from collections.abc import Callable
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType

from tarn.functions import jsonpath


def get(j: Column, *path: str | int) -> Column:
    """#>> (text at a path): keys and indexes from 0."""
    return F.get_json_object(j, "$" + "".join(f"[{p}]" if isinstance(p, int) else f"['{p}']" for p in path))


def typeof(j: Column) -> Column:
    """jsonb_typeof."""
    first = F.substring(F.ltrim(j), 1, 1)
    return F.when(first == "{", "object").when(first == "[", "array").when(first == '"', "string").when(first.isin("t", "f"), "boolean").when(first == "n", "null").when(j.isNotNull(), "number")


def _refuse(constant: str) -> None:
    raise ValueError(f"{constant} is no JSON")


@F.pandas_udf(BooleanType())
def _is_valid(j: pd.Series) -> pd.Series:
    def one(text):
        try:
            _json.loads(text, parse_constant=_refuse)
        except ValueError:
            return False
        return True

    return j.map(lambda x: None if x is None else one(x))


def is_json(j: Column, kind: str = "value") -> Column:
    """IS JSON [VALUE | OBJECT | ARRAY | SCALAR]."""
    fine = _is_valid(j)
    if kind == "value":
        return fine
    return fine & (~typeof(j).isin("object", "array") if kind == "scalar" else typeof(j) == kind)


def exists(j: Column, key: str) -> Column:
    """j ? key."""
    return F.when(j.isNotNull(), F.coalesce(F.array_contains(F.json_object_keys(j), key), F.lit(False)))


def has_unique_keys(j: Column) -> Column:
    """WITH UNIQUE KEYS: whether no object in the text has a key twice."""

    def pairs(members: list) -> dict:
        if len({k for k, _ in members}) < len(members):
            raise ValueError("a key repeats")
        return dict(members)

    @F.pandas_udf(BooleanType())
    def apply(x: pd.Series) -> pd.Series:
        def one(v):
            try:
                return _json.loads(v, object_pairs_hook=pairs) is not pairs
            except ValueError:
                return False

        return x.map(lambda v: None if v is None else one(v))

    return apply(j)


def to_json(x: Column) -> Column:
    """JSON text of a value, null as null."""
    listed = F.to_json(F.array(x), {"ignoreNullFields": "false"})
    return F.when(x.isNotNull(), F.substring(listed, 2, 1 << 30).substr(F.lit(1), F.length(listed) - 2))


def build_array(*items: Column) -> Column:
    return F.concat(F.lit("["), F.concat_ws(",", *[F.coalesce(to_json(x), F.lit("null")) for x in items]), F.lit("]"))


def array_elements_text(j: Column) -> Column:
    """The elements of a JSON array as texts: strings without quotes, nulls as null."""
    return F.from_json(j, "array<string>")


def to_record(df: DataFrame, j: Column, columns: str) -> DataFrame:
    """json_to_record and json_populate_record: the members named in `columns` (DDL) as columns."""
    return df.select("*", F.from_json(j, columns).alias("__r__")).select(*df.columns, "__r__.*")


def to_recordset(df: DataFrame, j: Column, columns: str) -> DataFrame:
    """json_to_recordset and json_populate_recordset: a row for each object of the array."""
    return df.select("*", F.explode(F.from_json(j, f"array<struct<{columns.replace(' ', ':').replace(',:', ',')}>>")).alias("__r__")).select(*df.columns, "__r__.*")


def _by_path(path: str, kind: object, pick: Callable[[list], object], variables: dict | None = None) -> Callable[[Column], Column]:
    jsonpath.compiled(path)  # a path that can't be read fails here

    @F.pandas_udf(kind)
    def apply(j: pd.Series) -> pd.Series:
        return j.map(lambda x: None if x is None else pick(jsonpath.select(_load(x), path, variables)))

    return apply


def path_query(j: Column, path: str, variables: dict | None = None) -> Column:
    """jsonb_path_query: JSON texts of all items that the path selects, as an array to unnest."""
    return _by_path(path, ArrayType(StringType()), lambda items: [_dump(x) for x in items], variables)(j)


def path_query_array(j: Column, path: str, variables: dict | None = None) -> Column:
    return _by_path(path, StringType(), lambda items: "[" + ",".join(map(_dump, items)) + "]", variables)(j)


def path_query_first(j: Column, path: str, variables: dict | None = None) -> Column:
    return _by_path(path, StringType(), lambda items: _dump(items[0]) if items else None, variables)(j)


def path_exists(j: Column, path: str, variables: dict | None = None) -> Column:
    """j @? path."""
    return _by_path(path, BooleanType(), lambda items: bool(items), variables)(j)


def path_match(j: Column, path: str, variables: dict | None = None) -> Column:
    """j @@ path: the value of a predicate, null if it is unknown."""
    return _by_path(path, BooleanType(), lambda items: items[0] if len(items) == 1 and isinstance(items[0], bool) else None, variables)(j)


def value(j: Column, path: str, kind: str = "string", on_empty: object = None, on_error: object = None) -> Column:
    """JSON_VALUE(j, path RETURNING kind DEFAULT on_empty ON EMPTY DEFAULT on_error ON ERROR): the one scalar that the path selects."""

    def pick(items: list) -> str | None:
        if not items:
            return "empty"
        if len(items) > 1 or isinstance(items[0], (dict, list)):
            return "error"
        return None if items[0] is None else "=" + (items[0] if isinstance(items[0], str) else _dump(items[0]))

    found = _by_path(path, StringType(), pick)(j)
    return F.when(found == "empty", F.lit(on_empty).cast(kind)).when(found == "error", F.lit(on_error).cast(kind)).otherwise(F.substring(found, 2, 1 << 30).cast(kind))


def query(j: Column, path: str, wrapper: bool = False, keep_quotes: bool = True) -> Column:
    """JSON_QUERY(j, path [WITH WRAPPER] [OMIT QUOTES]): JSON text of what the path selects, null unless it is one item or wrapped."""

    def pick(items: list) -> str | None:
        if wrapper:
            return "[" + ", ".join(map(_dump, items)) + "]" if items else None
        if len(items) != 1:
            return None
        return items[0] if isinstance(items[0], str) and not keep_quotes else _dump(items[0])

    return _by_path(path, StringType(), pick)(j)


def build_object(**members: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in members.items()]), {"ignoreNullFields": "false"})


def row_to_json(*columns: str) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def _load(text: str) -> object:
    return _json.loads(text, parse_float=Decimal)


def _dump(doc: object) -> str:
    """JSON text; numbers keep their digits."""
    if isinstance(doc, dict):
        return "{" + ", ".join(f"{_json.dumps(k, ensure_ascii=False)}: {_dump(v)}" for k, v in doc.items()) + "}"
    if isinstance(doc, list):
        return "[" + ", ".join(map(_dump, doc)) + "]"
    return str(doc) if isinstance(doc, Decimal) else _json.dumps(doc, ensure_ascii=False)


def _edit(f: Callable[[object], object]) -> Callable[[Column], Column]:
    @F.pandas_udf(StringType())
    def apply(j: pd.Series) -> pd.Series:
        return j.map(lambda x: None if x is None else _dump(f(_load(x))))

    return apply


def set_(j: Column, path: list[str], value: object, create: bool = True) -> Column:
    """jsonb_set(j, path, value, create_if_missing); the parent must be there."""

    def edit(doc):
        at = doc
        for k in path[:-1]:
            at = _step(at, k)
            if at is None:
                return doc
        k = path[-1]
        if isinstance(at, dict) and (create or k in at):
            at[k] = value
        elif isinstance(at, list):
            i = int(k)
            i = i + len(at) if i < 0 else i
            if 0 <= i < len(at):
                at[i] = value
            elif create:
                at.insert(0 if i < 0 else len(at), value)
        return doc

    return _edit(edit)(j)


def insert(j: Column, path: list[str], value: object, after: bool = False) -> Column:
    """jsonb_insert(j, path, value, insert_after): a new member, or an element before (after) the one at the path."""

    def edit(doc):
        at = doc
        for k in path[:-1]:
            at = _step(at, k)
            if at is None:
                return doc
        k = path[-1]
        if isinstance(at, dict):
            if k in at:
                raise ValueError("cannot replace existing key")
            at[k] = value
        elif isinstance(at, list):
            i = int(k)
            i = i + len(at) if i < 0 else min(i, len(at))
            at.insert(max(0, i + (after and i < len(at))), value)
        return doc

    return _edit(edit)(j)


def set_lax(j: Column, path: list[str], value: object, create: bool = True, on_null: str = "use_json_null") -> Column:
    """jsonb_set_lax: what a null value does is `on_null` (use_json_null, delete_key, return_target, raise_exception)."""
    if value is None:
        if on_null == "raise_exception":
            raise ValueError("JSON value must not be null")
        if on_null != "use_json_null":
            return delete_path(j, path) if on_null == "delete_key" else j
    return set_(j, path, value, create)


def delete_path(j: Column, path: list[str]) -> Column:
    """j #- path."""

    def edit(doc):
        at = doc
        for k in path[:-1]:
            at = _step(at, k)
            if at is None:
                return doc
        if isinstance(at, dict):
            at.pop(path[-1], None)
        elif isinstance(at, list) and -len(at) <= int(path[-1]) < len(at):
            del at[int(path[-1])]
        return doc

    return _edit(edit)(j)


def strip_nulls(j: Column) -> Column:
    def edit(doc):
        if isinstance(doc, dict):
            return {k: edit(v) for k, v in doc.items() if v is not None}
        return [edit(v) for v in doc] if isinstance(doc, list) else doc

    return _edit(edit)(j)


def concat(a: Column, b: Column) -> Column:
    """a || b for objects (b's members win) and arrays."""

    @F.pandas_udf(StringType())
    def apply(x: pd.Series, y: pd.Series) -> pd.Series:
        def one(p, q):
            if p is None or q is None:
                return None
            p, q = _load(p), _load(q)
            if isinstance(p, dict) and isinstance(q, dict):
                return _dump(p | q)
            return _dump((p if isinstance(p, list) else [p]) + (q if isinstance(q, list) else [q]))

        return pd.Series([one(p, q) for p, q in zip(x, y)])

    return apply(a, b)


def contains(a: Column, b: Column) -> Column:
    """a @> b."""

    def within(p, q) -> bool:
        if isinstance(q, dict):
            return isinstance(p, dict) and all(k in p and within(p[k], v) for k, v in q.items())
        if isinstance(q, list):
            return isinstance(p, list) and all(any(within(x, v) for x in p) for v in q)
        return p == q and isinstance(p, bool) == isinstance(q, bool)

    @F.pandas_udf(BooleanType())
    def apply(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else within(_load(p), _load(q)) for p, q in zip(x, y)])

    return apply(a, b)


def pretty(j: Column) -> Column:
    @F.pandas_udf(StringType())
    def apply(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else _json.dumps(_json.loads(v), indent=4, ensure_ascii=False))

    return apply(j)


def _step(at, k):
    if isinstance(at, dict):
        return at.get(k)
    if isinstance(at, list) and -len(at) <= int(k) < len(at):
        return at[int(k)]
    return None
