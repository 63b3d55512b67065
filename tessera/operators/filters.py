"""The filter language as conditions over document columns.

A filter is a flat object (all its entries hold) or ``{"and": [...]}`` / ``{"or":
[...]}`` with 1 to 50 children, nested at will.  Conditions have a definite result
for missing fields, so they can be negated and combined.

Fields may lie in structs or in schemaless bodies: from a VARIANT column on (``with_body`` makes
one from JSON text) a path goes through objects whatever they hold, and values are compared by
the kind that each row has.  Paths end at arrays, a JSON null is a value, and a missing field none.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..settings import MAX_CHILDREN


def with_body(df: DataFrame, column: str) -> DataFrame:
    """``df`` with a column of JSON texts as VARIANT; a text that isn't JSON has no fields."""
    return df.withColumn(column, F.try_parse_json(F.col(column)))


def field_of(df: DataFrame, path: str) -> tuple[Column | None, T.DataType | None]:
    """A dotted path through structs and, from a VARIANT on, through its objects; None if there is no such field."""
    kind: T.DataType = df.schema
    parts = path.split(".")
    for i, part in enumerate(parts):
        if isinstance(kind, T.VariantType):
            rest = "".join(f'["{p}"]' if "'" in p else f"['{p}']" for p in parts[i:])
            return F.try_variant_get(F.col(".".join(f"`{p}`" for p in parts[:i])), "$" + rest, "variant"), kind
        if not isinstance(kind, T.StructType) or part not in kind.names:
            return None, None
        kind = kind[part].dataType
    return F.col(".".join(f"`{p}`" for p in parts)), kind


def _literal_kind(value: object) -> type | None:
    return bool if isinstance(value, bool) else float if isinstance(value, (int, float)) else str if isinstance(value, str) else None


def _kind(t: T.DataType) -> type | None:
    return bool if isinstance(t, T.BooleanType) else float if isinstance(t, T.NumericType) else str if isinstance(t, T.StringType) else None


#: Names of a variant's kinds that are numbers.
_NUMERIC = r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)$"


def _number(v: Column) -> Column:
    """The number in a variant, as a double; null for other kinds."""
    return F.when(F.schema_of_variant(v).rlike(_NUMERIC), F.try_variant_get(v, "$", "double"))


def _string(v: Column) -> Column:
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _variant_is(v: Column, value: object) -> Column:
    """Whether a variant is this scalar, of the same kind."""
    kind = _literal_kind(value)
    if value is None:
        test = F.is_variant_null(v)
    elif kind is bool:
        test = F.when(F.schema_of_variant(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean")) == F.lit(value)
    elif kind is float:
        test = _number(v) == F.lit(float(value))
    elif kind is str:
        test = _string(v) == F.lit(value)
    else:
        return F.lit(False)
    return F.coalesce(test, F.lit(False))


def equals(df: DataFrame, path: str, value: object) -> Column:
    """Strict equality without coercion, or containment in an array."""
    col, kind = field_of(df, path)
    if col is None:
        return F.lit(False)
    if isinstance(kind, T.VariantType):
        members = F.when(F.schema_of_variant(col).startswith("ARRAY"), F.try_variant_get(col, "$", "array<variant>"))
        return _variant_is(col, value) | F.coalesce(F.exists(members, lambda m: _variant_is(m, value)), F.lit(False))
    if isinstance(kind, T.ArrayType):
        same = _kind(kind.elementType) == _literal_kind(value)
        return F.coalesce(F.array_contains(col, value), F.lit(False)) if same else F.lit(False)
    if value is None:
        return col.isNull()
    return F.coalesce(col == F.lit(value), F.lit(False)) if _kind(kind) == _literal_kind(value) else F.lit(False)


def _date(col: Column) -> Column:
    return F.try_to_timestamp(col)


def compares(df: DataFrame, path: str, op: str, value: object) -> Column:
    """Number with number, or two strings that are both ISO dates; else false."""
    col, kind = field_of(df, path)
    if col is None or _literal_kind(value) not in (float, str):
        return F.lit(False)
    if isinstance(kind, T.VariantType):
        left, right = (_date(_string(col)), _date(F.lit(value))) if isinstance(value, str) else (_number(col), F.lit(value))
    elif isinstance(kind, T.StringType) and isinstance(value, str):
        left, right = _date(col), _date(F.lit(value))
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) and isinstance(value, str):
        left, right = col, F.lit(value).cast(kind)
    elif isinstance(kind, T.NumericType) and isinstance(value, (int, float)):
        left, right = col, F.lit(value)
    else:
        return F.lit(False)
    test = {"gt": left > right, "gte": left >= right, "lt": left < right, "lte": left <= right}[op]
    return F.coalesce(test, F.lit(False))


def _predicate(df: DataFrame, path: str, spec: object) -> Column:
    if not isinstance(spec, dict):
        return equals(df, path, spec)
    op, value = spec.get("op"), spec.get("value")
    if op == "eq":
        return equals(df, path, value)
    if op == "neq":
        return ~equals(df, path, value)
    if op == "in":
        return reduce(or_, (equals(df, path, v) for v in value), F.lit(False))
    if op in ("gt", "gte", "lt", "lte"):
        return compares(df, path, op, value)
    if op is None and set(spec) <= {"min", "max"} or op == "range":
        bounds = spec if op is None else (value or {})
        tests = [compares(df, path, o, bounds[k]) for k, o in (("min", "gte"), ("max", "lte")) if bounds.get(k) is not None]
        return reduce(and_, tests, F.lit(True))
    return F.lit(False)


def condition(df: DataFrame, spec: dict | None) -> Column:
    """A filter as a column over ``df``."""
    if not spec:
        return F.lit(True)
    for key, combine in (("and", and_), ("or", or_)):
        if set(spec) == {key} and isinstance(spec[key], list):
            if not 1 <= len(spec[key]) <= MAX_CHILDREN:
                raise ValueError(f"1 to {MAX_CHILDREN} conditions")
            return reduce(combine, (condition(df, c) for c in spec[key]))
    return reduce(and_, (_predicate(df, path, s) for path, s in spec.items()))
