"""Conditions as columns: typed comparison, LIKE and its fast shapes.

A missing field is null, and null satisfies no condition, not even `ne`.
A literal of another kind than the column matches nothing, decided when the
plan is compiled, so no cast can fail while rows are read.
"""

from __future__ import annotations

import datetime
import decimal
from functools import reduce

from pyspark.sql import Column, functions as F, types as T

from ..plans.plan import PlanError, Where

_KINDS = {"number": (int, float, decimal.Decimal), "string": (str,), "boolean": (bool,), "time": (datetime.date, datetime.datetime)}


def kind_of_type(kind: T.DataType) -> str:
    if isinstance(kind, T.NumericType):
        return "number"
    if isinstance(kind, T.StringType):
        return "string"
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, T.TimestampType | T.TimestampNTZType | T.DateType):
        return "time"
    return "other"


def kind_of_value(value: object) -> str:
    if isinstance(value, bool):
        return "boolean"
    return next((k for k, types in _KINDS.items() if isinstance(value, types)), "other")


def like_prefix(pattern: str) -> str | None:
    """The prefix of a pattern whose only wildcard is one trailing %."""
    body = pattern[:-1]
    return body if pattern.endswith("%") and body and "%" not in body and "_" not in body else None


def like_contains(pattern: str) -> str | None:
    """The text of a pattern %text% without other wildcards."""
    body = pattern[1:-1]
    return body if len(pattern) > 2 and pattern[0] == pattern[-1] == "%" and "%" not in body and "_" not in body else None


def like(column: Column, pattern: str) -> Column:
    """% any run, _ one character, case sensitive, the whole string, no escape character."""
    if (prefix := like_prefix(pattern)) is not None:
        return column.startswith(prefix)
    if (inner := like_contains(pattern)) is not None:
        return column.contains(inner)
    unused = next(chr(c) for c in range(1, 32) if chr(c) not in pattern)
    return F.like(column, F.lit(pattern), F.lit(unused))


def typed_literal(value: object, kind: T.DataType) -> Column:
    """A literal of the column's own type where times are concerned, so that no zone comes in."""
    if isinstance(value, datetime.date) and isinstance(kind, T.TimestampNTZType):
        return F.lit(value.isoformat()[:26].replace("T", " ")).cast("timestamp_ntz")
    return F.lit(value)


def condition(where: Where, schema: T.StructType) -> Column:
    """The condition as a column; an unknown field is missing in every row."""
    names = {f.name: f.dataType for f in schema.fields}
    if where.field not in names:
        return F.lit(where.op == "is_null")
    column, kind = F.col(f"`{where.field}`"), kind_of_type(names[where.field])
    if where.op == "is_null":
        return column.isNull()
    if where.op == "not_null":
        return column.isNotNull()
    if where.op == "like":
        return like(column, where.value) if kind == "string" else F.lit(False)
    values = list(where.value) if where.op in ("in", "between") else [where.value]
    fitting = [v for v in values if kind_of_value(v) == kind]
    if where.op == "in":
        return column.isin(fitting) if fitting else F.lit(False)
    if len(fitting) < len(values):
        return F.lit(False)
    if where.op == "between":
        if len(values) != 2:
            raise PlanError("between takes two values")
        return column.between(*[typed_literal(v, names[where.field]) for v in values])
    if kind == "boolean" and where.op not in ("eq", "ne"):
        return F.lit(False)
    value = typed_literal(where.value, names[where.field])
    return {"eq": column == value, "ne": column != value, "gt": column > value, "gte": column >= value, "lt": column < value, "lte": column <= value}[where.op]


def conjunction(wheres: tuple[Where, ...], schema: T.StructType) -> Column | None:
    return reduce(lambda a, b: a & b, [condition(w, schema) for w in wheres]) if wheres else None


def variant_field(document: str, path: str, kind: str) -> Column:
    """A typed field of a variant document; null where it is missing or of another type. An extension."""
    return F.try_variant_get(F.col(document), f"$.{path}", kind)
