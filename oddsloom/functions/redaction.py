"""Redaction of whole records: fields by their names, at any depth, and secrets inside texts; with the places that changed."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scalars import redact

# a fixed value: names of fields that hold secrets
SENSITIVE_KEY = r"(?i)(^|[_\W])(password|passwd|token|cookie|session|authorization|api_key|api_secret|secret|credentials)([_\W]|$)"
HIDDEN = "[REDACTED]"


def _hidden(value: Column, kind: T.DataType) -> Column:
    """A mark in place of a value, whatever its type; null and empty stay."""
    empty = value.isNull() | (value == "") if isinstance(kind, T.StringType) else value.isNull()
    return F.when(~empty, F.lit(HIDDEN)).otherwise(value if isinstance(kind, T.StringType) else F.lit(None))


def sanitized(value: Column, kind: T.DataType, name: str = "") -> Column:
    """``value`` without secrets: structs, arrays and maps are gone through; a field or key with a sensitive name is hidden as a whole."""
    if re.search(SENSITIVE_KEY, name):
        return _hidden(value, kind)
    if isinstance(kind, T.StringType):
        return redact(value)
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*(sanitized(value[f.name], f.dataType, f.name).alias(f.name) for f in kind)))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: sanitized(x, kind.elementType))
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        if isinstance(kind.valueType, T.StringType):
            return F.transform_values(value, lambda k, v: F.when(k.rlike(SENSITIVE_KEY), _hidden(v, kind.valueType)).otherwise(redact(v)))
        return F.transform_values(F.map_filter(value, lambda k, v: ~k.rlike(SENSITIVE_KEY)), lambda k, v: sanitized(v, kind.valueType))
    return value


def places(value: Column, kind: T.DataType, name: str) -> list[tuple[str, Column, Column]]:
    """(place, before, after) of every field that can change; arrays and maps count as one place."""
    if isinstance(kind, T.StructType) and not re.search(SENSITIVE_KEY, name.rsplit(".", 1)[-1]):
        return [p for f in kind for p in places(value[f.name], f.dataType, f"{name}.{f.name}" if name else f.name)]
    last = name.rsplit(".", 1)[-1]
    return [(name, value, sanitized(value, kind, last))]


def redacted(rows: DataFrame, audit: str = "redactions") -> DataFrame:
    """``rows`` with every column sanitized, and the places that changed in a row as an array of names."""
    found = [p for f in rows.schema for p in places(F.col(f.name), f.dataType, f.name)]
    text = lambda c: F.to_json(F.struct(c.alias("x")))
    changed = F.array_compact(F.array(*(F.when(text(a) != text(b), F.lit(n)) for n, a, b in found)))
    return rows.select(*(sanitized(F.col(f.name), f.dataType, f.name).alias(f.name) for f in rows.schema), changed.alias(audit))
