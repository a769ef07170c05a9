"""{{path}} templates: resolved on the driver from a context, or compiled to a column over a row's fields."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.functions.js import text_of

_TEMPLATE = re.compile(r"\{\{([^}]+)\}\}")
MISSING = object()


def resolve_path(context: object, path: str):
    """a.b[0].1 in nested dictionaries and lists; MISSING where there is nothing."""
    value = context
    for part in path.strip().split("."):
        m = re.fullmatch(r"(.+?)\[(\d+)\]", part)
        for key in ([m[1], int(m[2])] if m else [int(part) if part.isdigit() else part]):
            if isinstance(key, int):
                value = value[key] if isinstance(value, list) and key < len(value) else MISSING
            else:
                value = value.get(key, MISSING) if isinstance(value, dict) else MISSING
            if value is MISSING or value is None:
                return MISSING
    return value


def _text(value: object) -> str:
    if value is MISSING or value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float) and value.is_integer():
        return str(int(value))
    return str(value)


def render(value: object, context: dict, keep: set[str] | frozenset[str] = frozenset()):
    """Every string at any depth with its templates resolved; what is missing is empty. Templates that begin with a name
    to keep stay as they are."""
    if isinstance(value, str):
        return _TEMPLATE.sub(lambda m: m[0] if re.split(r"[.\[]", m[1].strip())[0] in keep else _text(resolve_path(context, m[1])), value)
    if isinstance(value, list):
        return [render(v, context, keep) for v in value]
    if isinstance(value, dict):
        return {k: render(v, context, keep) for k, v in value.items()}
    return value


def _column(df: DataFrame, path: str) -> Column | None:
    """The column at a path of a row, by the row's schema; None where the schema has no such path."""
    kind: T.DataType = df.schema
    out: Column | None = None
    for part in path.strip().split("."):
        m = re.fullmatch(r"(.+?)\[(\d+)\]", part)
        for key in ([m[1], int(m[2])] if m else [int(part) if part.isdigit() else part]):
            if isinstance(kind, T.StructType) and isinstance(key, str) and key in kind.names:
                out = F.col(f"`{key}`") if out is None else out[key]
                kind = kind[key].dataType
            elif isinstance(kind, T.MapType) and isinstance(key, str) and out is not None:
                out, kind = F.try_element_at(out, F.lit(key)), kind.valueType
            elif isinstance(kind, T.ArrayType) and isinstance(key, int) and out is not None:
                out, kind = F.try_element_at(out, F.lit(key + 1)), kind.elementType
            else:
                return None
    return F.coalesce(text_of(out, kind.simpleString()), F.lit("")) if out is not None else None


def compile_template(df: DataFrame, template: str, context: dict | None = None) -> Column:
    """A template over each row; paths that the row does not have are looked up in context, once."""
    parts = []
    for i, piece in enumerate(_TEMPLATE.split(template)):
        if i % 2 == 0:
            parts += [F.lit(piece)] if piece else []
        else:
            found = _column(df, piece)
            parts.append(found if found is not None else F.lit(_text(resolve_path(context or {}, piece))))
    return F.concat(*parts) if parts else F.lit("")
