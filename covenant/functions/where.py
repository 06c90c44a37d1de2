"""Metadata filters as nested dicts, compiled to a column that is applied before a search.

{"field": value}, {"field": {"$gt": value}}, {"$and": [...]}, {"$or": [...]}, {"$not": {...}}; several fields
of one dict must all hold. The comparisons are $eq, $ne, $gt, $gte, $lt, $lte, $in, $nin and $contains. A field
is compared as the kind of value it is compared with; a row without the field, or with one of another kind, fits
only $ne and $nin.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A field's column as a kind of value ("string", "double", "boolean").
Field = Callable[[str, str], Column]

_COMPARED: dict[str, Callable[[Column, Column], Column]] = {
    "$eq": lambda x, v: x == v, "$ne": lambda x, v: ~x.eqNullSafe(v), "$gt": lambda x, v: x > v, "$gte": lambda x, v: x >= v,
    "$lt": lambda x, v: x < v, "$lte": lambda x, v: x <= v, "$contains": lambda x, v: x.contains(v),
}


def in_map(metadata: Column) -> Field:
    """Fields of a map of variants (what JSON metadata is parsed to)."""
    return lambda name, kind: F.try_variant_get(F.try_element_at(metadata, F.lit(name)), "$", kind)


def in_columns(**columns: Column) -> Field:
    """Fields that are columns of their own, which a scan can filter by."""

    def field(name: str, kind: str) -> Column:
        if name not in columns:
            raise ValueError(f"no field {name}")
        return columns[name]

    return field


def _kind(value: Any) -> str:
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int | float):
        return "double"
    if isinstance(value, str):
        return "string"
    raise ValueError(f"a filter compares strings, numbers and truth values, not {value!r}")


def _compared(name: str, test: str, value: Any, field: Field) -> Column:
    if test in ("$in", "$nin"):
        if not isinstance(value, list | tuple):
            raise ValueError(f"{test} takes a list")
        any_of = reduce(or_, (field(name, _kind(v)).eqNullSafe(F.lit(v)) for v in value), F.lit(False))
        return any_of if test == "$in" else ~any_of
    if test not in _COMPARED:
        raise ValueError(f"no comparison {test}")
    return _COMPARED[test](field(name, _kind(value)), F.lit(value))


def compiled(where: dict | None, field: Field) -> Column:
    """The filter as a column that is true for rows that fit, false or null for others; none is true for every row."""
    parts = []
    for name, value in (where or {}).items():
        if name in ("$and", "$or"):
            if not isinstance(value, list | tuple) or not value:
                raise ValueError(f"{name} takes a list of filters")
            parts.append(reduce(and_ if name == "$and" else or_, (compiled(v, field) for v in value)))
        elif name == "$not":
            parts.append(~F.coalesce(compiled(value, field), F.lit(False)))
        elif name.startswith("$"):
            raise ValueError(f"no operator {name}")
        elif isinstance(value, dict):
            parts += [_compared(name, test, v, field) for test, v in value.items()]
        else:
            parts.append(_compared(name, "$eq", value, field))
    return reduce(and_, parts, F.lit(True))
