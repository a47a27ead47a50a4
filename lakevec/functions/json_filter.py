"""The metadata filter language: a JSON object becomes one boolean Column over a JSON text column.

Fields are top-level names; a bare value means equality, which minds types ("1" is not 1; 1 and 1.0 are the same number).
A missing field makes every comparison null, negated ones too, so its row is left out.
"""

from __future__ import annotations

import json
import re
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakevec.errors import Validation

_FIELD = re.compile(r"[A-Za-z_][A-Za-z0-9_-]*")
_RANGES = {"$gt": "__gt__", "$gte": "__ge__", "$lt": "__lt__", "$lte": "__le__"}


def compile_filter(spec: Any, meta: Column) -> Column:
    """A Column for ``spec`` (dict or JSON text)."""
    if isinstance(spec, str):
        try:
            spec = json.loads(spec)
        except ValueError as e:
            raise Validation(f"filter is not JSON: {e}") from None
    if not isinstance(spec, dict):
        raise Validation("filter must be an object")
    return _object(spec, F.try_parse_json(meta))


def _object(spec: dict, meta: Column) -> Column:
    return _all([_entry(name, value, meta) for name, value in spec.items()])


def _all(parts: list[Column]) -> Column:
    return reduce(and_, parts) if parts else F.lit(True)


def _entry(name: str, value: Any, meta: Column) -> Column:
    if name in ("$and", "$or"):
        if not isinstance(value, list) or not all(isinstance(v, dict) for v in value):
            raise Validation(f"{name} needs an array of filters")
        parts = [_object(v, meta) for v in value]
        return _all(parts) if name == "$and" or not parts else reduce(or_, parts)
    if name == "$not":
        if not isinstance(value, dict):
            raise Validation("$not needs a filter")
        return ~_object(value, meta)
    if name.startswith("$"):
        raise Validation(f"unsupported operator {name}")
    if not _FIELD.fullmatch(name):
        raise Validation(f"bad field name {name!r}")
    path = f"$['{name}']"
    if not isinstance(value, dict):
        return _equal(meta, path, value)
    if not value:
        raise Validation(f"no operator for {name}")
    return _all([_operator(op, operand, meta, path) for op, operand in value.items()])


def _operator(op: str, operand: Any, meta: Column, path: str) -> Column:
    if op == "$eq":
        return _equal(meta, path, operand)
    if op == "$ne":
        return ~_equal(meta, path, operand)
    if op in _RANGES:
        if isinstance(operand, bool) or not isinstance(operand, (int, float)):
            raise Validation(f"{op} needs a number")
        return getattr(F.try_variant_get(meta, path, "double"), _RANGES[op])(F.lit(float(operand)))
    if op in ("$in", "$nin"):
        if not isinstance(operand, list):
            raise Validation(f"{op} needs an array")
        if not operand:
            return F.lit(op == "$nin")
        any_of = reduce(or_, [_equal(meta, path, v) for v in operand])
        return any_of if op == "$in" else ~any_of
    raise Validation(f"unsupported operator {op}")


def _equal(meta: Column, path: str, value: Any) -> Column:
    """Numbers are compared as numbers, in double precision where both are exact in it; all else as JSON text."""
    if isinstance(value, dict):
        raise Validation("cannot compare with an object")
    found = F.try_variant_get(meta, path, "variant")
    text = F.to_json(found) == F.lit(json.dumps(_plain(value), separators=(",", ":"), ensure_ascii=False))
    if isinstance(value, bool) or not isinstance(value, (int, float)) or isinstance(value, int) and abs(value) >= 2**53:
        return text
    number = F.schema_of_variant(found).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL|INT|SMALLINT|TINYINT)")
    same = F.try_variant_get(meta, path, "double") == F.lit(float(value))
    return F.when(found.isNull(), F.lit(None).cast("boolean")).otherwise(F.coalesce(number & same, F.lit(False)))


def _plain(value: Any) -> Any:
    if isinstance(value, list):
        return [_plain(v) for v in value]
    return int(value) if isinstance(value, float) and value.is_integer() else value
