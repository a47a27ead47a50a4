"""Declared fields of the metadata as columns beside it, so that filters reach the Parquet scan and skip row groups.

``with_fields`` extracts the fields when vectors are stored; ``compile_typed`` is ``compile_filter`` with what a matching row must have in these
columns put before it. The full filter stays behind, so the rows are the same whatever is declared.
"""

from __future__ import annotations

import json
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakevec.errors import Validation
from lakevec.functions.json_filter import _FIELD, _RANGES, compile_filter

KINDS = ("double", "string")


def column(name: str) -> str:
    return f"meta_{name}"


def with_fields(vectors: DataFrame, fields: dict[str, str]) -> DataFrame:
    """``vectors`` with a column for each of ``fields`` (name: double or string) taken from meta; null where it is missing or of another kind."""
    meta = F.try_parse_json("meta")
    for name, kind in fields.items():
        if kind not in KINDS or not _FIELD.fullmatch(name):
            raise Validation(f"cannot declare {name!r} as {kind}")
    return vectors.withColumns({column(name): F.try_variant_get(meta, f"$['{name}']", kind) for name, kind in fields.items()})


def compile_typed(spec: Any, meta: Column, fields: dict[str, str]) -> Column:
    """The filter ``spec`` over rows that ``with_fields`` has made."""
    exact = compile_filter(spec, meta)
    needed = _needed(json.loads(spec) if isinstance(spec, str) else spec, fields)
    return exact if needed is None else needed & exact


def _needed(spec: dict, fields: dict[str, str]) -> Column | None:
    """What every row that ``spec`` takes has in the declared columns; None if that says nothing."""
    parts = [p for name, value in spec.items() if (p := _entry(name, value, fields)) is not None]
    return reduce(and_, parts) if parts else None


def _entry(name: str, value: Any, fields: dict[str, str]) -> Column | None:
    if name in ("$and", "$or"):
        parts = [_needed(v, fields) for v in value]
        if name == "$or" and parts and all(p is not None for p in parts):
            return reduce(or_, parts)
        known = [p for p in parts if p is not None]
        return reduce(and_, known) if name == "$and" and known else None
    if name not in fields:
        return None
    own = F.col(column(name))
    if not isinstance(value, dict):
        return _same(own, fields[name], [value])
    parts = []
    for op, operand in value.items():
        if op in _RANGES and fields[name] == "double":
            parts.append(getattr(own, _RANGES[op])(F.lit(float(operand))))
        elif op in ("$eq", "$in") and operand != []:
            parts.append(_same(own, fields[name], operand if op == "$in" else [operand]))
    parts = [p for p in parts if p is not None]
    return reduce(and_, parts) if parts else None


def _same(own: Column, kind: str, values: list) -> Column | None:
    if kind == "double" and all(isinstance(v, (int, float)) and not isinstance(v, bool) and abs(v) < 2**53 for v in values):
        return own.isin([float(v) for v in values])
    return own.isin(values) if kind == "string" and all(isinstance(v, str) for v in values) else None
