"""A small semantic layer: named dimensions and measures over a fact table, with rollups and pivots.

Subtotal rows are told apart by ``_g_<dimension>`` (1: summed over), never by null.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakevec.errors import Validation

ROW_LIMIT, MAX_PIVOT_COLUMNS = 200, 200


@dataclass(frozen=True)
class Dimension:
    name: str
    column: Callable[[], Column]
    description: str = ""


@dataclass(frozen=True)
class Measure:
    name: str
    aggregate: Callable[[], Column]
    description: str = ""


@dataclass(frozen=True)
class Model:
    dimensions: dict[str, Dimension]
    measures: dict[str, Measure]

    @classmethod
    def of(cls, dimensions: list[Dimension], measures: list[Measure]) -> Model:
        return cls({d.name: d for d in dimensions}, {m.name: m for m in measures})


def name_list(given: str | list[str] | None) -> list[str]:
    """Names from a comma-separated text or a list: trimmed, without repeats, in order."""
    parts = given.split(",") if isinstance(given, str) else given or []
    return list(dict.fromkeys(p.strip() for p in parts if p.strip()))


def _checked(model: Model, rows, cols, measure: str) -> tuple[list[str], list[str], Measure]:
    rows, cols = name_list(rows), name_list(cols)
    if not rows:
        raise Validation("at least one row dimension is needed")
    unknown = [n for n in rows + cols if n not in model.dimensions]
    if unknown:
        raise Validation(f"unknown dimensions: {', '.join(unknown)}")
    if both := [n for n in rows if n in cols]:
        raise Validation(f"dimensions in rows and columns: {', '.join(both)}")
    if measure not in model.measures:
        raise Validation(f"unknown measure: {measure}")
    return rows, cols, model.measures[measure]


def mentions_measure(where: str | None, model: Model) -> bool:
    return bool(where) and any(re.search(rf"\b{re.escape(m)}\b", where) for m in model.measures)


def _cells(fact: DataFrame, model: Model, names: list[str], where: str | None) -> DataFrame:
    """The fact with its dimensions named, before any grouping; a WHERE text may use them and the fact's columns."""
    named = fact.withColumns({n: model.dimensions[n].column() for n in names})
    return named.where(where) if where and not mentions_measure(where, model) else named


def pivot(fact: DataFrame, model: Model, rows, measure: str, cols=None, where: str | None = None, limit: int = ROW_LIMIT, rollup: bool = True) -> DataFrame:
    """Rows by ``rows`` (with subtotals of every prefix if ``rollup``), columns by the values of ``cols``.

    A ``where`` text that names a measure filters the aggregated rows instead.
    """
    rows, cols, m = _checked(model, rows, cols, measure)
    named = _cells(fact, model, rows + cols, where)
    having = where if mentions_measure(where, model) else None
    flags = [f"_g_{r}" for r in rows]
    order = [x for r in rows for x in (F.desc(f"_g_{r}"), F.asc_nulls_first(r))]
    if not cols:
        if rollup:
            out = named.rollup(*rows).agg(*(F.grouping(r).cast("int").alias(f) for r, f in zip(rows, flags)), m.aggregate().alias(m.name))
        else:
            out = named.groupBy(*rows).agg(*(F.lit(0).alias(f) for f in flags), m.aggregate().alias(m.name))
            order = [F.desc(m.name), F.asc_nulls_first(rows[0])] if len(rows) == 1 else [F.asc_nulls_first(r) for r in rows]
        out = out.where(having) if having else out
        return out.select(*rows, *flags, m.name).orderBy(*order).limit(limit)
    sets = [[F.col(r) for r in rows[:n]] + [F.col(c) for c in cols] for n in range(len(rows), -1 if rollup else len(rows) - 1, -1)]
    cells = named.groupingSets(sets, *rows, *cols).agg(*(F.grouping(r).cast("int").alias(f) for r, f in zip(rows, flags)), m.aggregate().alias(m.name))
    cells = cells.where(having) if having else cells
    for c in cols:
        cells = cells.where(F.col(c).isNotNull())
    values = [sorted(r[0] for r in named.select(F.col(c).cast("string")).where(F.col(c).isNotNull()).distinct().limit(MAX_PIVOT_COLUMNS + 1).collect()) for c in cols]
    heads = list(product(*values))
    if len(heads) > MAX_PIVOT_COLUMNS:
        raise Validation(f"more than {MAX_PIVOT_COLUMNS} columns")
    sized = lambda v: f"{len(v)}:{v}"  # noqa: E731  no two lists of values have the same
    head = F.concat(*(F.concat(F.length(F.col(c).cast("string")), F.lit(":"), F.col(c).cast("string")) for c in cols))
    spread = cells.withColumn("_head", head).groupBy(*rows, *flags).pivot("_head", ["".join(map(sized, v)) for v in heads]).agg(F.first(m.name))
    return spread.toDF(*rows, *flags, *headings(heads, {*rows, *flags})).orderBy(*order).limit(limit)


def headings(values: list[tuple[str, ...]], taken: set[str]) -> list[str]:
    """One column name for each tuple of values: joined by _; where that is ambiguous each _ in a value is doubled, and a name that is still
    taken gets a number. Names are compared in lower case, as Spark does."""
    plain = ["_".join(v).lower() for v in values]
    out, used = [], {t.lower() for t in taken}
    for v, p in zip(values, plain):
        name = "_".join(v) if plain.count(p) == 1 else "_".join(x.replace("_", "__") for x in v)
        n, free = 2, name
        while free.lower() in used:
            n, free = n + 1, f"{name}_{n}"
        used.add(free.lower())
        out.append(free)
    return out


def inferred(columns: list[str], model: Model) -> tuple[list[str], str] | None:
    """Row dimensions and measure of a result whose columns are dimensions and then one measure; else None."""
    *rows, measure = [c for c in columns if not c.startswith("_g_")] or [""]
    return (rows, measure) if rows and measure in model.measures and all(r in model.dimensions for r in rows) else None


def render(table: DataFrame, rows: list[str]) -> list[list[str]]:
    """A pivot's rows as text: TOTAL for the grand total, blanks below a subtotal's level, (NULL) for data nulls."""
    out = []
    for r in table.collect():
        cells = []
        for i, name in enumerate(rows):
            above = all(r[f"_g_{n}"] for n in rows)
            cells.append("TOTAL" if above and i == 0 else "" if r[f"_g_{name}"] else "(NULL)" if r[name] is None else str(r[name]))
        out.append(cells + ["" if r[c] is None else f"{r[c]:,}" if isinstance(r[c], int) else f"{r[c]:,.2f}" if isinstance(r[c], float) else str(r[c]) for c in table.columns if c not in rows and not c.startswith("_g_")])
    return out
