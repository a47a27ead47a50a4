"""Changes to tables as new DataFrames: the caller writes the result beside the old version and switches over."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_key(columns: list[Column | str]) -> Column:
    """MD5 of the columns as text, joined by |; nulls are skipped, as in concat_ws. Different rows may share a key: ``a|b``, ``c``
    and ``a``, ``b|c`` do."""
    return F.md5(F.concat_ws("|", *((F.col(c) if isinstance(c, str) else c).cast("string") for c in columns)))


def new_rows(target: DataFrame, source: DataFrame, columns: list[str], hashed: bool = False) -> DataFrame:
    """Rows of ``source`` whose values of ``columns`` no row of ``target`` has (nulls are equal); repeats inside ``source`` stay, and a second run
    adds none. ``hashed``: rows are told apart by ``row_key`` alone."""
    if hashed:
        known = target.select(row_key(columns).alias("_key"))
        return source.withColumn("_key", row_key(columns)).join(known, "_key", "left_anti").drop("_key")
    known = target.select(*(F.col(c).alias(f"_known{n}") for n, c in enumerate(columns)))
    same = [source[c].eqNullSafe(known[f"_known{n}"]) for n, c in enumerate(columns)]
    return source.join(known, reduce(and_, same), "left_anti")


def merge_insert(target: DataFrame, source: DataFrame, columns: list[str], hashed: bool = False) -> DataFrame:
    return target.unionByName(new_rows(target, source, columns, hashed))


def delete_where(rows: DataFrame, predicate: Column) -> DataFrame:
    """Rows for which ``predicate`` is not true; unknown is not true."""
    return rows.where(~F.coalesce(predicate, F.lit(False)))


def update_where(rows: DataFrame, predicate: Column, **changes: Column) -> DataFrame:
    return rows.withColumns({c: F.when(predicate, v).otherwise(F.col(c)) for c, v in changes.items()})


def top_n(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group, numbered by rn."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rn") <= n)
