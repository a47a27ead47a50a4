"""Joins by order instead of equality: the last row before a time, and rows whose intervals meet.

Both split a hot key. ``asof_join`` deals both sides by key and slice of time; slices hold about as many rows each, so no task gets more than a
slice of a key, and the last right row of earlier slices is carried into each slice as one more row. ``range_join`` deals intervals
into bins by length, with an exact check behind; bins with many rows are split again.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakevec.errors import Validation

SLICE_ROWS, MAX_SLICES = 2_000_000, 10_000
BIN_ROWS, MAX_LEVELS = 200_000, 1_100


def number(column: Column, kind: T.DataType) -> Column:
    """A time or number in an order that Python and Spark compare alike: microseconds, days or the number itself."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(column.cast("timestamp"))
    return F.unix_date(column) if isinstance(kind, T.DateType) else column


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_at: str, right_at: str, columns: list[str], prefix: str = "", strict: bool = False, tolerance: int | float | None = None, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Every row of ``left`` with ``columns`` of the last row of ``right`` of the same ``by`` whose ``right_at`` is no later than ``left_at``
    (``strict``: is earlier). ``columns`` come under their names behind ``prefix``; ``tolerance``: how much earlier the row may be, in
    microseconds for timestamps, else in the column's own unit.

    Defined results: each left row comes once, with nulls where no row matches; rows with a null key or time match nothing; of right rows
    at one time the greatest by ``columns`` is the last; repeated left rows stay.
    """
    taken = {c.lower() for c in left.columns} & {f"{prefix}{c}".lower() for c in columns}
    if taken:
        raise Validation(f"columns of both sides have the name {', '.join(sorted(taken))}")
    at_l, at_r = number(F.col(left_at), left.schema[left_at].dataType), number(F.col(right_at), right.schema[right_at].dataType)
    keys = lambda df: [F.col(c).cast(left.schema[c].dataType).alias(f"_k{n}") for n, c in enumerate(by)]
    k = [f"_k{n}" for n in range(len(by))]
    row, found = F.struct(*(F.col(c) for c in left.columns)), F.struct(at_r.alias("_at"), *(F.col(c) for c in columns))
    lefts = left.select(*keys(left), at_l.alias("_t"), F.lit(1 if not strict else -1).alias("_side"), row.alias("_row"))
    rights = right.select(*keys(right), at_r.alias("_t"), F.lit(0).alias("_side"), found.alias("_found"))
    whole = reduce(and_, [F.col(c).isNotNull() for c in [*k, "_t"]])
    rights = rights.where(whole)
    alone = lefts.where(~whole)
    lefts = lefts.where(whole)
    lefts, rights = sliced(lefts, rights, slice_rows)
    slices = Window.partitionBy(*k).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    last = rights.groupBy(*k, "_slice").agg(F.max("_found").alias("_last"))
    heads = last.unionByName(lefts.select(*k, "_slice").distinct(), allowMissingColumns=True).groupBy(*k, "_slice").agg(F.max("_last").alias("_last"))
    carried = heads.select(*k, "_slice", F.last("_last", ignorenulls=True).over(slices).alias("_found")).where("_found is not null").withColumn("_side", F.lit(-2))
    rows = lefts.unionByName(rights, allowMissingColumns=True).unionByName(carried, allowMissingColumns=True)
    order = Window.partitionBy(*k, "_slice").orderBy(F.col("_t").asc_nulls_first(), "_side", "_found").rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.withColumn("_found", F.last("_found", ignorenulls=True).over(order)).where("_row is not null")
    if tolerance is not None:
        joined = joined.withColumn("_found", F.when(F.col("_t") - F.col("_found._at") <= tolerance, F.col("_found")))
    joined = joined.select("_row", "_found").unionByName(alone.select("_row"), allowMissingColumns=True)
    return joined.select("_row.*", *(F.col(f"_found.{c}").alias(f"{prefix}{c}") for c in columns))


def sliced(left: DataFrame, right: DataFrame, slice_rows: int = SLICE_ROWS) -> tuple[DataFrame, DataFrame]:
    """Both with ``_slice``, the number of the stretch of ``_t`` that a row is in. Stretches are cut at quantiles of both sides' times, so each
    has about ``slice_rows`` rows (more where that many share one time)."""
    times = left.select("_t").unionByName(right.select("_t"))
    n = times.count()
    pieces = min(MAX_SLICES, -(-n // slice_rows))
    if pieces < 2:
        return left.withColumn("_slice", F.lit(0)), right.withColumn("_slice", F.lit(0))
    cuts = times.agg(F.percentile_approx(F.col("_t").cast("double"), [k / pieces for k in range(1, pieces)], max(10_000, 10 * pieces))).first()[0]  # MAX_SLICES numbers at most
    splits = [-float("inf"), *sorted(set(cuts)), float("inf")]
    bucketed = Bucketizer(splits=splits, inputCol="_d", outputCol="_b", handleInvalid="keep")
    own = lambda df: bucketed.transform(df.withColumn("_d", F.col("_t").cast("double"))).withColumn("_slice", F.col("_b").cast("int")).drop("_d", "_b")
    return own(left), own(right)


def range_join(left: DataFrame, right: DataFrame, left_range: tuple[str, str], right_range: tuple[str, str], by: list[str] | None = None, bin_rows: int = BIN_ROWS) -> DataFrame:
    """Pairs of rows of the same ``by`` whose intervals [from, to] have a point in common; a point is an interval with one column twice.
    Columns of both sides must differ, except those of ``by``, which come once.

    Every interval has a level, the least power of two that is no shorter, and lies in one or two bins of that width. Two
    intervals meet in the bins of the longer one's level; the shorter one is dealt into the levels that the other side has. So a row is
    dealt as often as twice the number of levels, however long it is; a pair is found in the first bin that both lie in, once. Bins of more
    than ``bin_rows`` rows of a side are split: each of these rows goes to one part of the bin, the other side's rows to all.

    Defined results: intervals with a null key or end, or that end before they begin, or without finite ends, meet nothing; repeated rows are paired each.
    """
    by = by or []
    clash = {c.lower() for c in left.columns} & {c.lower() for c in right.columns} - {c.lower() for c in by}
    if clash:
        raise Validation(f"columns of both sides have the name {', '.join(sorted(clash))}")
    sides = []
    for df, ends, mark in ((left, left_range, "l"), (right, right_range, "r")):
        a, b = (number(F.col(c), df.schema[c].dataType) for c in ends)
        kept = df.select(*(F.col(c).cast(left.schema[c].dataType).alias(f"_k{n}") for n, c in enumerate(by)), a.alias(f"_{mark}a"), b.alias(f"_{mark}b"), F.struct(*df.columns).alias(f"_{mark}"))
        finite = [F.abs(F.col(c).cast("double")) < F.lit(float("inf")) for c in (f"_{mark}a", f"_{mark}b")]
        real = reduce(and_, [F.col(c).isNotNull() for c in kept.columns[:-1]] + finite + [F.col(f"_{mark}a") <= F.col(f"_{mark}b")])
        length = F.col(f"_{mark}b").cast("double") - F.col(f"_{mark}a").cast("double")
        level = F.when(length > 0, F.ceil(F.log2(length))).otherwise(None).cast("int")
        sides.append(kept.where(real).withColumn("_level", level))
    found = [sorted({r[0] for r in side.select("_level").distinct().collect()} - {None}) for side in sides]  # MAX_LEVELS numbers at most
    # points and what is shorter than all intervals with a length lie in the least level
    least = min([x for levels in found for x in levels], default=0)
    sides = [s.withColumn("_level", F.coalesce("_level", F.lit(least))) for s in sides]
    k = [f"_k{n}" for n in range(len(by))]
    levels = [sorted(set(x) | {least}) for x in found]

    def dealt(side: DataFrame, mark: str, own_level: bool, others: list[int], strictly: bool) -> DataFrame:
        """One row for each bin: of the row's own level, or of the levels of the other side that are no finer (``strictly``: coarser)."""
        if own_level:
            at = side.withColumn("_at", F.col("_level"))
        else:
            at = side.withColumn("_at", F.explode(F.filter(F.array(*map(F.lit, others)), lambda x: x > F.col("_level") if strictly else x >= F.col("_level"))))
        first, last = (F.floor(F.col(f"_{mark}{e}").cast("double") / F.pow(F.lit(2.0), F.col("_at"))) for e in "ab")
        return at.withColumn(f"_{mark}first", first).withColumn("_bin", F.explode(F.sequence(F.col(f"_{mark}first"), last)))

    pairs = None
    for a_own, strictly in ((False, False), (True, True)):
        a = dealt(sides[0], "l", a_own, levels[1], False).drop("_level")
        b = dealt(sides[1], "r", not a_own, levels[0], strictly).drop("_level")
        bins = [*k, "_at", "_bin"]
        a, b = split(a, b, bins, bin_rows)
        met = a.join(b, [*bins, "_part", "_other"])
        met = met.where((F.col("_la") <= F.col("_rb")) & (F.col("_ra") <= F.col("_lb")) & (F.col("_bin") == F.greatest("_lfirst", "_rfirst"))).select("_l", "_r")
        pairs = met if pairs is None else pairs.unionByName(met)
    return pairs.select("_l.*", *(F.col(f"_r.{c}") for c in right.columns if c not in by))


def split(a: DataFrame, b: DataFrame, bins: list[str], bin_rows: int) -> tuple[DataFrame, DataFrame]:
    """Both with ``_part`` and ``_other``: of a bin with many rows of ``a``, each of them has one part, and each of ``b`` all parts; likewise the
    other way round with ``_other``."""
    many = []
    for df in (a, b):
        counts = df.groupBy(*bins).agg(F.count("*").alias("_n")).where(F.col("_n") > bin_rows)
        many.append(counts.select(*bins, F.ceil(F.col("_n") / bin_rows).cast("int").alias("_parts")))
    for n, name in ((0, "_part"), (1, "_other")):
        both = []
        for m, df in enumerate((a, b)):
            with_parts = df.join(many[n], bins, "left")  # a row for each bin that is split
            parts = F.coalesce("_parts", F.lit(1))
            own = F.pmod(F.xxhash64("_l" if m == 0 else "_r", F.lit(name)), parts).cast("int") if m == n else F.explode(F.sequence(F.lit(0), parts - 1))
            both.append(with_parts.withColumn(name, own).drop("_parts"))
        a, b = both
    return a, b
