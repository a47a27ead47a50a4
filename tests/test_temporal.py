import random

import pytest
from pyspark.sql import functions as F

from lakevec.errors import Validation
from lakevec.operators import temporal


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def sides():
    """A key with most of the rows, ties, nulls, keys of one side only, repeated rows."""
    rng = random.Random(2)
    key = lambda: "hot" if rng.random() < 0.7 else rng.choice(["a", "b", "left only", None])
    left = [(key(), rng.choice([None, *range(40)]) if rng.random() < 0.2 else rng.randint(0, 5_000), n) for n in range(1_500)]
    right = [(rng.choice(["hot", "hot", "hot", "a", "b", "right only", None]), rng.choice([None, 7, *range(0, 5_000, 5)]), rng.choice(["x", "y", None]), rng.randint(0, 3)) for _ in range(900)]
    return [*left, *left[:30]], [*right, *right[:10]]


def plain(left, right, strict, tolerance):
    low = lambda v: (v is not None, v)
    out = []
    for k, t, n in left:
        fits = [r for r in right if k is not None and t is not None and r[0] == k and r[1] is not None and (r[1] < t if strict else r[1] <= t)]
        last = max(fits, key=lambda r: (r[1], low(r[2]), low(r[3]))) if fits else (None,) * 4
        if fits and tolerance is not None and t - last[1] > tolerance:
            last = (None,) * 4
        out.append((k, t, n, last[2], last[3], last[1]))
    return sorted(out, key=str)


@pytest.mark.parametrize(("slice_rows", "strict", "tolerance"), [(10**9, False, None), (50, False, None), (3, True, None), (100, True, 60), (200, False, 0)])
def test_asof_equals_brute_force(spark, sides, slice_rows, strict, tolerance):
    left, right = (spark.createDataFrame(rows, schema).repartition(3) for rows, schema in zip(sides, ("k string, t long, n long", "k string, at long, a string, b long")))
    got = temporal.asof_join(left, right, ["k"], "t", "at", ["a", "b", "at"], "last_", strict, tolerance, slice_rows)
    assert got.columns == ["k", "t", "n", "last_a", "last_b", "last_at"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(*sides, strict, tolerance)


def test_a_hot_key_is_cut_into_slices(spark):
    """A key with all rows: no slice, and so no task of the window, gets much more than its share."""
    left = spark.range(20_000).select(F.lit("k").alias("k"), F.col("id").alias("t"))
    right = spark.range(0, 20_000, 7).select(F.lit("k").alias("k"), F.col("id").alias("at"))
    sliced = temporal.sliced(left.select(F.col("t").alias("_t")), right.select(F.col("at").alias("_t")), 1_000)
    counts = [r.n for r in sliced[0].groupBy("_slice").agg(F.count("*").alias("n")).collect()]
    assert len(counts) >= 20 and max(counts) < 2_000
    got = temporal.asof_join(left, right, ["k"], "t", "at", ["at"], slice_rows=1_000)
    assert got.where("at <> t - t % 7").count() == 0 and got.count() == 20_000
    assert "CartesianProduct" not in plan(got) and "NestedLoop" not in plan(got)


def test_asof_edges(spark):
    one = spark.createDataFrame([("a", 5)], "k string, t long")
    none = spark.createDataFrame([], "k string, at long, v string")
    assert [tuple(r) for r in temporal.asof_join(one, none, ["k"], "t", "at", ["v"]).collect()] == [("a", 5, None)]
    assert temporal.asof_join(one.limit(0), none, ["k"], "t", "at", ["v"]).count() == 0
    with pytest.raises(Validation):
        temporal.asof_join(one, none.withColumn("T", F.lit(1)), ["k"], "t", "at", ["T"])
    every = temporal.asof_join(one, spark.createDataFrame([("z", 4, "x")], "k string, at long, v string"), [], "t", "at", ["v"])  # without a key
    assert [tuple(r) for r in every.collect()] == [("a", 5, "x")]


@pytest.mark.parametrize("bin_rows", [10**9, 5])
@pytest.mark.parametrize("kind", ["long", "double"])
def test_range_join_equals_brute_force(spark, bin_rows, kind):
    """Points, short, very long and broken intervals, negative numbers, touching ends, many in one place."""
    rng = random.Random(8)

    def intervals(n):
        for k in range(n):
            a = rng.choice([rng.randint(-300, 300), 0, 64])
            length = rng.choice([0, 0, 1, 5, 64, rng.randint(0, 40), 10_000, -1])
            yield rng.choice(["a", "a", "b", None]), rng.choice([a, a, a, a, None]) if k % 9 == 0 else a, a + length, k

    cast = (lambda v: None if v is None else v / 8) if kind == "double" else (lambda v: v)
    left, right = ([(k, cast(a), cast(b), n) for k, a, b, n in intervals(160)] for _ in range(2))
    left += left[:4]
    if kind == "double":
        left += [("a", float("-inf"), 3.0, 900), ("a", float("nan"), 3.0, 901)]
    want = sorted((x[0], x[3], y[3]) for x in left for y in right if None not in x and None not in y and x[0] == y[0] and x[3] < 900 and x[1] <= x[2] and y[1] <= y[2] and x[1] <= y[2] and y[1] <= x[2])
    a, b = (spark.createDataFrame(rows, f"k string, {m}a {kind}, {m}b {kind}, {m} long") for rows, m in ((left, "l"), (right, "r")))
    got = temporal.range_join(a, b, ("la", "lb"), ("ra", "rb"), ["k"], bin_rows)
    assert got.columns == ["k", "la", "lb", "l", "ra", "rb", "r"]
    assert sorted((r.k, r.l, r.r) for r in got.collect()) == want and len(want) > 1_000
    assert "CartesianProduct" not in plan(got) and "NestedLoop" not in plan(got)


def test_a_hot_bin_is_split(spark):
    rows = spark.range(3_000).select(F.lit(1.0).alias("p"), "id")
    a, b = temporal.split(rows.select(F.lit(0).alias("_bin"), F.struct("id").alias("_l")), rows.limit(7).select(F.lit(0).alias("_bin"), F.struct("id").alias("_r")), ["_bin"], 100)
    counts = a.groupBy("_bin", "_part", "_other").agg(F.count("*").alias("n")).collect()
    assert len(counts) == 30 and max(r.n for r in counts) < 200 and b.count() == 7 * 30
    assert a.join(b, ["_bin", "_part", "_other"]).count() == 21_000
    other = spark.createDataFrame([(0.0, 2.0, "r")], "a double, b double, name string")
    assert temporal.range_join(rows, other, ("p", "p"), ("a", "b"), bin_rows=100).count() == 3_000


def test_long_intervals_are_dealt_a_bounded_number_of_times(spark):
    wide = spark.createDataFrame([(-(10**15), 10**15, "w")], "a long, b long, w string")
    points = spark.range(1_000).select(F.col("id").alias("p"))
    got = temporal.range_join(wide, points, ("a", "b"), ("p", "p"))
    assert got.count() == 1_000
    assert temporal.range_join(wide, points.where("p < 0"), ("a", "b"), ("p", "p")).count() == 0
    with pytest.raises(Validation):
        temporal.range_join(wide, points.withColumnRenamed("p", "A"), ("a", "b"), ("A", "A"))
