import pytest
from pyspark.sql import functions as F

from lakevec.errors import Validation
from lakevec.functions.json_filter import compile_filter

ROWS = [('{"label":"a","tier":1}',), ('{"label":"a","tier":2}',), ('{"label":"b","tier":1}',), ('{"label":"o\'brien","tier":"1"}',), ("{}",), (None,), ("not json",), ('{"tags":["x","y"],"a-b":true,"n":null}',)]


@pytest.fixture(scope="module")
def meta(spark):
    return spark.createDataFrame([(i, m) for i, (m,) in enumerate(ROWS)], "i int, meta string")


@pytest.mark.parametrize("spec, want", [
    ({}, {0, 1, 2, 3, 4, 5, 6, 7}),
    ({"label": "a"}, {0, 1}),
    ('{"label": "a"}', {0, 1}),
    ({"tier": 1}, {0, 2}),
    ({"tier": 1.0}, {0, 2}),
    ({"tier": "1"}, {3}),
    ({"label": {"$eq": "o'brien"}}, {3}),
    ({"label": {"$ne": "a"}}, {2, 3}),
    ({"tier": {"$gt": 1}}, {1}),
    ({"tier": {"$lte": 1, "$gte": 1}}, {0, 2, 3}),
    ({"tier": {"$in": [1, 2]}}, {0, 1, 2}),
    ({"tier": {"$in": []}}, set()),
    ({"tier": {"$nin": []}}, {0, 1, 2, 3, 4, 5, 6, 7}),
    ({"tier": {"$nin": [2]}}, {0, 2, 3}),
    ({"$and": [{"label": "a"}, {"tier": {"$gte": 2}}]}, {1}),
    ({"$or": [{"label": "b"}, {"tier": 2}]}, {1, 2}),
    ({"$and": []}, {0, 1, 2, 3, 4, 5, 6, 7}),
    ({"$or": []}, {0, 1, 2, 3, 4, 5, 6, 7}),
    ({"$not": {"label": "a"}}, {2, 3}),
    ({"tags": ["x", "y"]}, {7}),
    ({"a-b": True}, {7}),
    ({"n": None}, {7}),
])
def test_rows(meta, spec, want):
    assert {r.i for r in meta.where(compile_filter(spec, F.col("meta"))).collect()} == want


@pytest.mark.parametrize("value, want", [(1e20, {0}), (1.5e-7, {1}), (1, {2, 3}), (100, {4, 5}), (0.1, {6}), (2**53 + 1, {7}), (2**53 - 1, {8}), (True, {9}), ("1", {10})])
def test_numbers_are_equal_however_spelled(spark, value, want):
    texts = ["1e20", "1.5e-7", "1", "1.0", "1e2", "100.00", "0.10", str(2**53 + 1), str(2**53 - 1), "true", '"1"', "null", "[1]"]
    rows = spark.createDataFrame([(i, f'{{"x":{t}}}') for i, t in enumerate(texts)] + [(99, "{}")], "i int, meta string")
    assert {r.i for r in rows.where(compile_filter({"x": value}, F.col("meta"))).collect()} == want
    assert {r.i for r in rows.where(compile_filter({"x": {"$ne": value}}, F.col("meta"))).collect()} == set(range(13)) - want


@pytest.mark.parametrize("spec", [[], "x", {"": 1}, {"1abc": 1}, {"weird;DROP": 1}, {"a b": 1}, {"$leading": 1}, {"a.b": 1}, {"f": {"$regex": "x"}}, {"f": {}}, {"f": {"$gt": "5"}}, {"f": {"$gt": True}}, {"f": {"$in": 1}}, {"$and": {}}, {"$not": []}, {"f": {"$not": {"$eq": 1}}}])
def test_refused(spark, spec):
    with pytest.raises(Validation):
        compile_filter(spec, F.col("meta"))
