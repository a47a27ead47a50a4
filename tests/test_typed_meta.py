import json

import pytest
from pyspark.sql import functions as F

from lakevec.errors import Validation
from lakevec.functions.json_filter import compile_filter
from lakevec.functions.typed_meta import compile_typed, with_fields

METAS = [None, "not json", "{}", *(json.dumps(m) for m in ({"n": 1}, {"n": 1.0}, {"n": "1"}, {"n": True}, {"n": None}, {"n": 2**60}, {"n": [1]}, {"n": 5, "s": "a"}, {"n": -3.5, "s": "b"}, {"s": "5"}, {"s": 5}, {"n": 7, "s": "ä"}, {"n": 2, "s": "", "x": 1}))]
SPECS = [
    {}, {"n": 1}, {"n": "1"}, {"n": True}, {"n": None}, {"n": 2**60}, {"n": [1]}, {"n": {"$gt": 1}}, {"n": {"$gte": 1, "$lt": 6}}, {"n": {"$in": [1, 5]}}, {"n": {"$in": [1, "1"]}}, {"n": {"$in": []}}, {"n": {"$nin": [1]}}, {"n": {"$ne": 1}},
    {"s": "a"}, {"s": "5"}, {"s": 5}, {"s": {"$in": ["a", "ä", ""]}}, {"s": {"$gt": 1}}, {"$not": {"n": 1}}, {"$or": [{"n": 1}, {"s": "b"}]}, {"$or": [{"n": 1}, {"x": 1}]}, {"$or": []}, {"$and": [{"n": {"$lte": 5}}, {"$not": {"s": "a"}}]}, {"x": 1, "n": {"$gt": 0}},
]


def test_rows_are_the_same_and_filters_reach_the_scan(spark, tmp_path):
    fields = {"n": "double", "s": "string"}
    with_fields(spark.createDataFrame(list(enumerate(METAS)), "key int, meta string"), fields).write.parquet(f"{tmp_path}/v")
    rows = spark.read.parquet(f"{tmp_path}/v")
    for spec in SPECS:
        got, want = (sorted(r.key for r in rows.where(p).collect()) for p in (compile_typed(spec, F.col("meta"), fields), compile_filter(spec, F.col("meta"))))
        assert got == want, spec
    for spec, pushed in (({"n": {"$gt": 1}}, "GreaterThan(meta_n,1.0)"), ({"n": 1, "x": 2}, "EqualTo(meta_n,1.0)"), ({"s": {"$in": ["a", "b"]}}, "In(meta_s, [a,b])"), ({"$or": [{"n": 1}, {"s": "b"}]}, "Or(EqualTo(meta_n,1.0),EqualTo(meta_s,b))")):
        plan = rows.where(compile_typed(json.dumps(spec), F.col("meta"), fields))._jdf.queryExecution().executedPlan().toString()
        assert pushed in plan.split("PushedFilters: ")[1], plan
    for bad in ({"a b": "double"}, {"a": "int"}):
        with pytest.raises(Validation):
            with_fields(rows, bad)
    with pytest.raises(Validation):
        compile_typed({"n": {"$gt": "x"}}, F.col("meta"), fields)
