import numpy as np
import pytest
from pyspark.sql import functions as F

from lakevec import names
from lakevec.errors import Conflict, NotFound, Unsupported, Validation
from lakevec.functions.distance import vector_literal
from lakevec.operators import vectors
from lakevec.sources import snapshot, tables


@pytest.fixture(scope="module")
def index(spark):
    rows = [("anchor", [1.0, 0.0, 0.0, 0.0], '{"label":"a","tier":1}'), ("near", [0.9, 0.1, 0.0, 0.0], '{"label":"a","tier":2}'), ("far", [0.0, 0.0, 0.0, 1.0], '{"label":"b","tier":1}')]
    return spark.createDataFrame(rows, "key string, vec array<float>, meta string")


Q = [1.0, 0.0, 0.0, 0.0]


def test_nearest(index):
    got = vectors.search(index, vector_literal(Q), 2).collect()
    assert [r.key for r in got] == ["anchor", "near"] and got[0].distance < 0.001 < got[1].distance and got[0].meta
    assert [r.key for r in vectors.search(index, vector_literal(Q), 3, "euclidean").collect()] == ["anchor", "near", "far"]
    assert {r.key for r in vectors.search(index, vector_literal(Q), 5, where={"label": "a"}).collect()} == {"anchor", "near"}
    for bad in (lambda: vectors.search(index, vector_literal(Q), 0), lambda: vectors.search(index, vector_literal(Q), 101), lambda: vectors.search(index, vector_literal(Q), 1, "dot"), lambda: vectors.search(index, vector_literal(Q), 1, where={"a": 1}, mode="x")):
        with pytest.raises(Validation):
            bad()


def test_oversampling_can_miss_what_exact_finds(spark):
    rows = spark.range(300).select(F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("key"), F.array(F.lit(1.0), F.col("id") / 1000).cast("array<float>").alias("vec"), F.when(F.col("id") > 250, '{"rare":1}').otherwise("{}").alias("meta"))
    q = vector_literal([1.0, 0.0])
    assert vectors.search(rows, q, 2, where={"rare": 1}).count() == 0
    assert [r.key for r in vectors.search(rows, q, 2, where={"rare": 1}, mode="exact").collect()] == ["k251", "k252"]


def test_knn_join_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8)).round(3)
    x[10:20] = x[0]  # ties
    rows = spark.createDataFrame([(f"k{i:03d}", v.tolist()) for i, v in enumerate(x)], "key string, vec array<double>").repartition(7)
    got = {(r.query_key, r["rank"]): r.key for r in vectors.knn_join(rows, rows.where("key < 'k007'"), 12, "euclidean", block=3).collect()}
    for i in range(7):
        d = np.sqrt(((x - x[i]) ** 2).sum(1)).round(9)
        want = sorted(range(300), key=lambda j: (d[j], f"k{j:03d}"))[:12]
        assert [got[f"k{i:03d}", n] for n in range(1, 13)] == [f"k{j:03d}" for j in want]


def test_knn_join_equals_search_on_odd_vectors(spark, monkeypatch):
    """Zero and missing vectors, fewer numbers than k in a batch, several parts, an empty side, wrong sizes."""
    rows = [("a", [0.0, 0.0]), ("b", None), ("c", [1.0, 0.0]), ("d", [0.0, 0.0]), ("e", [1.0, 1.0]), ("f", [None, 1.0]), ("g", [0.0, 0.0])]
    v = spark.createDataFrame(rows, "key string, vec array<float>").withColumn("meta", F.lit(None).cast("string"))
    want = {}
    for key, vec in rows:
        if vec and None not in vec:
            want[key] = [(r.key, r.distance) for r in vectors.search(v.where("key <> 'f'"), vector_literal(vec), 6).collect()]
    assert [k for k, _ in want["c"]] == ["c", "e", "a", "d", "g"] and np.isnan(want["c"][2][1])
    for part in (64 << 20, 900):
        monkeypatch.setattr(vectors, "PART_BYTES", part)
        got = {}
        for r in vectors.knn_join(v.where("key <> 'f'").repartition(3), v.where("key <> 'f'"), 6, block=2).orderBy("query_key", "rank").collect():
            got.setdefault(r.query_key, []).append((r.key, r.distance))
        assert {q: [k for k, _ in x] for q, x in got.items()} == {q: [k for k, _ in x] for q, x in want.items()}
        assert all(np.allclose([d for _, d in got[q]], [d for _, d in want[q]], equal_nan=True) for q in want)
    assert vectors.knn_join(v.where("vec is null"), v, 2).count() == 0 == vectors.knn_join(v, v.where("vec is null"), 2).count()
    assert {r.key for r in vectors.knn_join(v, v.where("key = 'c'"), 7).collect()} == set("acdefg")  # a null number is NaN
    with pytest.raises(Validation):
        vectors.knn_join(v, spark.createDataFrame([("x", [1.0]), ("y", [1.0, 2.0])], "key string, vec array<float>"), 1)
    with pytest.raises(Exception, match="length 1"):
        vectors.knn_join(v, spark.createDataFrame([("x", [1.0])], "key string, vec array<float>"), 1).collect()


def test_knn_join_holds_no_more_for_larger_batches():
    """What a task takes for its distances, over batches of 2,000 and of 10,000 rows."""
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa

    rng, most = np.random.default_rng(2), []
    shared = SimpleNamespace(value=([f"q{i}" for i in range(512)], rng.normal(size=(512, 64)), None))
    for n in (2_000, 10_000):
        vecs = pa.FixedSizeListArray.from_arrays(pa.array(rng.normal(size=n * 64).astype(np.float32)), 64).cast(pa.list_(pa.float32()))
        batch = pa.RecordBatch.from_arrays([pa.array([f"k{i:05d}" for i in range(n)]), vecs], names=["key", "vec"])
        tracemalloc.start()
        found = sum(b.num_rows for b in vectors._nearest(shared, 20, "euclidean", 512)([batch]))
        most.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert found == 512 * 20
    assert most[1] < 1.5 * most[0] and most[1] < 16 * vectors.TILE_BYTES


def test_upsert_get_delete(spark, index):
    changes = spark.createDataFrame([("near", [0.0] * 4, None, 1), ("near", [0.5] * 4, '{"v":2}', 2), ("new", [1.0] * 4, None, 1)], "key string, vec array<float>, meta string, seq int")
    after = {r.key: (r.vec, r.meta) for r in vectors.upsert(index, changes, "seq").collect()}
    assert set(after) == {"anchor", "near", "far", "new"} and after["near"] == ([0.5] * 4, '{"v":2}') and after["new"][1] is None
    got = vectors.get(index, ["anchor", "missing", "far", "far"], data=True)
    assert got.columns == ["key", "vec"] and {r.key for r in got.collect()} == {"anchor", "far"}
    gone = spark.createDataFrame([("far",), ("missing",)], "key string")
    assert {r.key for r in vectors.delete(vectors.delete(index, gone), gone).collect()} == {"anchor", "near"}


def test_pages(spark):
    rows = spark.createDataFrame([(k,) for k in "edcba"], "key string")
    def page(after):
        got = vectors.page(rows, "key", 2, after).collect()
        return [r.key for r in got], got[0].next_token

    assert [page(a) for a in (None, "b", "d")] == [(["a", "b"], "b"), (["c", "d"], "d"), (["e"], None)]
    assert names.page_size(None) == 100 and names.page_size(9999) == 500
    named = spark.createDataFrame([("alpha-1",), ("alpha-2",), ("beta",)], "name string")
    assert vectors.page(named, "name", prefix="alpha").count() == 2


def test_checks(spark, index):
    assert vectors.check(index, 4) is index
    bad = spark.createDataFrame([("a", [1.0, 2.0]), ("b", None), ("c", [1.0, float("nan"), 0.0, 0.0]), ("", [1.0] * 4), (None, [1.0] * 4), ("d", [1.0, None, 0.0, 0.0]), ("e", [float("inf")] + [0.0] * 3), ("f", [1.0] * 4)], "key string, vec array<float>")
    assert vectors.invalid(bad, 4).count() == 7
    with pytest.raises(Validation, match="length 4, but has length 2"):
        vectors.check(bad.where("key = 'a'"), 4)


def test_snapshot_round_trip_skips_damage(spark, tmp_path):
    rows = spark.createDataFrame([(k, [1.0, 0.0, 0.0], f'{{"label":"{k}"}}') for k in ("alpha", "beta", "gamma")], "key string, vec array<float>, meta string")
    path = f"{tmp_path}/s"
    snapshot.write_snapshot(rows, path)
    with open(f"{path}/damaged.txt", "w") as f:
        f.write('{"key": "broken", "data": [1,\n{"nothing": 1}\n{"key":"short","data":[1]}\n')
    got = snapshot.read_snapshot(spark, path, 3).collect()
    assert {r.key: r.meta for r in got} == {k: f'{{"label":"{k}"}}' for k in ("alpha", "beta", "gamma")} and all(r.vec == [1, 0, 0] for r in got)


def test_names():
    assert names.parse_vector_arn(names.vector_arn("bkt", "idx")) == ("bkt", "idx") and names.parse_vector_arn(names.vector_arn("bkt")) == ("bkt", None)
    assert names.target(index_arn=names.vector_arn("b", "i")) == names.target(bucket="b", index="i") == ("b", "i")
    for bad in (lambda: names.parse_vector_arn("arn:aws:s3:::x"), lambda: names.target(), lambda: names.target("arn", "b", "i"), lambda: names.target(index_arn=names.vector_arn("b")), lambda: names.sized("ab", "name", names.NAME_CHARS)):
        with pytest.raises(Validation):
            bad()
    assert names.parse_table_arn(names.table_arn("b", "t")) == ("b", "t") and names.parse_table_arn(names.table_arn("b")) == ("b", None)
    assert names.index_spec("idx", 4096, "cosine")["dtype"] == "float32"
    for bad in (lambda: names.parse_table_arn(names.vector_arn("b")), lambda: names.index_spec("idx", 4097, "cosine"), lambda: names.index_spec("idx", 0, "cosine"), lambda: names.index_spec("idx", 4, "dot"), lambda: names.index_spec("i", 4, "cosine"), lambda: names.index_spec("idx", 4, "cosine", "float64")):
        with pytest.raises(Validation):
            bad()
    assert names.version_token("s3://x/metadata/00003-abc.json").startswith("00003-") and names.version_token("a") == f"0-{97:016x}"


def test_table_catalog(spark):
    fields = [{"name": "id", "type": "int", "required": True}, {"name": "name", "type": "string"}, {"name": "m", "type": {"type": "map", "key": "string", "value": "double"}}]
    space = tables.create_namespace(spark, ["lv", "test"])
    try:
        made = tables.create_table(spark, ["lv", "test"], "small", fields)
        assert made.dtypes == [("id", "int"), ("name", "string"), ("m", "map<string,double>")] and made.count() == 0
        with pytest.raises(Conflict):
            tables.create_table(spark, ["lv", "test"], "small", fields)
        with pytest.raises(NotFound):
            tables.create_table(spark, ["nowhere"], "small", fields)
        with pytest.raises(Conflict):
            tables.create_namespace(spark, ["lv", "test"])
        with pytest.raises(Unsupported):
            tables.create_table(spark, ["lv", "test"], "other", fields, "AVRO")
        assert tables.get_namespace(spark, ["lv", "test"]) in tables.list_namespaces(spark, "lv_")
        with pytest.raises(Conflict):
            tables.drop_namespace(spark, ["lv", "test"])
        with pytest.raises(NotFound):
            tables.get_namespace(spark, ["nowhere"])
        at = spark.sql("SELECT TIMESTAMP '2024-01-02 03:04:05.678901' AS at").select(names.iso_time(F.col("at")).alias("s")).first().s
        assert at == "2024-01-02T03:04:05.678901000Z"
        tables.drop_table(spark, ["lv", "test"], "small")
        with pytest.raises(NotFound):
            tables.drop_table(spark, ["lv", "test"], "small")
    finally:
        spark.sql(f"DROP NAMESPACE {space} CASCADE")
    for bad in ([], [""]):
        with pytest.raises(Validation):
            tables.create_namespace(spark, bad)
    with pytest.raises(Validation):
        tables.spark_type("nonsense")
    assert [f["id"] for f in tables.normal_fields([{"name": "a", "type": "int"}, {"name": "b", "type": "int", "id": 9}])] == [1, 9]


def test_index_recall_and_pruning(spark, tmp_path):
    from lakevec.operators import ivf

    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 16))[rng.integers(0, 40, 2000)] + rng.normal(size=(2000, 16)) * 0.6
    rows = spark.createDataFrame([(f"k{i:04d}", v.tolist(), None) for i, v in enumerate(x)], "key string, vec array<float>, meta string")
    for metric in ("cosine", "euclidean"):
        centroids = ivf.fit(rows, 24, metric)
        path = f"{tmp_path}/{metric}"
        ivf.write_index(rows, path, centroids, metric)
        assert spark.read.parquet(path).count() == 2000
        found = total = 0
        for i in range(0, 2000, 250):
            got = ivf.search_index(spark, path, centroids, x[i].tolist(), 10, metric)
            exact = {r.key for r in vectors.search(rows, vector_literal(x[i].tolist()), 10, metric).collect()}
            found, total = found + len(exact & {r.key for r in got.collect()}), total + 10
        assert found / total >= 0.9
        assert "PartitionFilters: [isnotnull(list" in got._jdf.queryExecution().toString() or "list" in got._jdf.queryExecution().toString().split("PartitionFilters")[1][:60]
    assert len(ivf.fit(rows.limit(0), 4)) == 0
