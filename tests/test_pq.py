import numpy as np
import pytest

from lakevec import queries
from lakevec.errors import Validation
from lakevec.operators import ivf, pq, vectors


def frame(spark, x):
    return spark.createDataFrame([(f"k{i:05d}", v.tolist(), None) for i, v in enumerate(x)], "key string, vec array<float>, meta string")


def recall(found, exact):
    found, exact = ({(r.query_key, r.key) for r in df.collect()} for df in (found, exact))
    return len(found & exact) / len(exact)


def test_a_tenth_of_the_lists_is_enough_where_vectors_cluster(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 32))[rng.integers(0, 40, 6_000)] + rng.normal(size=(6_000, 32)) * 0.3
    rows = frame(spark, x)
    for metric in ("cosine", "euclidean"):
        index = pq.write(rows, f"{tmp_path}/{metric}", metric, lists=40, subspaces=16)
        assert index.codes(spark).count() == index.vectors(spark).count() == 6_000
        assert all(len(r.codes) == 16 for r in index.codes(spark).limit(20).collect())
        queries = rows.where("key like '%00'")
        got = pq.knn(spark, index, queries, 10, probes=4)
        assert recall(got, vectors.knn_join(rows, queries, 10, metric)) >= 0.9
        assert sorted(r["rank"] for r in got.where("query_key = 'k00100'").collect()) == [*range(1, 11)]


def test_recall_without_clusters_by_codes_alone(spark, tmp_path):
    """Random vectors, for which lists tell nothing: all codes are read, a sixteenth of the vectors' bytes."""
    x = np.random.default_rng(4).normal(size=(12_000, 64))
    rows = frame(spark, x)
    index, queries = pq.write(rows, f"{tmp_path}/i"), rows.where("key like '%00'")
    assert recall(pq.knn(spark, index, queries, 10), vectors.knn_join(rows, queries, 10)) >= 0.95


def test_stored_once_and_loaded(spark, tmp_path, monkeypatch):
    x = np.random.default_rng(5).normal(size=(800, 10))  # 10 numbers in 4 parts: padded
    rows = frame(spark, x)
    made = pq.write(rows, f"{tmp_path}/i", "euclidean", lists=4, subspaces=4)
    index, queries = pq.load(spark, f"{tmp_path}/i"), rows.where("key like '%50'")
    assert np.array_equal(made.book.centres, index.book.centres) and np.array_equal(made.centroids, index.centroids) and index.book.dimension == 10
    whole = sorted(map(tuple, pq.knn(spark, index, queries, 5, rerank=200).collect()))
    exact = vectors.knn_join(rows, queries, 5, "euclidean").collect()
    assert [(r[0], r[1], r[3]) for r in whole] == sorted((r.query_key, r.key, r["rank"]) for r in exact)  # all rows are candidates
    monkeypatch.setattr(pq, "PART_BYTES", 300_000)  # parts of some queries each change nothing
    assert sorted(map(tuple, pq.knn(spark, index, queries, 5, rerank=200).collect())) == whole
    one = pq.knn(spark, index, queries.where("key = 'k00050'"), 5, rerank=200).collect()
    assert sorted(map(tuple, one)) == [r for r in whole if r[0] == "k00050"]


def test_tables_and_products_agree():
    rng = np.random.default_rng(6)
    for metric in ("cosine", "euclidean"):
        book = pq.Codebook(rng.normal(size=(4, pq.CENTRES, 3)), 12, metric)
        q, codes = rng.normal(size=(pq.MANY, 12)), rng.integers(0, 256, (50, 4)).astype(np.uint8)
        few = np.concatenate([book.estimates(q[:7], codes), book.estimates(q[7:], codes)])
        assert np.allclose(few, book.estimates(q, codes), atol=1e-4)
        ready, decoded = book.ready(q), book.decode(codes)
        plain = -(ready @ decoded.T) if metric == "cosine" else ((ready[:, None] - decoded[None]) ** 2).sum(2)
        assert np.allclose(few, plain)
        assert (book.encode(book.decode(codes)) == codes).all() or metric == "cosine"


def test_odd_vectors_and_no_rows(spark, tmp_path):
    x = np.random.default_rng(7).normal(size=(300, 8))
    x[5] = 0
    rows = frame(spark, x).unionByName(spark.createDataFrame([("none", None, None)], "key string, vec array<float>, meta string"))
    index = pq.write(rows, f"{tmp_path}/i", lists=3)
    got = pq.knn(spark, index, rows.where("key in ('k00005', 'none', 'k00006')"), 4, rerank=300).collect()
    assert {r.query_key for r in got} == {"k00005", "k00006"} and index.codes(spark).count() == 300
    with pytest.raises(Validation):
        pq.knn(spark, index, spark.createDataFrame([("q", [1.0])], "key string, vec array<float>"), 3)
    empty = pq.write(rows.limit(0), f"{tmp_path}/e")
    assert pq.knn(spark, empty, rows, 3).count() == 0 and pq.load(spark, f"{tmp_path}/e").codes(spark).count() == 0


def test_the_query_loses_no_neighbour(spark, tmp_path):
    """Random vectors of 128 numbers, of which the 200 candidates by 16 bytes do not hold all neighbours."""
    x = np.random.default_rng(8).normal(size=(6_000, 128))
    spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    v = queries._vectors(spark, str(tmp_path))
    want = queries._near(vectors.knn_join(v, queries._queries(v), 10)).collect()
    assert len(want) == 600 and sorted(queries.vec_pq_search(spark, str(tmp_path)).collect()) == sorted(want)


def test_distances_are_rounded_as_in_the_sql(spark):
    found = spark.createDataFrame([("q", "a", 0.5369654997350257, 1), ("q", "b", 0.559998499947612, 2), ("q", "c", float("nan"), 3)], "query_key string, key string, distance double, rank int")
    got = [r.distance for r in queries._near(found).orderBy("rank").collect()]
    assert got[:2] == [0.536966, 0.559999] and np.isnan(got[2])


def test_only_queries_that_codes_leave_open_are_searched_again(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=(1, 16)) + rng.normal(size=(40, 16)) * 1e-3, rng.normal(size=(2_000, 16))])
    rows, asked = frame(spark, x), []
    monkeypatch.setattr(pq, "knn_join", lambda v, q, *a: asked.append({r.key for r in q.collect()}) or vectors.knn_join(v, q, *a))
    for metric in ("cosine", "euclidean"):
        pq.write(rows, f"{tmp_path}/{metric}", metric, lists=4, subspaces=8)
        index, own = pq.load(spark, f"{tmp_path}/{metric}"), rows.where("key like '%00'").unionByName(rows.where("key in ('k00003', 'k00030')"))
        got = pq.knn(spark, index, own, 5, rerank=10, exact=True).collect()
        want = vectors.knn_join(rows, own, 5, metric).collect()
        assert {(r.query_key, r["rank"]): r.key for r in got} == {(r.query_key, r["rank"]): r.key for r in want}
        assert asked[-1] and not asked[-1] & {"k00000", "k00003", "k00030"} and 0 < index.radius < np.inf
    with pytest.raises(Validation):
        pq.knn(spark, index, own, 5, probes=2, exact=True)


def test_bounds_are_in_bytes(spark):
    rows = frame(spark, np.ones((50, 64)))
    assert ivf.sampled(rows, 1_000, 10 * 8 * 64).shape == (10, 64)
    for k, dimension in ((1, 4096), (10, 64), (100, 1)):
        assert vectors.PART_BYTES // vectors.query_bytes(k, dimension) * dimension * 8 <= vectors.PART_BYTES
