"""An approximate index: vectors in lists around centroids, stored by list, so that a search reads a few lists only.

Centroids are fitted by k-means on a bounded sample (SAMPLE rows and SAMPLE_BYTES, by the least hash of the key; documented parameters);
every row is put into the list of its nearest centroid. A search takes the PROBES lists nearest to the query, which
Parquet partition pruning turns into a partial scan, and ranks their rows exactly. ``vectors.search`` is the exact way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakevec import names
from lakevec.functions.distance import vector_literal
from lakevec.operators.vectors import distances, knn_join, matrix, search

SAMPLE, SAMPLE_BYTES, ROUNDS, PROBES = 20_000, 64 << 20, 15, 8


def sampled(vectors: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> np.ndarray:
    """The vectors of a stable sample as a matrix: at most ``sample`` rows, and ``sample_bytes`` as the matrix has them."""
    rows = vectors.where("vec is not null")
    first = rows.select(F.size("vec").alias("n")).first()
    if first is None:
        return np.zeros((0, 0))
    most = max(1, min(sample, sample_bytes // (8 * max(first.n, 1))))
    own = rows.orderBy(F.xxhash64("key"), "key").limit(most).select(F.col("vec").cast("array<float>").alias("vec"))
    return matrix(own.toArrow().column("vec").combine_chunks(), first.n)


def fit(vectors: DataFrame, lists: int, metric: str = "cosine", sample: int = SAMPLE) -> np.ndarray:
    """(lists, dimension) centroids, of unit length for cosine."""
    names.metric(metric)
    x = _ready(sampled(vectors, sample), metric)
    centroids = x[: min(lists, len(x))].copy()
    for _ in range(ROUNDS if len(x) else 0):
        own = distances(x, centroids, "euclidean").argmin(axis=1)
        for c in range(len(centroids)):
            if (own == c).any():
                centroids[c] = x[own == c].mean(axis=0)
        centroids = _ready(centroids, metric)
    return centroids


def _ready(x: np.ndarray, metric: str) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) if metric == "cosine" and len(x) else x


def assigned(vectors: DataFrame, centroids: np.ndarray, metric: str = "cosine") -> DataFrame:
    """``vectors`` (key, vec, meta) with the number of the nearest centroid as ``list``."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vecs in batches:
            x = _ready(np.array(vecs.to_list(), dtype=np.float64).reshape(len(vecs), -1), metric)
            yield pd.Series(distances(x, shared.value, "euclidean").argmin(axis=1) if len(x) else [], dtype="int32")

    return vectors.where("vec is not null").withColumn("list", F.pandas_udf(nearest, "int")("vec"))


def write_index(vectors: DataFrame, path: str, centroids: np.ndarray, metric: str = "cosine") -> None:
    """One directory per list; rows of a list are spread over several files where it is large."""
    assigned(vectors, centroids, metric).repartition("list", F.pmod(F.xxhash64("key"), F.lit(8))).write.partitionBy("list").parquet(path)


def search_index(spark: SparkSession, path: str, centroids: np.ndarray, query: list[float], k: int, metric: str = "cosine", probes: int = PROBES, **options) -> DataFrame:
    """The k nearest rows among the lists nearest to the query: (key, distance, meta)."""
    near = np.argsort(distances(_ready(np.array([query], dtype=np.float64), metric), centroids, "euclidean")[0], kind="stable")[:probes]
    return search(spark.read.parquet(path).where(F.col("list").isin([int(c) for c in near])), vector_literal(query), k, metric, **options)


def knn_index(spark: SparkSession, path: str, centroids: np.ndarray, queries: DataFrame, k: int, metric: str = "cosine", probes: int = PROBES) -> DataFrame:
    """``knn_join`` through the index: each query (key, vec) meets the rows of its ``probes`` nearest lists only."""

    def lists(q: np.ndarray) -> np.ndarray:
        return np.argsort(distances(_ready(q, metric), centroids, "euclidean"), axis=1, kind="stable")[:, :probes]

    return knn_join(spark.read.parquet(path), queries, k, metric, lists=lists)
