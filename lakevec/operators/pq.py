"""An index of product-quantised vectors: short codes are scanned, a few candidates are ranked by their own vectors.

A vector is cut into SUBSPACES parts; a codebook has 256 centres for each part, fitted by k-means on a bounded sample (SAMPLE rows, at
most SAMPLE_BYTES of them, by the least hash of the key; both are parameters). A row's code is one byte a part, the number
of its nearest centre. Codes are stored apart from the vectors, by list (``ivf``), so a search reads a byte where the exact one
reads four numbers or more, of the lists that it probes only, or of all.

A search estimates the distance of a query to every code it reads: the sum of what its parts are from the centres. Few queries look
these up in a table of (part, centre) each; for many, a batch of codes becomes centres again and one matrix product
does the same. Each task keeps the nearest k * RERANK rows of a query, a grouped top-k merges them, and the exact distance of these
candidates decides. Every row is indexed; ``vectors.knn_join`` is the exact way.

With ``exact`` no neighbour is lost: no row that is not a candidate is nearer than the last candidate's estimate less the index's radius, the
greatest distance of a row from its centres. Queries whose k-th row is not surely nearer than that are searched again by ``vectors.knn_join``.

The index is stored once: ``codes`` (list, key, codes), ``vectors`` (key, vec, meta) in order of the key, so that the candidates of a single
query skip row groups, and ``book`` with the centres. Defined results: rows and queries without a vector are left out; a vector of another
size than the codebook's is an error; zero vectors count as such (under cosine their distance is NaN and comes last); an empty
table gives an index and results without rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakevec import names
from lakevec.errors import Validation
from lakevec.functions.distance import norm
from lakevec.operators import ivf
from lakevec.operators.vectors import NEAREST, Best, distances, knn_join, matrix
from lakevec.sources.scratch import stored

SUBSPACES, CENTRES, RERANK = 16, 256, 20
SAMPLE, SAMPLE_BYTES, ROUNDS = ivf.SAMPLE, ivf.SAMPLE_BYTES, 12
#: Of queries, their tables and their candidates that a task holds at a time.
PART_BYTES = 64 << 20
#: From so many queries on, codes become centres again once for all of them.
MANY = 16


@dataclass(frozen=True)
class Codebook:
    """``centres``: (parts, CENTRES, numbers of a part); vectors are padded with zeros to whole parts, and of unit length under cosine."""

    centres: np.ndarray
    dimension: int
    metric: str

    def ready(self, x: np.ndarray) -> np.ndarray:
        if x.shape[1] != self.dimension:
            raise Validation(f"vector must have length {self.dimension}, but has length {x.shape[1]}")
        return np.nan_to_num(_padded(ivf._ready(x, self.metric), self.centres.shape[0]))

    def encode(self, x: np.ndarray) -> np.ndarray:
        """(rows, parts) numbers of the nearest centres."""
        x = self.ready(x).reshape(len(x), *self.centres.shape[::2])
        return np.stack([_nearest(x[:, m], c) for m, c in enumerate(self.centres)], axis=1).astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([c[codes[:, m]] for m, c in enumerate(self.centres)], axis=1)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(queries, parts, CENTRES): what each centre adds to the estimate for each query."""
        q = self.ready(q).reshape(len(q), *self.centres.shape[::2])
        products = np.einsum("qmw,mcw->qmc", q, self.centres)
        if self.metric == "cosine":
            return -products
        return (q**2).sum(2)[:, :, None] - 2 * products + (self.centres**2).sum(2)

    def estimates(self, q: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """(queries, rows): numbers in the order of the estimated distances."""
        if len(q) < MANY:
            tables = self.tables(q)
            return sum(tables[:, m, codes[:, m]] for m in range(codes.shape[1]))
        q, x = self.ready(q).astype(np.float32), self.decode(codes).astype(np.float32)
        if self.metric == "cosine":
            return -(q @ x.T)
        return (q**2).sum(1)[:, None] - 2 * (q @ x.T) + (x**2).sum(1)


@dataclass(frozen=True)
class Index:
    path: str
    book: Codebook
    centroids: np.ndarray
    radius: float = float("inf")

    def codes(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("key string, codes binary, list int").parquet(f"{self.path}/codes")

    def vectors(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("key string, vec array<float>, meta string").parquet(f"{self.path}/vectors")


def _padded(x: np.ndarray, parts: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, -x.shape[1] % parts)))


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * (x @ centres.T)).argmin(axis=1)


def fit(vectors: DataFrame, metric: str = "cosine", subspaces: int = SUBSPACES, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Codebook:
    names.metric(metric)
    x = ivf.sampled(vectors, max(CENTRES, sample), sample_bytes)
    parts = max(1, min(subspaces, x.shape[1]))
    dimension, x = x.shape[1], np.nan_to_num(_padded(ivf._ready(x, metric), parts))
    width = x.shape[1] // parts
    centres = np.zeros((parts, CENTRES, width))
    for m in range(parts if len(x) else 0):
        own = x[:, m * width : (m + 1) * width]
        c = own[np.arange(CENTRES) % len(own)].copy()
        for _ in range(ROUNDS):
            at = _nearest(own, c)
            n = np.bincount(at, minlength=CENTRES)
            sums = np.stack([np.bincount(at, own[:, k], CENTRES) for k in range(width)], axis=1)
            c[n > 0] = sums[n > 0] / n[n > 0, None]
        centres[m] = c
    return Codebook(centres, dimension, metric)


def write(vectors: DataFrame, path: str, metric: str = "cosine", lists: int = 16, subspaces: int = SUBSPACES, sample: int = SAMPLE) -> Index:
    """Fit and store an index of ``vectors`` (key, vec, meta) at ``path``, a folder that does not exist yet."""
    spark = vectors.sparkSession
    rows = vectors.where("vec is not null").select("key", F.col("vec").cast("array<float>").alias("vec"), "meta")
    rows.repartitionByRange("key").sortWithinPartitions("key").write.option("parquet.bloom.filter.enabled#key", "true").parquet(f"{path}/vectors")
    rows = spark.read.schema(rows.schema).parquet(f"{path}/vectors")
    book, centroids = fit(rows, metric, subspaces, sample), ivf.fit(rows, lists, metric, sample)
    shared = spark.sparkContext.broadcast((book, centroids))

    def coded(batches):
        book, centroids = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("vec"), book.dimension)
            at = distances(np.nan_to_num(ivf._ready(x, book.metric)), centroids, "euclidean").argmin(axis=1)
            codes = book.encode(x)
            radius = np.linalg.norm(book.ready(x) - book.decode(codes), axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(at, pa.int32()), pa.array(radius)], names=["key", "codes", "list", "radius"])

    rows.select("key", "vec").mapInArrow(coded, "key string, codes binary, list int, radius double").repartition("list", F.pmod(F.xxhash64("key"), F.lit(8))).write.partitionBy("list").parquet(f"{path}/codes")
    radius = spark.read.schema("radius double").parquet(f"{path}/codes").agg(F.coalesce(F.max("radius"), F.lit(0.0))).first()[0]
    kept = [("radius", 0, 0, [radius])] * len(centroids[:1]) + [("book", m, k, c.tolist()) for m, part in enumerate(book.centres) for k, c in enumerate(part)] + [("list", 0, k, c.tolist()) for k, c in enumerate(centroids)]
    book_rows = spark.createDataFrame(kept or [("list", -1, -1, [])], "kind string, part int, number int, centre array<double>")
    book_rows.select("*", F.lit(book.dimension).alias("dimension"), F.lit(metric).alias("metric")).coalesce(1).write.parquet(f"{path}/book")
    return Index(path, book, centroids, radius)


def load(spark: SparkSession, path: str) -> Index:
    rows = spark.read.parquet(f"{path}/book").orderBy("kind", "part", "number").collect()  # the centres: a bounded table
    book, lists = [r for r in rows if r.kind == "book"], [r.centre for r in rows if r.kind == "list" and r.number >= 0]
    centres = np.array([r.centre for r in book], np.float64).reshape(len(book) // CENTRES, CENTRES, len(book[0].centre))
    radius = max((r.centre[0] for r in rows if r.kind == "radius"), default=float("inf"))
    return Index(path, Codebook(centres, rows[0].dimension, rows[0].metric), np.array(lists, np.float64).reshape(len(lists), rows[0].dimension), radius)


def probed(index: Index, q: np.ndarray, probes: int) -> np.ndarray:
    """(queries, probes) numbers of the nearest lists."""
    return np.argsort(distances(np.nan_to_num(ivf._ready(q, index.book.metric)), index.centroids, "euclidean"), axis=1, kind="stable")[:, :probes]


def candidates(index: Index, keys: list[str], q: np.ndarray, n: int, probes: int | None, spark: SparkSession) -> DataFrame:
    """(query_key, key, distance): the ``n`` nearest rows of each query by estimated distance."""
    rows, near = index.codes(spark), None
    if probes is not None and probes < len(index.centroids):
        near = probed(index, q, probes)
        rows = rows.where(F.col("list").isin(np.unique(near).tolist()))
    shared = spark.sparkContext.broadcast((keys, q, near, index.book))

    def scan(batches):
        keys, q, near, book = shared.value
        best, everyone = Best(len(keys), n), np.arange(len(keys))
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            own = batch.column("key").to_numpy(zero_copy_only=False)
            meetings = [(everyone, slice(None))]
            if near is not None:
                lists = batch.column("list").to_numpy()
                meetings = [(np.flatnonzero((near == c).any(axis=1)), lists == c) for c in np.unique(lists)]
            for queries, at in meetings:
                for k in range(0, len(queries), 512):
                    part = queries[k : k + 512]
                    best.add(part, book.estimates(q[part], codes[at]).astype(np.float64), own[at])
        there = np.arange(n) < best.held[:, None]
        row, _ = np.nonzero(there)
        out = [pa.array([keys[r] for r in row], pa.string()), pa.array(best.keys[there].tolist(), pa.string()), pa.array(best.exact[there], pa.float64())]
        yield pa.RecordBatch.from_arrays(out, names=["query_key", "key", "distance"])

    found = rows.mapInArrow(scan, NEAREST)
    order = Window.partitionBy("query_key").orderBy("distance", "key")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("query_key", "key", "distance")


def knn(spark: SparkSession, index: Index, queries: DataFrame, k: int, probes: int | None = None, rerank: int = RERANK, exact: bool = False) -> DataFrame:
    """(query_key, key, distance, rank): the k nearest rows of each query (key, vec) among its k * ``rerank`` candidates, by exact distance
    to 9 digits and key. ``probes``: lists that are read for a query, all without it. ``exact``: the k nearest of all rows.

    Queries are dealt by hash into parts of at most about PART_BYTES with their tables and candidates. A part's candidates are stored, and
    broadcast to the vectors: that side is bounded, and no vector is shuffled.
    """
    names.top_k(k)
    if exact and probes is not None:
        raise Validation("an exact search reads all lists")
    known, book, n = queries.where("vec is not null").select("key", F.col("vec").cast("array<float>").alias("vec")), index.book, k * rerank
    each = book.centres.shape[0] * CENTRES * 8 + n * 64 + book.dimension * 16
    parts = -(-known.count() * each // PART_BYTES) if book.dimension else 0
    out, edges = spark.createDataFrame([], NEAREST), spark.createDataFrame([], "query_key string, candidates long, edge double")
    for part in range(parts):
        own = known.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == part).toArrow()  # about PART_BYTES / each rows
        if not own.num_rows:
            continue
        keys, q = own.column("key").to_pylist(), matrix(own.column("vec").combine_chunks(), book.dimension)
        near = stored(candidates(index, keys, q, n, probes, spark), "candidates")
        rows = index.vectors(spark).select(F.col("key").alias("row_key"), "vec")
        if own.num_rows == 1:  # few enough to skip row groups by
            rows = rows.where(F.col("row_key").isin([r.key for r in near.select("key").collect()]))
        meet = rows.join(F.broadcast(near.select("query_key", "key")), F.col("row_key") == F.col("key")).select("query_key", "key", "vec")
        out = out.unionByName(meet.mapInArrow(_exact(spark.sparkContext.broadcast((keys, q)), book.metric), NEAREST))
        edges = edges.unionByName(near.groupBy("query_key").agg(F.count("*").alias("candidates"), F.max("distance").alias("edge")))
    order = Window.partitionBy("query_key").orderBy(F.round("distance", 9), "key")
    out = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    if not exact or not parts:
        return out
    out = stored(out, "ranked")
    again = stored(unsettled(index, known, out, edges, n), "unsettled")
    settled = out.join(again.select(F.col("key").alias("query_key")), "query_key", "left_anti")
    return settled.unionByName(knn_join(index.vectors(spark), again, k, book.metric))


def unsettled(index: Index, queries: DataFrame, ranked: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    """The ``queries`` (key, vec) a row of which that is no candidate may be among the nearest. ``ranked``: their k nearest candidates;
    ``edges`` (query_key, candidates, edge): how many candidates, ``n`` unless that is all rows, and the last one's estimate.

    Estimates are single-precision sums of products, so each may be off by that many roundings of what it is summed from.
    """
    last = ranked.groupBy("query_key").agg(F.max("distance").alias("last"))  # NaN is the greatest
    off = F.lit(float(np.finfo(np.float32).eps) * (index.book.dimension + 8))
    if index.book.metric == "cosine":
        least = 1 + F.col("edge") - 2 * off - index.radius
    else:
        least = F.sqrt(F.greatest(F.col("edge") - off * (3 * norm(F.col("vec")) ** 2 + 2 * F.abs("edge")), F.lit(0.0))) - index.radius
    sure = (F.col("candidates") < n) | (~F.isnan("last") & (F.col("last") + 1e-8 < least))
    met = queries.join(edges.join(last, "query_key").withColumnRenamed("query_key", "key"), "key", "left")
    return met.where(~F.coalesce(sure, F.lit(False))).select("key", "vec")


def _exact(shared, metric: str):
    def run(batches):
        keys, q = shared.value
        place = {key: n for n, key in enumerate(keys)}
        for batch in batches:
            if not batch.num_rows:
                continue
            own, x = q[[place[key] for key in batch.column("query_key").to_pylist()]], matrix(batch.column("vec"), q.shape[1])
            with np.errstate(divide="ignore", invalid="ignore"):
                if metric == "cosine":
                    found = 1 - (own * x).sum(1) / (np.linalg.norm(own, axis=1) * np.linalg.norm(x, axis=1))
                else:
                    found = np.sqrt(((own - x) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([batch.column("query_key"), batch.column("key"), pa.array(found, pa.float64(), from_pandas=False)], names=["query_key", "key", "distance"])

    return run
