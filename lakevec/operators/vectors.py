"""Keyed vectors as DataFrames (key string, vec array<float>, meta string): checks, upsert, get, list, delete, search.

An index is whatever holds those columns, as a rule a Parquet directory; every operation is a transformation, and the
caller writes its result. Orders always end with the key, so pages and results are the same on every run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakevec import names
from lakevec.errors import Validation
from lakevec.functions.distance import distance
from lakevec.functions.json_filter import compile_filter
from lakevec.sources.scratch import stored

OVERSAMPLE = 100
#: Of a part of the queries: its vectors and the k best rows of each, in the driver and in every task.
PART_BYTES, ROW_BYTES = 64 << 20, 96
#: Of the distances of a block of queries to the rows that meet it at a time, and of those rows as a matrix.
TILE_BYTES = 4 << 20
NEAREST = "query_key string, key string, distance double"


def invalid(vectors: DataFrame, dimension: int) -> DataFrame:
    """Rows that cannot be stored: a bad key, a missing or wrong-sized vector, or a number that is not finite."""
    bad_number = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    length = F.length("key")
    return vectors.where(F.col("key").isNull() | ~length.between(*names.KEY_CHARS) | F.col("vec").isNull() | (F.size("vec") != dimension) | bad_number)


def check(vectors: DataFrame, dimension: int) -> DataFrame:
    """``vectors``, or an error that names the first invalid row."""
    row = invalid(vectors, dimension).select("key", F.size("vec").alias("n")).first()
    if row is not None:
        if row.n not in (dimension, -1):
            raise Validation(f"vector must have length {dimension}, but has length {row.n}")
        raise Validation(f"invalid key or vector: {row.key!r}")
    return vectors


def upsert(current: DataFrame, changes: DataFrame, order: str | None = None) -> DataFrame:
    """``current`` with ``changes`` put over it: a changed key's row is replaced as a whole; of repeated keys in
    ``changes`` the greatest ``order`` wins (without one, any one of them). Only ``changes`` is grouped; ``current``
    passes by an anti join."""
    columns = current.columns
    last = changes
    if order is not None:
        row = F.struct(*columns)
        last = changes.groupBy("key").agg(F.max_by(row, F.struct(F.col(order), F.col("meta"))).alias("row")).select("row.*")
    else:
        last = changes.dropDuplicates(["key"]).select(*columns)
    return current.join(last.select("key"), "key", "left_anti").unionByName(last)


def get(vectors: DataFrame, keys: list[str], data: bool = False, metadata: bool = False) -> DataFrame:
    """The rows of ``keys``; those missing are left out, columns not asked for are not read."""
    if not 1 <= len(keys) <= names.MAX_BATCH:
        raise Validation(f"1 to {names.MAX_BATCH} keys")
    return vectors.where(F.col("key").isin(keys)).select("key", *(["vec"] if data else []), *(["meta"] if metadata else []))


def delete(vectors: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose key is not in ``keys`` (key); unknown keys do nothing."""
    return vectors.join(keys.select("key"), "key", "left_anti")


def page(rows: DataFrame, by: str, limit: int | None = None, after: str | None = None, prefix: str | None = None) -> DataFrame:
    """One page in order of ``by`` with a column next_token: the last value if more rows follow, else null."""
    n = names.page_size(limit)
    if prefix is not None:
        rows = rows.where(F.col(by).startswith(names.sized(prefix, "prefix", names.PREFIX_CHARS)))
    if after is not None:
        rows = rows.where(F.col(by) > after)
    probe = rows.orderBy(by).limit(n + 1)
    numbered = probe.withColumn("_n", F.row_number().over(Window.orderBy(by)))  # n + 1 rows at most
    more = F.max("_n").over(Window.partitionBy()) > n
    last = F.max(F.when(F.col("_n") <= n, F.col(by))).over(Window.partitionBy())
    return numbered.withColumn("next_token", F.when(more, last)).where(F.col("_n") <= n).drop("_n")


def search(vectors: DataFrame, query: Column, k: int, metric: str = "cosine", where: dict | str | None = None, mode: str = "oversample") -> DataFrame:
    """The k nearest rows: (key, distance, meta); NaN distances (zero vectors under cosine) come last, and rows without a
    vector are left out.

    With a filter, ``oversample`` takes the nearest k * OVERSAMPLE rows and filters those (it may return fewer than k);
    ``exact`` filters first. Each partition keeps its own top rows; only those are merged.
    """
    names.top_k(k)
    order = F.asc_nulls_last("distance"), F.col("key")
    found = vectors.select("key", distance(metric, F.col("vec"), query).alias("distance"), "meta")
    if where:
        predicate = compile_filter(where, F.col("meta"))
        if mode == "exact":
            found = found.where(predicate)
        elif mode == "oversample":
            found = found.orderBy(*order).limit(k * OVERSAMPLE).where(predicate)
        else:
            raise Validation(f"unknown mode {mode}")
    return found.orderBy(*order).limit(k).where("distance is not null")


def knn_join(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", block: int = 512, lists: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(query_key, key, distance, rank): the k nearest rows of each query (key, vec; keys are unique), by distance to 9 digits and key;
    NaN distances come last. Rows and queries without a vector are left out; one of another size is an error.

    The queries are dealt by hash into parts of about PART_BYTES with the best rows of each, one pass over ``vectors`` each. A part is broadcast, and
    every task keeps the best k rows of each of its queries while Arrow batches go by, as matrix products of ``block`` queries and
    as many rows as TILE_BYTES have room for;
    at its end it hands those on, and a grouped top-k merges the tasks'. With several parts the results of one are stored and
    its broadcast destroyed before the next is made.

    ``lists``: for a matrix of queries the numbers of the lists that each one probes; ``vectors`` then has a column list, and a row
    meets only the queries that probe its list.
    """
    names.top_k(k)
    names.metric(metric)
    spark, known = vectors.sparkSession, queries.where("vec is not null").select("key", "vec")
    n, least, most = known.agg(F.count("*"), F.min(F.size("vec")), F.max(F.size("vec"))).first()
    if least != most:
        raise Validation(f"queries have {least} to {most} numbers")
    rows = vectors.where("vec is not null").select("key", "vec", *["list"] * (lists is not None))
    parts = -(-n * query_bytes(k, most or 0) // PART_BYTES)
    found = spark.createDataFrame([], NEAREST)
    for part in range(parts):
        own = known.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == part).toArrow()  # about PART_BYTES / query_bytes rows
        if not own.num_rows:
            continue
        q = matrix(own.column("vec").combine_chunks(), most)
        shared = spark.sparkContext.broadcast((own.column("key").to_pylist(), q, None if lists is None else lists(q)))
        near = (rows if lists is None else rows.where(F.col("list").isin(np.unique(shared.value[2]).tolist()))).mapInArrow(_nearest(shared, k, metric, block), NEAREST)
        if parts > 1:
            near = stored(near, "nearest")
            shared.destroy()
        found = found.unionByName(near)
    ordered = Window.partitionBy("query_key").orderBy(F.round("distance", 9), "key")
    return found.withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") <= k)


def query_bytes(k: int, dimension: int) -> int:
    """What a query takes in a task of ``knn_join``: its numbers as they come and as a matrix, and its k best rows with their keys."""
    return 12 * dimension + ROW_BYTES * k


def matrix(vecs: pa.Array, dimension: int) -> np.ndarray:
    """Vectors of ``dimension`` numbers each, nulls among them as NaN."""
    if len(vecs) and (pc.min_max(pc.list_value_length(vecs)).as_py() != {"min": dimension, "max": dimension}):
        raise Validation(f"vector must have length {dimension}")
    return vecs.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vecs), dimension)


def distances(queries: np.ndarray, rows: np.ndarray, metric: str) -> np.ndarray:
    """(queries, rows) distances in double precision; a zero vector's cosine distance is NaN."""
    products = queries @ rows.T
    with np.errstate(divide="ignore", invalid="ignore"):
        if metric == "cosine":
            return 1 - products / (np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(rows, axis=1))
        return np.sqrt(np.maximum((queries**2).sum(1)[:, None] + (rows**2).sum(1) - 2 * products, 0))


class Best:
    """The k best rows of each query so far, in order of rounded distance (NaN last) and key."""

    def __init__(self, n: int, k: int):
        self.k, self.held = k, np.zeros(n, np.int64)
        self.rounded, self.exact, self.keys = np.full((n, k), np.inf), np.full((n, k), np.nan), np.full((n, k), None, object)

    def add(self, queries: np.ndarray, found: np.ndarray, keys: np.ndarray) -> None:
        """``found``: (queries, rows) distances; ``keys``: of the rows."""
        rounded = np.where(np.isnan(found), np.inf, np.round(found, 9))
        last = min(self.k, found.shape[1]) - 1
        edge = np.where(self.held[queries] == self.k, self.rounded[queries, -1], np.inf)
        edge = np.minimum(edge, np.partition(rounded, last, axis=1)[:, last] if last + 1 == self.k else np.inf)
        row, col = np.nonzero(rounded <= edge[:, None])
        if not len(row):
            return
        touched = np.unique(row)
        before = np.arange(self.k) < self.held[queries[touched]][:, None]
        old_row, old = np.repeat(touched, self.held[queries[touched]]), queries[touched]
        row = np.r_[row, old_row]
        near = np.r_[rounded[row[: len(col)], col], self.rounded[old][before]]
        exact = np.r_[found[row[: len(col)], col], self.exact[old][before]]
        named = np.r_[keys[col], self.keys[old][before]]
        place = {name: n for n, name in enumerate(sorted(set(named.tolist())))}
        order = np.lexsort((np.fromiter(map(place.__getitem__, named), np.int64, len(named)), near, row))
        row = row[order]
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        within = np.arange(len(row)) - np.repeat(starts, np.diff(np.r_[starts, len(row)]))
        row, within, order = row[within < self.k], within[within < self.k], order[within < self.k]
        at = queries[row], within
        self.rounded[at], self.exact[at], self.keys[at] = near[order], exact[order], named[order]
        self.held[queries[touched]] = np.bincount(row, minlength=len(queries))[touched]


def tiles(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _nearest(shared, k: int, metric: str, block: int):
    def run(batches):
        names_of, q, probed = shared.value
        best, everyone = Best(len(names_of), k), np.arange(len(names_of))
        for batch in tiles(batches, max(1, TILE_BYTES // (8 * max(block, q.shape[1], 1)))):
            x, keys = matrix(batch.column("vec"), q.shape[1]), batch.column("key").to_numpy(zero_copy_only=False)
            meetings = [(everyone, slice(None))]
            if probed is not None:
                lists = batch.column("list").to_numpy()
                meetings = [(np.flatnonzero((probed == c).any(axis=1)), lists == c) for c in np.unique(lists)]
            for queries, rows in meetings:
                for at in range(0, len(queries), block):
                    part = queries[at : at + block]
                    best.add(part, distances(q[part], x[rows], metric), keys[rows])
        for at in range(0, len(names_of), block):
            there = np.arange(k) < best.held[at : at + block][:, None]
            row, _ = np.nonzero(there)
            yield pa.RecordBatch.from_arrays([pa.array([names_of[at + r] for r in row], pa.string()), pa.array(best.keys[at : at + block][there].tolist(), pa.string()), pa.array(best.exact[at : at + block][there], pa.float64(), from_pandas=False)], names=["query_key", "key", "distance"])

    return run
