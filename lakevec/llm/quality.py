"""Operator 6: text quality by nearest-neighbour voting among labelled latent-semantic vectors.

A text becomes hashed counts of byte trigrams and of shape trigrams (letters, capitals, digits and other bytes each as
one class; punctuation as itself) and the count of words that repeat the word before, weighted by tf-idf and projected on the leading singular vectors of the labelled
sample. The labelled vectors (at most MAX_LABELLED rows of DIMENSIONS numbers) are broadcast; every document's cosine
with every one of them is computed in blocks, and its NEIGHBOURS nearest vote, weighted by similarity.

The sample is bounded: the MAX_LABELLED labelled documents with the least hash of doc_id (a documented parameter), one row
each; the score runs over all of every text.

Defined results: a document with several labels has the greatest; of rows that share a labelled doc_id the one with the least
hash of its text is learned from; an empty or null text has no direction and scores the sample's share of label 1; without labelled rows
every score is 0.5; neighbour ties go to the row first in the sample; repeated rows score alike and are kept; null
doc_ids are scored and never held out; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakevec.llm.langid import fold
from lakevec.llm.shared import texts_of
from lakevec.llm.textkernel import slices

FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3
FAMILY, DIMENSIONS, NEIGHBOURS, MAX_LABELLED, SHARPNESS = 1024, 64, 15, 4000, 8
WIDTH = 2 * FAMILY + 1
_SHAPE = np.arange(256, dtype=np.uint32)
_SHAPE[ord("a") : ord("z") + 1], _SHAPE[ord("A") : ord("Z") + 1], _SHAPE[ord("0") : ord("9") + 1], _SHAPE[128:] = ord("a"), ord("A"), ord("0"), ord("a")


def counts(texts: list[bytes]) -> np.ndarray:
    """(texts, WIDTH) counts of hashed byte trigrams, hashed shape trigrams and words that repeat the word before."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    text_of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    out = np.zeros((len(texts), WIDTH), np.float32)
    for i, t in enumerate(texts):
        words = t.split()
        out[i, -1] = sum(map(eq, words, words[1:]))
    if len(raw) < 3:
        return out
    inside = text_of[:-2] == text_of[2:]
    for f, seen in enumerate((raw.astype(np.uint32), _SHAPE[raw])):
        code = (seen[:-2] << 16 | seen[1:-1] << 8 | seen[2:]) * np.uint32(2654435761) >> np.uint32(22)
        at = text_of[:-2][inside] * FAMILY + code[inside].astype(np.int64)
        out[:, f * FAMILY : (f + 1) * FAMILY] = np.bincount(at, minlength=len(texts) * FAMILY).reshape(-1, FAMILY)
    return out


class Model:
    """idf weights, projection, unit vectors and labels of the sample."""

    def __init__(self, sample: np.ndarray, labels: np.ndarray):
        self.labels = labels.astype(np.float64)
        self.prior = float(self.labels.mean()) if len(labels) else 0.5
        self.idf = np.log((1 + len(sample)) / (1 + (sample > 0).sum(axis=0))).astype(np.float32) + np.float32(0.1)
        weighted = self._weighted(sample)
        values, vectors = np.linalg.eigh((weighted.T @ weighted).astype(np.float64))
        self.projection = vectors[:, ::-1][:, :DIMENSIONS].astype(np.float32)
        self.vectors = self._unit(weighted @ self.projection)

    def _weighted(self, x: np.ndarray) -> np.ndarray:
        return self._unit(np.log1p(x) * self.idf)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12).astype(np.float32)

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.prior)
        k = min(NEIGHBOURS, len(self.labels))
        if not k:
            return out
        for a in range(0, len(x), 1024):  # blocks of exact cosines
            cosine = self._unit(self._weighted(x[a : a + 1024]) @ self.projection) @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0).astype(np.float64) ** SHARPNESS
            total = weight.sum(axis=1)
            out[a : a + 1024] = np.where(total > 0, (weight * self.labels[near]).sum(axis=1) / np.where(total > 0, total, 1), self.prior)
        return np.clip(out, 0, 1)


def resolved_labels(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, y): one label for each document, the greatest of those it has."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull())
    return known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(column).cast("int")).alias("y"))


def sampled_labels(known: DataFrame, limit: int) -> list[tuple[int, int]]:
    """Up to ``limit`` rows of ``resolved_labels``, those with the least hash of doc_id."""
    return [tuple(r) for r in known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).collect()]


def labelled_texts(docs: DataFrame, rows: list[tuple[int, int]]) -> DataFrame:
    """(doc_id, text, y) of the sampled labels, one row for each document: of repeated rows the one with the least hash of its text."""
    known = docs.sparkSession.createDataFrame(rows, "known_id long, y int")
    found = texts_of(docs).join(F.broadcast(known), F.col("doc_id") == F.col("known_id"))
    return found.groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("doc_id", "text", "y")


def train(docs: DataFrame, labels: DataFrame, column: str = "quality", limit: int = MAX_LABELLED) -> Model:
    """Fit on a bounded sample of ``labels`` (doc_id, ``column``); the caller leaves out what is held out."""

    def features(batches):
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            for a, b in slices(texts):
                rows = counts(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array([r.tobytes() for r in rows], pa.binary()), batch.column(2)[a:b]], names=["doc_id", "x", "y"])

    got = labelled_texts(docs, sampled_labels(resolved_labels(labels, column), limit)).mapInArrow(features, "doc_id long, x binary, y int").collect()
    got.sort(key=lambda r: (r.doc_id, bytes(r.x)))
    x = np.stack([np.frombuffer(r.x, np.float32) for r in got]) if got else np.zeros((0, WIDTH), np.float32)
    return Model(x, np.array([r.y for r in got]))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            got = [shared.value.score(counts(texts[a:b])) for a, b in slices(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(got) if got else [], pa.float64())], names=["doc_id", "score"])

    return texts_of(docs).mapInArrow(score, "doc_id long, score double")


def op6_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels.where(fold(F.col("doc_id"), FOLDS) != HELD_OUT))
    return scored(docs, model).select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
