"""Operator 7: language identification by multinomial naive Bayes over hashed character n-grams.

Each text is lower-cased, runs of non-letters become one space, and its character 1-, 2- and 3-grams are hashed into
BUCKETS. Training counts rows and grams by language over every training row: partitions pre-aggregate, and the sums are stored. They
make the priors and the log-probability matrix, which is broadcast. Scoring gathers the matrix rows of a batch's grams and adds them
up by document in numpy.

The matrix is made and broadcast in blocks of BLOCK languages (34 MB each), however many values of lang there are. A row goes through the
blocks one after another with the best language so far and the mass of all seen, so the posterior is exact; after CHAIN blocks
the rows are stored. With BLOCK languages or fewer, texts are read once for the counts and once for the scores.

Defined results: a null text or one without a letter is ``und`` with score 0, as is every text when there is nothing to
learn from; ties go to the language first in order; the score is the posterior probability of the predicted language.
Repeated rows score alike and are kept; null doc_ids are scored, never held out; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakevec.llm.shared import stored, texts_of
from lakevec.llm.textkernel import slices

BUCKET_BITS, SIZES, SMOOTHING, FOLDS, HELD_OUT = 15, (1, 2, 3), 0.5, 4, 2
BUCKETS = 1 << BUCKET_BITS
#: Languages that the driver and a task hold at once, and blocks that follow each other unstored.
BLOCK, CHAIN = 128, 4
_NO_LETTERS = re.compile(r"[\W\d_]+")


def grams(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """For each of SIZES the bucket of the gram that begins at every character of the texts, BUCKETS where it would end in the
    next text; and where each text begins."""
    clean = [f" {_NO_LETTERS.sub(' ', t.lower()).strip()} " for t in texts]
    points = np.frombuffer("".join(clean).encode("utf-32-le", "surrogatepass"), "<u4")
    ends = np.cumsum([len(c) for c in clean])
    out, code = [], np.zeros(len(points), np.uint32)
    with np.errstate(over="ignore"):
        for n in SIZES:  # each size begins where the one before ends
            ahead = np.zeros(len(points), np.uint32)
            ahead[: len(points) - n + 1] = points[n - 1 :]
            code = code * np.uint32(0x01000193) + ahead
            bucket = ((code + np.uint32(n)) * np.uint32(0x9E3779B1) >> np.uint32(32 - BUCKET_BITS)).astype(np.int32)
            for k in range(1, n):
                bucket[np.maximum(ends - k, 0)] = BUCKETS  # every text has two characters at least
            out.append(bucket)
    return out, np.r_[0, ends[:-1]]


def fold(doc_id, folds: int):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(-1))


def gram_counts(docs: DataFrame, held: int = BLOCK) -> DataFrame:
    """(lang, bucket, n) over all rows of ``docs`` (text, lang); the count of rows stands under bucket -1. A task hands on its sums
    when they are of ``held`` languages and another one comes."""

    def handed(known, sums, rows):
        for lang, k in known.items():
            at = np.flatnonzero(sums[k, :BUCKETS])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(at) + 1), pa.string()), pa.array(np.r_[-1, at].astype(np.int32)), pa.array(np.r_[rows[k], sums[k, at]])], names=["lang", "bucket", "n"])

    def count(batches):
        known: dict[str, int] = {}
        sums, rows = np.zeros((held, BUCKETS + 1), np.int64), np.zeros(held, np.int64)
        for batch in batches:
            texts = [(t or b"").decode("utf-8", "replace") for t in batch.column(0).cast(pa.binary()).to_pylist()]
            langs = batch.column(1).to_pylist()
            for a, b in slices(texts):
                buckets, starts = grams(texts[a:b])
                ends = np.r_[starts[1:], len(buckets[0])]
                by_lang: dict[str, list[int]] = {}
                for i, lang in enumerate(langs[a:b]):
                    by_lang.setdefault(lang, []).append(i)
                for lang, own in by_lang.items():
                    if lang not in known and len(known) == held:
                        yield from handed(known, sums, rows)
                        known.clear()
                        sums[:], rows[:] = 0, 0
                    k = known.setdefault(lang, len(known))
                    rows[k] += len(own)
                    of = slice(None) if len(by_lang) == 1 else np.concatenate([np.arange(starts[i], ends[i]) for i in own])
                    for bucket in buckets:
                        sums[k] += np.bincount(bucket[of], minlength=BUCKETS + 1)
        yield from handed(known, sums, rows)

    return docs.select("text", "lang").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def train(docs: DataFrame) -> tuple[list[tuple[str, int]], DataFrame]:
    """Languages in order, each with its rows, and the stored counts (lang, bucket, n). ``docs``: rows to learn from."""
    docs = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    counts = stored(gram_counts(docs), "grams")
    return sorted((r.lang, r.n) for r in counts.where("bucket = -1").collect()), counts  # a name and a number for each language


def matrix(counts: DataFrame, langs: list[tuple[str, int]], rows: int) -> np.ndarray:
    """(BUCKETS + 1, languages) of log-probabilities of a block of languages that follow each other, the last row that of the priors;
    ``rows``: those of all languages."""
    own = counts.where(F.col("lang").between(langs[0][0], langs[-1][0]) & (F.col("bucket") >= 0))
    number = F.create_map(*(F.lit(x) for n, (lang, _) in enumerate(langs) for x in (lang, n)))
    found = own.select("bucket", number[F.col("lang")].alias("k"), "n").toArrow()  # BLOCK * BUCKETS rows of 16 bytes at most
    n = np.full((BUCKETS, len(langs)), SMOOTHING)
    n[found["bucket"].to_numpy(), found["k"].to_numpy()] += found["n"].to_numpy()
    return np.vstack([np.log(n / n.sum(axis=0)), np.log(np.array([x for _, x in langs]) / rows)])


def _through(rows: DataFrame, names: list[str], weights: np.ndarray, first: bool, last: bool) -> DataFrame:
    """One block of languages: (doc_id, text, lang_pred, top, mass), the best language so far, its logarithm and the sum of all
    relative to it; of the last block (doc_id, lang_pred, score)."""
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    def score(batches):
        prior = shared.value[-1]
        weights = np.vstack([shared.value[:-1], np.zeros(len(prior))])
        for batch in batches:
            raw = batch.column(1).cast(pa.binary()).to_pylist()
            pred = [None] * len(raw) if first else batch.column(2).to_pylist()
            top, mass = (np.full(len(raw), -np.inf), np.zeros(len(raw))) if first else (batch.column(n).to_numpy().copy() for n in (3, 4))
            for a, b in slices([t or b"" for t in raw], max(20_000, 1_000_000 // len(names))):
                texts = [(t or b"").decode("utf-8", "replace") for t in raw[a:b]]
                letters = [any(map(str.isalpha, t)) for t in texts]
                if any(letters):
                    buckets, starts = grams(texts)
                    log = prior + sum(np.add.reduceat(weights[bucket], starts, axis=0) for bucket in buckets)
                    best = log.max(axis=1)
                    k = log.argmax(axis=1)
                    new = np.maximum(best, top[a:b])
                    for i in np.flatnonzero(best > top[a:b]).tolist():
                        pred[a + i] = names[k[i]]
                    mass[a:b] = mass[a:b] * np.exp(top[a:b] - new) + np.exp(log - new[:, None]).sum(axis=1)
                    top[a:b] = new
                if last:
                    for i, has in enumerate(letters, a):
                        pred[i], mass[i] = (pred[i], 1 / mass[i]) if has else ("und", 0.0)
            if last:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(mass)], names=["doc_id", "lang_pred", "score"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pred, pa.string()), pa.array(top), pa.array(mass)], names=["doc_id", "text", "lang_pred", "top", "mass"])

    return rows.mapInArrow(score, "doc_id long, lang_pred string, score double" if last else "doc_id long, text string, lang_pred string, top double, mass double")


def classify(docs: DataFrame, langs: list[tuple[str, int]], counts: DataFrame, block: int = BLOCK, chain: int = CHAIN) -> DataFrame:
    """(doc_id, lang_pred, score) of every row, by what ``train`` gave."""
    rows, total = texts_of(docs), sum(n for _, n in langs)
    if not langs:
        return rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    starts = range(0, len(langs), block)
    for k, at in enumerate(starts):
        own = langs[at : at + block]
        rows = _through(rows, [lang for lang, _ in own], matrix(counts, own, total), k == 0, k == len(starts) - 1)
        if (k + 1) % chain == 0 and k < len(starts) - 1:
            rows = stored(rows, "langid")
    return rows


def op7_langid(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(fold(F.col("doc_id"), FOLDS) != HELD_OUT))
    return classify(docs, *model).withColumn("held_out", fold(F.col("doc_id"), FOLDS) == HELD_OUT)
