"""Operator 10: toxicity by a classifier chain of linear models.

The chain predicts CATEGORIES in order, each by a logistic model:

``insult``: a toxic row with a telling word that no clean row holds. Its model sees FEATURES telling words and word beginnings.
``severe``: a toxic row whose share of such words is at or above the middle of those of all insults. Its model sees the form of the text
(length, length of words, marks, lines) and the log-odds of ``insult``.
``toxic``: the label. Its model sees the form and the log-odds of ``insult`` and ``severe``; no word reaches it but through these.

For training, the labelled rows are dealt into INNER_FOLDS by a hash of their text, copies together. Telling words are chosen, and the
first two categories' targets and probabilities worked out, for each fold from the other folds alone: nothing that a row adds to the
choice of words comes back in its own target or in the probability that a later model learns from. Scoring uses words and
models of all rows.

Features are whole words of at most WORD_BYTES bytes and the first 3, 4, 5 and 6 bytes of words (lower case, letters only),
hashed to 64 bits; the FEATURES most telling (log-likelihood ratio, more frequent in toxic rows) are kept.

The sample is bounded: at most MAX_TOXIC toxic and MAX_CLEAN clean labelled documents, those with the least hash of doc_id
(documented parameters), one row each; every word of every document is scored.

Defined results: a document labelled both ways is toxic; of rows that share a labelled doc_id the one with the least hash of its
text is learned from; null, empty or wordless texts have no words and get what the models say of none; without labelled rows
of both kinds every probability is 0; repeated rows score alike and are kept; null doc_ids are scored and never held out; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakevec.llm.langid import fold
from lakevec.llm.quality import labelled_texts, resolved_labels, sampled_labels
from lakevec.llm.shared import drop_stored, stored, texts_of
from lakevec.llm.textkernel import RunHasher, Words, slices

CATEGORIES = ("insult", "severe", "toxic")
FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.5
MAX_TOXIC, MAX_CLEAN, FEATURES, LEAST_ROWS, WORD_BYTES = 4000, 8000, 256, 3, 64
INNER_FOLDS, RIDGE, STEPS, MOST_LOG_ODDS = 5, 1.0, 25, 12.0
PREFIXES = (3, 4, 5, 6)
#: Most files of a table of the bounded sample.
SAMPLE_PARTS = 32
_NO_LETTERS = re.compile(r"[\W\d_]+")


def hashed_words(texts: list[bytes], hasher: RunHasher) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature hash and text number, for every word and each of its proper prefixes; words of each text."""
    w = Words([_NO_LETTERS.sub(" ", t.decode("utf-8", "replace").lower()).encode() for t in texts])
    prefix = hasher.prefix(w.buf)
    length = w.ends - w.starts
    short = length <= WORD_BYTES
    hashes, owners = [hasher.runs(prefix, w.starts[short], w.ends[short])], [w.text_of[short]]
    for n in PREFIXES:
        longer = length > n
        with np.errstate(over="ignore"):
            hashes.append(hasher.runs(prefix, w.starts[longer], w.starts[longer] + n) + np.uint64(n))
        owners.append(w.text_of[longer])
    return np.concatenate(hashes), np.concatenate(owners), w.counts


def forms(texts: list[bytes], n_words: np.ndarray) -> np.ndarray:
    """(texts, 4): logarithm of words, bytes a word, marks of emphasis a word, lines a word."""
    marks = np.array([t.count(b"!") + t.count(b"?") + t.count(b"*") for t in texts], np.float64)
    lines, size = (np.fromiter((f(t) for t in texts), np.float64, len(texts)) for f in (lambda t: t.count(b"\n"), len))
    many = np.maximum(n_words, 1)
    return np.stack([np.log1p(n_words), np.minimum(size / many, 20) / 10, np.minimum(marks / many, 1), np.minimum(lines / many, 1)], axis=1)


class Lookup:
    """Index of a hash among a few kept ones: a bit table first, then a binary search of what passes."""

    def __init__(self, kept: np.ndarray):
        self.kept = np.sort(kept)
        self.bits = np.zeros(1 << 16, bool)
        self.bits[(self.kept >> np.uint64(48)).astype(np.int64)] = True

    def __call__(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``hashes`` that are kept, and which kept one each is."""
        at = np.flatnonzero(self.bits[(hashes >> np.uint64(48)).astype(np.int64)])
        i = np.minimum(np.searchsorted(self.kept, hashes[at]), max(len(self.kept) - 1, 0))
        hit = self.kept[i] == hashes[at] if len(self.kept) else np.zeros(0, bool)
        return at[hit], i[hit]


def seen(texts: list[bytes], hasher: RunHasher, lookup: Lookup) -> tuple[np.ndarray, np.ndarray]:
    """(texts, features) occurrences, and (texts, 4) forms with the plain count of words before them."""
    hashes, owner, n_words = hashed_words(texts, hasher)
    at, i = lookup(hashes)
    width = max(len(lookup.kept), 1)
    out = np.bincount(owner[at] * width + i, minlength=len(texts) * width).reshape(len(texts), width)[:, : len(lookup.kept)]
    return out, np.hstack([n_words[:, None], forms(texts, n_words)])


def telling_features(sample: DataFrame, labels: list[tuple[int, int]]) -> list[list]:
    """For each inner fold left out, and last for none: (h, rows of clean) of the FEATURES most telling hashes, in any order.

    ``sample``: (doc_id, text, y, part); ``labels``: (y, part) of its rows.
    """

    def tally(batches):
        hasher = RunHasher(3)
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            group = np.array(batch.column(3).to_pylist()) * 2 + np.array(batch.column(2).to_pylist())
            for a, b in slices(texts):
                h, owner, _ = hashed_words(texts[a:b], hasher)
                order = np.lexsort((owner, h))
                h, owner = h[order], owner[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
                h, own = h[new], group[a:b][owner[new]]
                edges = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
                counts = [np.add.reduceat((own == g).astype(np.int64), edges) if len(h) else edges for g in range(2 * INNER_FOLDS)]
                yield pa.RecordBatch.from_arrays([pa.array(h[edges].view(np.int64)), *map(pa.array, counts)], names=["h", *names])

    names = [f"n{g}" for g in range(2 * INNER_FOLDS)]
    sums = sample.mapInArrow(tally, "h long, " + ", ".join(f"{n} long" for n in names)).groupBy("h").agg(*(F.sum(n).alias(n) for n in names))
    sums = stored(sums.where(sum((F.col(n) for n in names[3::2]), F.col(names[1])) >= LEAST_ROWS).coalesce(SAMPLE_PARTS), "telling-words")
    part = lambda n, of, total, all_rows: F.when(n > 0, n * F.log(n * all_rows / (of * total))).otherwise(0.0)
    out = []
    for without in [*range(INNER_FOLDS), None]:
        n_toxic, n_clean = (sum(y == v and p != without for y, p in labels) for v in (1, 0))
        t, c = (sum(F.col(names[2 * g + v]) for g in range(INNER_FOLDS) if g != without) for v in (1, 0))
        rows, rest = t + c, n_toxic + n_clean - t - c
        every = F.lit(n_toxic + n_clean)
        ratio = part(t, rows, F.lit(n_toxic), every) + part(c, rows, F.lit(n_clean), every) + part(n_toxic - t, rest, F.lit(n_toxic), every) + part(n_clean - c, rest, F.lit(n_clean), every)
        kept = sums.where((t >= LEAST_ROWS) & (t * n_clean > 3 * c * n_toxic))
        out.append(kept.orderBy(F.round(ratio, 9).desc(), "h").limit(FEATURES).select(F.lit(len(out)).alias("of"), "h", c.alias("c")))
    found = reduce(DataFrame.unionByName, out).collect()
    drop_stored(sums)
    return [[r for r in found if r.of == k] for k in range(len(out))]


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton's method; the last weight is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], RIDGE)
    ridge[-1] = 1e-6
    for _ in range(STEPS):
        p = sigmoid(x @ w)
        spread, curve = p * (1 - p) + 1e-9, np.diag(ridge)
        for k in range(0, len(x), 2048):  # blocks of rows
            curve += (x[k : k + 2048] * spread[k : k + 2048, None]).T @ x[k : k + 2048]
        step = np.linalg.solve(curve, x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def log_odds(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.clip(np.log(p) - np.log1p(-p), -MOST_LOG_ODDS, MOST_LOG_ODDS)


def predicted(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return sigmoid(x @ w[:-1] + w[-1])


def apart(x: Callable[[int], np.ndarray], y: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Out-of-fold probabilities: those of the rows of fold f by a model of the other rows over the features x(f)."""
    out = np.zeros(len(y))
    for f in np.unique(part).tolist():
        own = x(f)
        out[part == f] = predicted(own[part == f], logistic(own[part != f], y[part != f]))
    return out


class Chain:
    """The three models. ``words``: for a fold left out, or None for none, the presence of its words (rows, features); ``hits``: for each
    fold left out how often a row has words of no clean row; ``form``: number of words, then the form."""

    def __init__(self, words: Callable[[int | None], np.ndarray], hits: list[np.ndarray], form: np.ndarray, toxic: np.ndarray, part: np.ndarray):
        own = np.zeros(len(toxic))  # share of words that are insults, by the words of the other folds
        for f in range(INNER_FOLDS):
            own[part == f] = hits[f][part == f] / np.maximum(form[part == f, 0], 1)
        insult = toxic * (own > 0)
        middle = np.median(own[insult > 0]) if insult.any() else 0.0
        severe = insult * (own >= middle)
        form = form[:, 1:]
        second = np.hstack([form, log_odds(apart(words, insult, part))[:, None]])
        third = np.hstack([second, log_odds(apart(lambda f: second, severe, part))[:, None]])
        self.weights = [logistic(words(None), insult), logistic(second, severe), logistic(third, toxic)]

    def __call__(self, x: np.ndarray, form: np.ndarray) -> np.ndarray:
        """(rows, 3) probabilities in the order of CATEGORIES."""
        known, out = form[:, 1:], [predicted(x, self.weights[0])]
        for w in self.weights[1:]:
            known = np.hstack([known, log_odds(out[-1])[:, None]])
            out.append(predicted(known, w))
        return np.stack(out, axis=1)


def train(docs: DataFrame, labels: DataFrame) -> tuple[Lookup, Chain | None]:
    """Fit on a bounded sample of ``labels`` (doc_id, toxic); the caller leaves out what is held out."""
    known = resolved_labels(labels, "toxic")
    rows = sampled_labels(known.where("y = 1"), MAX_TOXIC) + sampled_labels(known.where("y = 0"), MAX_CLEAN)
    nothing = Lookup(np.zeros(0, np.uint64)), None
    if len({y for _, y in rows}) < 2:
        return nothing
    part = F.pmod(F.crc32(F.coalesce("text", F.lit("")).cast("binary")), F.lit(INNER_FOLDS)).cast("int")
    sample = stored(labelled_texts(docs, rows).withColumn("part", part).coalesce(SAMPLE_PARTS), "labelled-texts")
    labelled = [tuple(r) for r in sample.select("y", "part").collect()]  # one a sampled document at most
    if len({y for y, _ in labelled}) < 2:
        return nothing
    telling = telling_features(sample, labelled)
    hashes = [np.array([r.h for r in t], np.int64).view(np.uint64) for t in telling]
    lookup = Lookup(np.unique(np.concatenate(hashes)))

    def features(batches):
        hasher = RunHasher(3)
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            for a, b in slices(texts):
                found, form = seen(texts[a:b], hasher, lookup)
                sparse = [(np.flatnonzero(r).astype("<i4").tobytes(), r[r > 0].astype("<i4").tobytes()) for r in found]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], *(pa.array([s[k] for s in sparse], pa.binary()) for k in (0, 1)), pa.array([f.tobytes() for f in form], pa.binary()), batch.column(2)[a:b], batch.column(3)[a:b]], names=["doc_id", "at", "n", "form", "y", "part"])

    got = sorted(sample.mapInArrow(features, "doc_id long, at binary, n binary, form binary, y int, part int").collect())
    drop_stored(sample)
    n_rows = len(got)
    row = np.repeat(np.arange(n_rows), [len(r.at) // 4 for r in got])
    at, n = (np.frombuffer(b"".join(r[c] for r in got), "<i4") for c in ("at", "n"))
    own = [np.searchsorted(lookup.kept, h) for h in hashes]

    def words(fold: int | None) -> np.ndarray:
        """One fold's matrix at a time: the sample's rows times FEATURES numbers."""
        place = np.full(len(lookup.kept), -1)
        kept = own[-1 if fold is None else fold]
        place[kept] = np.arange(len(kept))
        there = place[at] >= 0
        out = np.zeros((n_rows, len(kept)))
        out[row[there], place[at[there]]] = 1
        return out

    hits = []
    for t, kept in zip(telling, own):
        free = np.zeros(len(lookup.kept), bool)
        free[kept[[r.c == 0 for r in t]] if t else kept] = True
        hits.append(np.bincount(row, weights=n * free[at], minlength=n_rows))
    form, y, parts = np.stack([np.frombuffer(r.form, np.float64) for r in got]), np.array([r.y for r in got], np.float64), np.array([r.part for r in got])
    del got[:]
    chain = Chain(words, hits, form, y, parts)
    order = np.argsort(hashes[-1])  # as the final look-up has them
    chain.weights[0] = np.r_[chain.weights[0][:-1][order], chain.weights[0][-1]]
    return Lookup(hashes[-1]), chain


def probabilities(texts: list[bytes], hasher: RunHasher, model: tuple[Lookup, Chain | None]) -> np.ndarray:
    """(texts, categories)."""
    lookup, chain = model
    out = [np.zeros((0, len(CATEGORIES)))]
    for a, b in slices(texts):
        if chain is None:
            out.append(np.zeros((b - a, len(CATEGORIES))))
        else:
            found, form = seen(texts[a:b], hasher, lookup)
            out.append(chain((found > 0).astype(np.float64), form))
    return np.concatenate(out)


def scored(docs: DataFrame, model: tuple[Lookup, Chain | None]) -> DataFrame:
    """(doc_id, p_insult, p_severe, p_toxic) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", *(f"p_{c}" for c in CATEGORIES)]

    def score(batches):
        hasher = RunHasher(3)
        for batch in batches:
            p = probabilities([t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()], hasher, shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p[:, k]) for k in range(len(CATEGORIES)))], names=names)

    return texts_of(docs).mapInArrow(score, "doc_id long, p_insult double, p_severe double, p_toxic double")


def without_toxic(docs: DataFrame, model: tuple[Lookup, Chain | None]) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that the last model of the chain does not call toxic."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def keep(batches):
        hasher = RunHasher(3)
        for batch in batches:
            p = probabilities([t or b"" for t in batch.column(at).cast(pa.binary()).to_pylist()], hasher, shared.value)
            yield batch.filter(pa.array(p[:, -1] < THRESHOLD))

    return docs.mapInArrow(keep, docs.schema)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels.where(fold(F.col("doc_id"), FOLDS) != HELD_OUT))
    out = scored(docs, model)
    return out.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "p_insult", "p_severe", F.col("p_toxic").alias("score"), (F.col("p_toxic") >= THRESHOLD).cast("int").alias("predicted"))
