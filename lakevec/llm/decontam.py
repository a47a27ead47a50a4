"""Operator 1: benchmark decontamination by n-gram seeds, Smith-Waterman alignment, and rarity of what was aligned.

Texts become lower-case words without punctuation. Every SEED_WORDS-gram of an item is a seed. A document and an item that share a
seed are aligned (match +1, mismatch and gap -1) in the part of the document around their seeds, unless a bound shows that no
alignment there can reach what is needed: half of the item's words and more of a short item (``needed``), or LONG_SCORE whatever
the item's length. The score is the best local alignment over that of the whole item. An item found word for word needs
no alignment: its score is 1. Words are compared as bytes, by their number in the items' vocabulary; no hash decides.

Rarity decides about what was aligned. The pass that aligns also counts the documents of every gram. What a gram has beyond the
documents aligned with an item is its background there: a gram whose background is at least STOCK_DOCUMENTS and more than
those aligned is stock for this item, all others are rare. An alignment counts if it holds RARE_SHARE of the item's rare grams, or NEARLY_ALL
of the item. So two stock phrases that make up half of a question are no copy of it, while an item that thousands of documents
hold, whole or edited alike, stays rare: those documents are its own, not background. Rarity does not choose seeds, as an
edited copy may keep any of its grams and lose all others (a test has such).

The bound keeps the alignments few: an alignment of M matches and E edits has at most E + 1 runs of matches, so at least M - 2(E + 1)
of the item's grams lie in it. With K places of the item whose gram is in the document and W places whose word is, M <= W and
the score M - E is at most (K + W + 2) / 2, and at most W. An alignment that holds no seed at all has an edit for every two matches; such
is not looked for. An alignment spans at most twice the item's words, which is how far is aligned around seeds.

The benchmark is dealt into parts of at most about MAX_BENCHMARK_BYTES of text, one pass over the documents each, and nothing but pairs
and counts is stored. The driver makes and broadcasts one part at a time (some ten times its text), and a task loads the one part
it works with.

Defined results: null texts and items have no words and match nothing; items of fewer than SEED_WORDS words match where they
stand word for word, whatever their rarity; repeated items and rows are each reported; null ids stay null; an empty table on either
side gives an empty result; other columns are ignored; documents are read whole.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakevec.llm.shared import stored, texts_of
from lakevec.llm.textkernel import as_bytes, mix64, slices

SEED_WORDS, THRESHOLD, LONG_SCORE = 3, 0.5, 25
#: What a short item needs: so many words, and so much of each.
SHORT_WORDS, SHORT_SHARE = 3, 0.4
STOCK_DOCUMENTS, RARE_SHARE, NEARLY_ALL = 10, 0.125, 0.9
MATCH, MISMATCH, GAP, REACH = 1, -1, -1, 2
MAX_BENCHMARK_BYTES = 8 << 20
#: Digests of leaking texts up to this size are broadcast to the documents.
BROADCAST_BYTES = 64 << 20
_MARKS = bytes(b if chr(b).isalnum() or b > 127 else 32 for b in range(256))
_WIDE_MARKS = re.compile(r"[^\w\x00-\x7f]+")


def normal(text: bytes) -> bytes:
    """Lower case, with everything but letters, digits and marks inside words as spaces."""
    if not text.isascii():
        text = as_bytes(_WIDE_MARKS.sub(" ", text.decode("utf-8", "replace").lower()))
    return text.lower().translate(_MARKS)


def needed(words):
    """The least score that counts, by the words of an item."""
    short = np.minimum(words, SHORT_WORDS + SHORT_SHARE * np.asarray(words))
    return np.minimum(np.maximum(THRESHOLD * np.asarray(words), short), LONG_SCORE)


class Numbered:
    """Words of a slice of texts as numbers of a vocabulary, -1 for others and after each text: ``ids``, first word and words
    of each text, and where all words of a gram are known."""

    def __init__(self, texts: list[bytes], number):
        split = [normal(t).split() for t in texts]
        self.counts = np.fromiter(map(len, split), np.int64, len(split))
        self.first = np.cumsum(self.counts + 1) - self.counts - 1
        self.ids = np.full(int(self.counts.sum()) + len(split), -1, np.int64)
        inside = np.ones(len(self.ids), bool)
        inside[self.first + self.counts] = False
        self.ids[inside] = np.fromiter(number(chain.from_iterable(split)), np.int64, int(self.counts.sum()))
        known = self.ids >= 0
        n = max(len(known) - SEED_WORDS + 1, 0)
        self.at = np.flatnonzero(np.logical_and.reduce([known[k : k + n] for k in range(SEED_WORDS)]))


class GramIndex:
    """Sorted numbers of grams with a bit table in front, so that most words cost one look-up. The number of a gram is that of
    its first words among those of the benchmark, and of its last word; it is mixed by a bijection."""

    BITS = 22

    def __init__(self, ids: np.ndarray, at: np.ndarray, n_words: int):
        self.n_words = max(n_words, 1)
        self.pairs = None if self.n_words < 1 << 21 else np.unique(ids[at] * self.n_words + ids[at + 1])
        keys, _ = self.keys(ids, at)
        self.sorted = np.unique(keys)
        self.bits = np.zeros(1 << self.BITS, bool)
        self.bits[(self.sorted >> np.uint64(64 - self.BITS)).astype(np.int64)] = True

    def keys(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The grams at words ``at`` as numbers, and the words of those that can be grams of the benchmark."""
        pair = ids[at] * self.n_words + ids[at + 1]
        if self.pairs is not None and len(at):
            place = np.minimum(np.searchsorted(self.pairs, pair), max(len(self.pairs) - 1, 0))
            hit = self.pairs[place] == pair if len(self.pairs) else np.zeros(len(at), bool)
            pair, at = place[hit], at[hit]
        with np.errstate(over="ignore"):
            return mix64((pair * self.n_words + ids[at + 2]).astype(np.uint64)), at

    def find(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words where a gram of the benchmark begins, and the number of its place in ``sorted``."""
        keys, at = self.keys(ids, at)
        hit = np.flatnonzero(self.bits[(keys >> np.uint64(64 - self.BITS)).astype(np.int64)])
        if not len(hit) or not len(self.sorted):
            return at[:0], at[:0]
        i = np.minimum(np.searchsorted(self.sorted, keys[hit]), len(self.sorted) - 1)
        same = self.sorted[i] == keys[hit]
        return at[hit][same], i[same]


def smith_waterman(item: np.ndarray, doc: np.ndarray) -> tuple[int, int]:
    """Best local alignment score and where in ``doc`` it ends. One numpy row per word of the item; a run of gaps along
    the row is a running maximum, as its cost is linear."""
    n = len(doc)
    slope = np.arange(n + 1) * -GAP
    row, best, end = np.zeros(n + 1, np.int64), 0, 0
    for word in item:
        new = np.zeros(n + 1, np.int64)
        np.maximum(row[:-1] + np.where(doc == word, MATCH, MISMATCH), row[1:] + GAP, out=new[1:])
        np.maximum(new, 0, out=new)
        row = np.maximum.accumulate(new + slope) - slope
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best, end


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each pair, one after another."""
    return np.arange(int(counts.sum())) + np.repeat(starts - (np.cumsum(counts) - counts), counts)


class Benchmark:
    """Items as numbers of words, the index of their grams, and for each gram the items that have it, once a place."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.vocabulary: dict[bytes, int] = {}
        texts = Numbered([as_bytes(t) for _, t in items], lambda words: (self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words))
        self.ids = [i for i, _ in items]
        self.words, self.first, self.counts = texts.ids.astype(np.int32), texts.first, texts.counts
        self.index = GramIndex(texts.ids, texts.at, len(self.vocabulary))
        at, gram = self.index.find(texts.ids, texts.at)
        self.gram_at = np.full(len(texts.ids), -1, np.int32)  # by word, the gram that begins there
        self.gram_at[at] = gram
        order = np.argsort(gram, kind="stable")
        self.owners = (np.searchsorted(self.first, at, "right") - 1)[order].astype(np.int32)
        self.owner_ends = np.cumsum(np.bincount(gram, minlength=len(self.index.sorted)))
        self.short = defaultdict(list)  # items too short for a seed, by their words
        for i in np.flatnonzero((self.counts > 0) & (self.counts < SEED_WORDS)).tolist():
            self.short[tuple(self._item(i).tolist())].append(i)

    def _item(self, number: int) -> np.ndarray:
        return self.words[self.first[number] : self.first[number] + self.counts[number]]

    def matches(self, texts: list[bytes], tally: np.ndarray | None = None) -> list[list[tuple[int, float, int, int, list[int]]]]:
        """For each text: (item number, score, first word, words, the item's grams there) of the items whose score is enough. ``tally``: texts of each
        gram, added to."""
        out: list[list] = [[] for _ in texts]
        w = Numbered(texts, lambda words: map(self.vocabulary.get, words, repeat(-1)))
        if self.short:
            for text, (first, n) in enumerate(zip(w.first.tolist(), w.counts.tolist())):
                out[text] += self._short(w.ids[first : first + n].tolist())
        at, gram = self.index.find(w.ids, w.at)
        if not len(at):
            return out
        present = np.zeros(len(self.vocabulary), bool)
        hit_texts, starts = np.unique(np.searchsorted(w.first, at, "right") - 1, return_index=True)
        for text, a, b in zip(hit_texts.tolist(), starts.tolist(), [*starts[1:].tolist(), len(at)]):
            first, n = int(w.first[text]), int(w.counts[text])
            words = w.ids[first : first + n]
            own = words[words >= 0]
            present[own] = True
            grams = np.unique(gram[a:b])
            if tally is not None:
                tally[grams] += 1
            for item in self._possible(grams, present):
                score, start, length = self._best(item, words, at[a:b] - first, gram[a:b])
                if score * self.counts[item] >= needed(self.counts[item]):
                    inside = gram[a:b][(at[a:b] - first >= start) & (at[a:b] - first <= start + length - SEED_WORDS)]
                    out[text].append((item, score, start, length, np.intersect1d(inside, self.grams_of(item)).tolist()))
            present[own] = False
        return out

    def grams_of(self, number: int) -> np.ndarray:
        return self.gram_at[self.first[number] : self.first[number] + max(self.counts[number] - SEED_WORDS + 1, 0)]

    def rare_enough(self, number: int, score: float, aligned: list[int], counts: dict[int, tuple[int, int]]) -> bool:
        """``counts``: by gram, the documents aligned with this item that hold it, and all documents that do."""
        if score >= NEARLY_ALL:
            return True
        stock = {g for g, (own, n) in counts.items() if n - own >= STOCK_DOCUMENTS and n - own > own}
        rare = set(self.grams_of(number).tolist()) - stock
        return bool(rare) and len(rare.intersection(aligned)) >= RARE_SHARE * len(rare)

    def _short(self, words: list[int]) -> list[tuple[int, float, int, int, list[int]]]:
        first: dict[tuple, int] = {}
        for n in range(1, SEED_WORDS):
            for p in range(len(words) - n + 1):
                run = tuple(words[p : p + n])
                if run in self.short:
                    first.setdefault(run, p)
        return [(item, 1.0, p, len(run), []) for run, p in first.items() for item in self.short[run]]

    def _possible(self, gram: np.ndarray, present: np.ndarray) -> list[int]:
        """The items with one of the grams whose bound in the whole text is enough."""
        ends = self.owner_ends[gram]
        begins = np.where(gram > 0, self.owner_ends[gram - 1], 0)
        items, k = np.unique(self.owners[ranges(begins, ends - begins)], return_counts=True)
        counts = self.counts[items]
        shared = present[self.words[ranges(self.first[items], counts)]]
        w = np.add.reduceat(shared, np.cumsum(counts) - counts, dtype=np.int64)
        return items[np.minimum(w, (k + w + 2) / 2) >= needed(counts)].tolist()

    def _best(self, number: int, doc: np.ndarray, at: np.ndarray, gram: np.ndarray) -> tuple[float, int, int]:
        """``at`` and ``gram``: the words of the document where a gram of the benchmark begins, and which."""
        item = self._item(number)
        m = len(item)
        own = self.grams_of(number)
        for start in at[gram == own[0]].tolist():
            if start + m <= len(doc) and (doc[start : start + m] == item).all():
                return 1.0, start, m
        hit = np.isin(gram, own)
        at, gram = at[hit], gram[hit]
        reach, regions = REACH * m, []
        for p in at.tolist():
            if regions and p - reach <= regions[-1][1]:
                regions[-1][1] = p + reach
            else:
                regions.append([max(0, p - reach), p + reach])
        best, least = (0.0, 0, 0), needed(m)
        for a, b in regions:
            k = int(np.isin(own, gram[np.searchsorted(at, a) : np.searchsorted(at, b)]).sum())
            w = int(np.isin(item, doc[a:b]).sum())
            if min(w, (k + w + 2) / 2) < max(least, best[0] * m):
                continue
            score, end = smith_waterman(item, doc[a:b])
            if score / (MATCH * m) > best[0]:
                best = (score / (MATCH * m), max(a, a + end - m), min(m, end))
        return best


def parts_of(benchmark: DataFrame):
    """(number of the part, parts, broadcast part), made one at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    parts = -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // MAX_BENCHMARK_BYTES)
    for part in range(parts):
        rows = items.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == part).collect()  # about MAX_BENCHMARK_BYTES of text
        yield part, parts, benchmark.sparkSession.sparkContext.broadcast(Benchmark([tuple(r) for r in rows]))


_FOUND = "doc_id long, digest binary, item int, score double, first_word int, n_words int, grams array<int>, gram int, n long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("item", pa.int32()), ("score", pa.float64()), ("first_word", pa.int32()), ("n_words", pa.int32()), ("grams", pa.list_(pa.int32())), ("gram", pa.int32()), ("n", pa.int64())])
PAIRS = "digest binary, doc_id long, item_id long, score double, first_word int, n_words int"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [[]] * len(schema), schema)], schema=schema)


def aligned(docs: DataFrame, shared) -> DataFrame:
    """One pass of (doc_id, text) over a part of the benchmark, stored: the pairs whose alignment is enough, and each task's count of documents by
    gram."""

    def run(batches):
        benchmark = shared.value
        tally = np.zeros(len(benchmark.index.sorted), np.int64)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            rows = []
            for a, b in slices(texts):
                for i, found in enumerate(benchmark.matches(texts[a:b], tally), a):
                    digest = hashlib.sha256(texts[i]).digest() if found else None
                    rows += [(ids[i], digest, *pair, None, None) for pair in found]
            yield _batch(rows, _ARROW)
        grams = np.flatnonzero(tally)
        for at in range(0, len(grams), 50_000):
            part = grams[at : at + 50_000]
            none = [pa.nulls(len(part), f.type) for f in list(_ARROW)[:-2]]
            yield pa.RecordBatch.from_arrays([*none, pa.array(part, pa.int32()), pa.array(tally[part])], schema=_ARROW)

    return stored(docs.mapInArrow(run, _FOUND), "aligned")


def pairs_of(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """PAIRS: every row of ``docs`` and item whose alignment is enough and holds enough of the item's rare grams."""
    out = docs.sparkSession.createDataFrame([], PAIRS)
    types = pa.schema([("digest", pa.binary()), ("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("first_word", pa.int32()), ("n_words", pa.int32())])
    for _, _, shared in parts_of(benchmark):
        found = aligned(texts_of(docs), shared)
        pairs = found.where("item is not null").drop("gram", "n")
        total = found.where("gram is not null").groupBy("gram").agg(F.sum("n").alias("n"))
        own = pairs.select("item", F.explode("grams").alias("gram")).groupBy("item", "gram").agg(F.count("*").alias("own"))
        counts = own.join(total, "gram").groupBy("item").agg(F.collect_list(F.struct("gram", "own", "n")).alias("counts"))  # grams of one item

        def rare(batches, shared=shared):
            benchmark = shared.value
            for batch in batches:
                rows = []
                for x in batch.to_pylist():
                    known = {c["gram"]: (c["own"], c["n"]) for c in x["counts"] or []}
                    if not x["grams"] or benchmark.rare_enough(x["item"], x["score"], x["grams"], known):
                        rows.append((x["digest"], x["doc_id"], benchmark.ids[x["item"]], x["score"], x["first_word"], x["n_words"]))
                yield _batch(rows, types)

        out = out.unionByName(pairs.join(counts, "item", "left").mapInArrow(rare, PAIRS))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, first_word, n_words): every document and item whose alignment is enough."""
    return pairs_of(docs, benchmark).drop("digest")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that match no item: those whose text is none of the leaking ones, by its SHA-256."""
    leaks = stored(pairs_of(docs, benchmark).select(F.col("digest").alias("_leak")).distinct(), "leaks")
    if leaks.count() * 64 <= BROADCAST_BYTES:
        leaks = F.broadcast(leaks)
    return docs.join(leaks, F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)) == F.col("_leak"), "left_anti")


def op1_decontam(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
