"""Operator 9: removal of repeated word windows, with a count-min prefilter.

A window is WINDOW consecutive words of one document. Equal windows hold equal words, hence the same least hash among
their runs of ANCHOR words: their anchor. Two windows that start apart have anchors that start apart, so a window is
never counted more often than its anchor. Pass 1 builds a count-min sketch of anchor starts in every partition and
merges them; an estimate is never below the count, so a window whose anchor is estimated at 1 is unique. Pass 2 groups
only the windows estimated repeated, by a cryptographic digest of all their bytes (BLAKE2b, 128 bits), as no texts that collide are known
or can be made; the grouping is pre-aggregated before its shuffle, and what it hands on are the windows that turn out to be
single, with their place. Pass 3 removes the words covered by the windows estimated repeated that are not single. The
hashes of anchors may collide at will: that only raises estimates.

The sketch has ROWS rows whose width follows the volume of text: about four cells for each anchor at any size, so the share of
single windows that pass it does not grow. Up to MAX_CELLS one bit for each cell, "counted twice or more", is broadcast: at most
ROWS * MAX_CELLS / 8 bytes (128 MiB). Beyond, the sketch is dealt over the executors: its cells, counted by task first, are rows that are
added up by cell, and each document's anchors meet the cells counted twice or more in one semi-join for each row of the sketch. An anchor
stands for some 15 windows, so that these joins move a fraction of the text.

Defined results: a null text has no words; a text shorter than a window is kept whole; kept words are joined by one
space; a repeated row repeats its windows, so they go; a null doc_id is a document like any other; an empty table gives
an empty result; other columns are left alone.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakevec.llm.shared import stored, texts_of
from lakevec.llm.textkernel import RunHasher, Words, mix64, slices, sliding_min

WINDOW, ANCHOR = 35, 12
ROWS, BLOCK, MIN_CELLS, MAX_CELLS = 2, 1 << 16, 1 << 18, 1 << 29
#: Bytes of text for each anchor, as found in prose; it sets the width of the sketch only.
BYTES_PER_ANCHOR = 64
DIGESTS = 100_000


class Windows:
    """First words of a slice's windows, their anchors' hashes, and the hash of each run that is some window's anchor.

    A run is an anchor if its hash is the least in some window that holds it. Where a run repeats inside a window each
    place of it counts, which can only raise an estimate.
    """

    def __init__(self, texts: list[bytes], hasher: RunHasher, window: int, anchor: int):
        self.words = w = Words(texts)
        self.prefix = hasher.prefix(w.buf)
        self.at = w.runs(window)
        self.anchors = self.starts = np.zeros(0, np.uint64)
        if not len(self.at):
            return
        runs, width = w.runs(anchor), window - anchor + 1
        hashes = np.full(len(w.starts), np.iinfo(np.uint64).max, np.uint64)
        hashes[runs] = hasher.runs(self.prefix, w.starts[runs], w.ends[runs + anchor - 1])
        self.anchors = sliding_min(hashes, width)[self.at]
        least = np.zeros(len(w.starts) + width - 1, np.uint64)  # of the window that begins width - 1 words earlier
        least[self.at + width - 1] = self.anchors
        self.starts = hashes[~sliding_min(~least, width) == hashes]

    def digests(self, at: np.ndarray, window: int) -> bytes:
        """The windows that begin at the words ``at``: 16 bytes each."""
        whole = memoryview(self.words.buf)
        return b"".join([blake2b(whole[s:e], digest_size=16).digest() for s, e in zip(self.words.starts[at].tolist(), self.words.ends[at + window - 1].tolist())])


def _cells(anchors: np.ndarray, row: int, cells: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix64(anchors + np.uint64((row + 1) * 0xD1342543DE82EF95 % 2**64)) & np.uint64(cells - 1)).astype(np.int64)


def sketch_cells(n_bytes: int) -> int:
    """Cells of a row: the power of two at or above four for each expected anchor, and MIN_CELLS at least."""
    return max(MIN_CELLS, 1 << (4 * n_bytes // BYTES_PER_ANCHOR).bit_length())


def repeated_cells(docs: DataFrame, cells: int, window: int = WINDOW, anchor: int = ANCHOR) -> np.ndarray:
    """Bits (ROWS, cells / 8) of the cells of the merged sketch that count 2 or more."""

    def sketch(batches):
        hasher, found = RunHasher(1), [[] for _ in range(ROWS)]

        def rows():
            for r in range(ROWS):
                cell, count = np.unique(np.concatenate(found[r]), return_counts=True)
                found[r] = []
                block, offset = cell // BLOCK, (cell % BLOCK).astype(np.uint16)
                edges = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True])
                for a, b in zip(edges[:-1], edges[1:]):
                    twice = count[a:b] > 1
                    yield r * (cells // BLOCK) + int(block[a]), offset[a:b].tobytes(), offset[a:b][twice].tobytes()

        def packed():
            got = list(zip(*rows()))
            return pa.RecordBatch.from_arrays([pa.array(got[0], pa.int32()), pa.array(got[1], pa.binary()), pa.array(got[2], pa.binary())], names=["block", "once", "twice"])

        held = 0
        for batch in batches:
            texts = batch.column(0).cast(pa.binary()).to_pylist()
            texts = [t or b"" for t in texts]
            for a, b in slices(texts):
                starts = Windows(texts[a:b], hasher, window, anchor).starts
                held += len(starts)
                for r in range(ROWS):
                    found[r].append(_cells(starts, r, cells))
            if held > 2_000_000:  # a partition's sketch goes out in parts of bounded size
                yield packed()
                held = 0
        if held:
            yield packed()

    def merge(batches):
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, once, twice in zip(*(c.to_pylist() for c in batch.columns)):
                c = counts.setdefault(block, np.zeros((2, BLOCK), bool))
                a = np.frombuffer(once, np.uint16)
                c[1, a] |= c[0, a]
                c[1, np.frombuffer(twice, np.uint16)] = True
                c[0, a] = True
        for block, c in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.packbits(c[1], bitorder="little").tobytes()], pa.binary())], names=["block", "bits"])

    parts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(sketch, "block int, once binary, twice binary")
    merged = parts.repartition(F.col("block")).mapInArrow(merge, "block int, bits binary")
    bits = np.zeros((ROWS * cells // BLOCK, BLOCK // 8), np.uint8)
    for block, part in merged.collect():  # ROWS * cells / 8 bytes in all
        bits[block] = np.frombuffer(part, np.uint8)
    return bits.reshape(ROWS, cells // 8)


def repeated_anchors(docs: DataFrame, cells: int, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(id, tag, anchor): the anchors of each document of ``docs`` (id, text, tag) whose cells are all counted twice or more, by a sketch dealt
    over the executors. Each comes once for a document and batch."""
    cell = [f"cell{r}" for r in range(ROWS)]

    def starts(batches):
        hasher = RunHasher(1)
        for batch in batches:
            texts = [t or b"" for t in batch.column(0).cast(pa.binary()).to_pylist()]
            for a, b in slices(texts):
                found = Windows(texts[a:b], hasher, window, anchor).starts
                for r in range(ROWS):
                    own, count = np.unique(_cells(found, r, cells), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), r, np.int32)), pa.array(own), pa.array(count)], names=["row", "cell", "n"])

    def asked(batches):
        hasher = RunHasher(1)
        for batch in batches:
            ids, tags = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "tag"))
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            for a, b in slices(texts):
                w = Windows(texts[a:b], hasher, window, anchor)
                text = w.words.text_of[w.at]
                new = np.ones(len(text), bool)  # runs of windows with one anchor
                new[1:] = (text[1:] != text[:-1]) | (w.anchors[1:] != w.anchors[:-1])
                own, text = w.anchors[new], text[new]
                yield pa.RecordBatch.from_arrays([pa.array(ids[a:b][text]), pa.array(tags[a:b][text]), pa.array(own.view(np.int64)), *(pa.array(_cells(own, r, cells)) for r in range(ROWS))], names=["id", "tag", "anchor", *cell])

    counted = docs.select("text").mapInArrow(starts, "row int, cell long, n long").groupBy("row", "cell").agg(F.sum("n").alias("n")).where("n > 1")
    counted = stored(counted.select("row", "cell"), "cells")
    found = docs.select("id", "tag", "text").mapInArrow(asked, f"id long, tag long, anchor long, {', '.join(f'{c} long' for c in cell)}")
    for r, c in enumerate(cell):
        found = found.join(counted.where(F.col("row") == r).select(F.col("cell").alias(c)), c, "left_semi")
    return found.select("id", "tag", "anchor")


def _estimator(bits, known: list[list[int] | None]):
    """A test of anchors: by the broadcast sketch, or by the repeated anchors ``known`` of the same documents (an estimate is the anchor's, whichever
    document has it)."""
    if bits is not None:
        return lambda anchors: _estimated_repeated(anchors, bits.value)
    own = np.array([a for x in known if x for a in x], np.int64).view(np.uint64)
    return lambda anchors: np.isin(anchors, own)


def _estimated_repeated(anchors: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """True where every row of the sketch counts the anchor twice or more."""
    out = np.ones(len(anchors), bool)
    for r in range(len(bits)):
        cell = _cells(anchors, r, bits.shape[1] * 8)
        out &= (bits[r][cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1
    return out


def single_windows(docs: DataFrame, bits, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, tag, pos): the windows estimated repeated that occur once in all documents. ``bits``: a broadcast, or None; ``docs``:
    (doc_id, text, tag, known), tag telling apart rows that share a doc_id but not a text, known the repeated anchors without ``bits``."""

    def candidates(batches):
        hasher = RunHasher(1)
        for batch in batches:
            ids, tags = (np.array(batch.column(c).fill_null(0)) for c in (0, 2))
            texts, known = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()], batch.column(3).to_pylist()
            for a, b in slices(texts):
                w = Windows(texts[a:b], hasher, window, anchor)
                at = w.at[_estimator(bits, known[a:b])(w.anchors)]
                for k in range(0, len(at), DIGESTS):  # digests are Python objects: few at a time
                    part = at[k : k + DIGESTS]
                    text, pos = w.words.text_of[part], part - w.words.first[w.words.text_of[part]]
                    digests = np.frombuffer(w.digests(part, window), "<i8").reshape(-1, 2)
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(digests[:, 0])), pa.array(np.ascontiguousarray(digests[:, 1])), pa.array(ids[a:b][text]), pa.array(tags[a:b][text]), pa.array(pos.astype(np.int32))], names=["h", "h2", "doc_id", "tag", "pos"])

    rows = docs.select("doc_id", "text", "tag", "known").mapInArrow(candidates, "h long, h2 long, doc_id long, tag long, pos int")
    alone = rows.groupBy("h", "h2").agg(F.count("*").alias("n"), *(F.min(c).alias(c) for c in ("doc_id", "tag", "pos"))).where("n = 1")  # least of one
    return alone.select("doc_id", "tag", "pos")


def repeated_words(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, rest: str | None = None) -> DataFrame:
    """(doc_id, kept string, n_words long, n_removed long) of each row; kept is null where the text is null.

    ``rest``: a column of ``docs`` that is carried along as ``carried``.
    """
    spark = docs.sparkSession
    carried = [] if rest is None else [rest]
    docs = texts_of(docs, *carried)
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = sketch_cells(n_bytes)
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("tag"), F.coalesce("doc_id", F.lit(0)).alias("id"), *(F.col(c).alias("carried") for c in carried))
    if cells <= MAX_CELLS:
        bits = spark.sparkContext.broadcast(repeated_cells(docs, cells, window, anchor))
        keyed = keyed.withColumn("known", F.lit(None).cast("array<long>"))
    else:
        bits = None
        known = repeated_anchors(keyed, cells, window, anchor).groupBy(F.col("id").alias("_id"), F.col("tag").alias("_tag")).agg(F.collect_set("anchor").alias("known"))  # of one document
        known = stored(known, "anchors")
        keyed = keyed.join(known, (F.col("id") == F.col("_id")) & (F.col("tag") == F.col("_tag")), "left").drop("_id", "_tag")
    alone = single_windows(keyed, bits, window, anchor).groupBy(F.col("doc_id").alias("id"), "tag").agg(F.collect_list("pos").alias("alone"))  # of one document
    joined = keyed.join(alone, ["id", "tag"], "left").select("doc_id", "text", "alone", "known", *["carried"] * len(carried))

    def removed(batches):
        hasher = RunHasher(1)
        for batch in batches:
            raw = batch.column(1).cast(pa.binary()).to_pylist()
            texts, alone, known = [t or b"" for t in raw], batch.column(2).to_pylist(), batch.column(3).to_pylist()
            kept, n_words, n_removed = [], [], []
            for a, b in slices(texts):
                w = Windows(texts[a:b], hasher, window, anchor)
                repeated = np.zeros(len(w.words.starts) + 1, np.int64)
                repeated[w.at[_estimator(bits, known[a:b])(w.anchors)]] = 1
                for i in range(a, b):
                    if alone[i]:
                        repeated[w.words.first[i - a] + np.array(alone[i])] = 0
                starts = np.flatnonzero(repeated)
                cover = np.zeros(len(repeated) + window, np.int64)
                cover[starts] += 1
                cover[starts + window] -= 1
                covered = np.cumsum(cover) > 0
                joined_words, firsts, ends = w.words.buf.tobytes(), w.words.starts, w.words.ends
                for i in range(a, b):
                    f, n = int(w.words.first[i - a]), int(w.words.counts[i - a])
                    stays = np.zeros(n + 2, np.int8)
                    stays[1:-1] = ~covered[f : f + n]
                    edges = (np.flatnonzero(np.diff(stays)) + f).tolist()
                    runs = [joined_words[firsts[p] : ends[q - 1]] for p, q in zip(edges[::2], edges[1::2])]
                    kept.append(None if raw[i] is None else b" ".join(runs))
                    n_words.append(n)
                    n_removed.append(n - int(stays.sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), *batch.columns[4:]], names=["doc_id", "kept", "n_words", "n_removed", *["carried"] * len(carried)])

    fields = StructType().add("doc_id", "long").add("kept", "string").add("n_words", "long").add("n_removed", "long")
    for c in carried:
        fields.add("carried", docs.schema[c].dataType)
    return joined.mapInArrow(removed, fields)


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the kept words as text and their length as n_chars; all other columns as they are, whatever their names."""
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    packed = docs.select("doc_id", "text", F.struct(*(F.col(c).alias(f"c{n}") for n, c in enumerate(rest))).alias("rest"))
    found = repeated_words(packed, rest="rest")
    fresh = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return found.select(*(fresh[c].alias(c) if c in fresh else F.col("carried")[f"c{rest.index(c)}"].alias(c) for c in docs.columns))


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    found = repeated_words(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))
