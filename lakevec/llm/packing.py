"""Operator 12: bounded-space online packing of token ids into windows of WINDOW ids.

A task takes the documents of its partition as they come and keeps OPEN windows. A document of WINDOW ids or more fills
windows of its own; what is left of it, and every other document, goes whole into the open window that it leaves the least
room in (best fit). When it fits into none, the fullest window is emitted; the document's head goes into the room there first,
unless the head or what is left would be less than LEAST_PIECE ids. So no window is emitted with room for 2 * LEAST_PIECE ids, and no
more than OPEN windows are held, however many documents there are.

At its end a task hands on its open windows. They are merged: the windows of MERGED tasks go to one task, which packs them by the
same rule as if each were a document, until one task has the last of them and joins these into full windows. So no task sees
more than MERGED * OPEN windows, and the rounds grow with the logarithm of the tasks. The very last ids, less than a window, are
cut into windows whose sizes are powers of two, which need no padding. Each round is stored: texts are read and encoded
once, are never shuffled, and a lost executor costs one task of one round.

A stored row is one window: its ids, and its pieces (document, ids of it before the piece, ids in it, ids of the whole document).
Pieces lie in order without gaps.

Defined results: a null text counts as empty and holds the end id alone; rows that share a doc_id, and equal rows, are packed
apart; null doc_ids stay null; an empty table gives an empty result; other columns are ignored; texts are encoded whole.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict, deque
from dataclasses import dataclass, field

import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakevec.llm.bpe import codec
from lakevec.llm.shared import drop_at_exit, scratch_path, texts_of

VOCABULARY, END_ID, WINDOW = "byte_bpe_50k.json", 1, 2048
OPEN, LEAST_PIECE, MERGED = 64, 16, 64
#: Pieces that a codec remembers in each table, as in operator 5.
REMEMBERED = 400_000
WINDOWS = "task int, number long, closed boolean, n_ids int, ids binary, doc_id array<long>, start array<long>, length array<int>, doc_tokens array<long>"
_ARROW = pa.schema([
    ("task", pa.int32()), ("number", pa.int64()), ("closed", pa.bool_()), ("n_ids", pa.int32()), ("ids", pa.binary()),
    ("doc_id", pa.list_(pa.int64())), ("start", pa.list_(pa.int64())), ("length", pa.list_(pa.int32())), ("doc_tokens", pa.list_(pa.int64())),
])
_ID = 4  # bytes


@dataclass
class Unit:
    """Ids that lie in a row, with the pieces (doc_id, start, length, doc_tokens) they are made of."""

    ids: bytes = b""
    pieces: list[tuple] = field(default_factory=list)

    def __len__(self) -> int:
        return len(self.ids) // _ID

    def add(self, other: Unit) -> None:
        """Put ``other`` behind; two pieces that follow each other in one document stay two."""
        self.ids += other.ids
        self.pieces += other.pieces

    def cut(self, n: int) -> tuple[Unit, Unit]:
        """The first ``n`` ids and the rest."""
        head, tail, at = [], [], 0
        for doc_id, start, length, total in self.pieces:
            here = min(max(n - at, 0), length)
            if here:
                head.append((doc_id, start, here, total))
            if here < length:
                tail.append((doc_id, start + here, length - here, total))
            at += length
        return Unit(self.ids[: n * _ID], head), Unit(self.ids[n * _ID :], tail)


class Packer:
    """At most ``limit`` open windows; ``put`` yields the windows that it closes."""

    def __init__(self, limit: int = OPEN, window: int = WINDOW, least: int = LEAST_PIECE):
        self.limit, self.window, self.least = limit, window, least
        self.sizes: list[int] = []  # of the open windows, ascending
        self.open: dict[int, deque[Unit]] = defaultdict(deque)  # by size, the oldest first

    def _take(self, size: int) -> Unit:
        self.sizes.pop(bisect_left(self.sizes, size))
        units = self.open[size]
        unit = units.popleft()
        if not units:
            del self.open[size]
        return unit

    def _keep(self, unit: Unit):
        if len(unit) == self.window:
            yield unit
        else:
            insort(self.sizes, len(unit))
            self.open[len(unit)].append(unit)

    def put(self, unit: Unit):
        while len(unit) > self.window:
            full, unit = unit.cut(self.window)
            yield full
        if len(unit) < self.window:
            fits = bisect_left(self.sizes, self.window - len(unit) + 1)  # windows before this one have room
            if fits:
                best = self._take(self.sizes[fits - 1])
                best.add(unit)
                unit = best
            elif len(self.sizes) >= self.limit:
                fullest = self._take(self.sizes[-1])
                head = min(self.window - len(fullest), len(unit) - self.least)
                if head >= self.least:
                    head, unit = unit.cut(head)
                    fullest.add(head)
                yield fullest
        yield from self._keep(unit)

    def left(self):
        """The open windows, the fullest first."""
        for size in reversed(self.sizes):
            yield self.open[size].popleft()
        self.sizes, self.open = [], defaultdict(deque)

    def finish(self):
        """The open windows joined into full ones; what is left at the end, in powers of two."""
        rest = Unit()
        for unit in self.left():
            rest.add(unit)
            if len(rest) >= self.window:
                full, rest = rest.cut(self.window)
                yield full
        while len(rest):
            part, rest = rest.cut(1 << (len(rest).bit_length() - 1))
            yield part


def _rows(found, closed: bool, task: int, first: int, most: int = 500):
    """Batches of at most ``most`` windows, numbered from ``first``."""
    rows = []
    for number, unit in enumerate(found, first):
        rows.append((task, number, closed, len(unit), unit.ids, *map(list, zip(*unit.pieces))))
        if len(rows) == most:
            yield _batch(rows)
            rows = []
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


def _packed(units, last: bool, **sizes):
    """Windows of one task as batches: the closed ones, then the open ones, or with ``last`` none of these."""
    packer, task, closed = Packer(**sizes), TaskContext.get().partitionId(), 0

    def full():
        nonlocal closed
        for unit in units:
            for done in packer.put(unit):
                closed += 1
                yield done
        if last:
            yield from packer.finish()

    yield from _rows(full(), True, task, 0)
    yield from _rows(packer.left(), False, task, closed)


def pack(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID, window: int = WINDOW, open_windows: int = OPEN, least_piece: int = LEAST_PIECE) -> DataFrame:
    """Encode ``docs`` and write their windows below ``path``, one folder a round; returns the closed ones: (sequence_id, n_ids, ids, doc_id,
    start, length, doc_tokens), the last four as arrays with one entry for each piece."""
    vocabulary = vocabulary or public_tokenizers.path(VOCABULARY)
    spark, sizes = docs.sparkSession, {"limit": open_windows, "window": window, "least": least_piece}
    end = end_id.to_bytes(_ID, "little")

    def encode(batches):
        c = codec(vocabulary, REMEMBERED)

        def units():
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    ids = c.encode(text or "") + end
                    yield Unit(ids, [(doc_id, 0, len(ids) // _ID, len(ids) // _ID)])

        return _packed(units(), False, **sizes)

    def merge(last: bool):
        def run(batches):
            def units():
                for batch in batches:
                    names = ("ids", "doc_id", "start", "length", "doc_tokens")
                    for ids, *pieces in zip(*(batch.column(n).to_pylist() for n in names)):
                        yield Unit(ids, list(zip(*pieces)))

            return _packed(units(), last, **sizes)

        return run

    made = texts_of(docs).mapInArrow(encode, WINDOWS)
    rounds: list[DataFrame] = []
    while True:
        here = f"{path}/round={len(rounds)}"
        made.write.option("compression", "zstd").parquet(here)
        rounds.append(spark.read.schema(WINDOWS).parquet(here))
        rest = rounds[-1].where("not closed")
        tasks = rest.agg(F.max("task")).first()[0]
        if tasks is None:
            break
        groups = tasks // MERGED + 1
        dealt = rest.repartition(groups, F.floor(F.col("task") / MERGED)).sortWithinPartitions("task", "number")
        made = dealt.mapInArrow(merge(groups == 1), WINDOWS)
    done = None
    for k, table in enumerate(rounds):
        own = table.where("closed").select((F.lit(k << 58) + F.col("task").cast("long") * (1 << 36) + F.col("number")).alias("sequence_id"), "n_ids", "ids", "doc_id", "start", "length", "doc_tokens")
        done = own if done is None else done.unionByName(own)
    return done


def pieces_of(windows: DataFrame) -> DataFrame:
    """One row for each piece of stored windows: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)."""

    def run(batches):
        for batch in batches:
            out = []
            for sequence, ids, *pieces in zip(*(batch.column(n).to_pylist() for n in ("sequence_id", "ids", "doc_id", "start", "length", "doc_tokens"))):
                at = 0
                for doc_id, start, length, total in zip(*pieces):
                    out.append((doc_id, start, length, zlib.crc32(ids[at * _ID : (at + length) * _ID]), total, sequence, at))
                    at += length
            names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in list(zip(*out)) or [[]] * 7], names=names)

    return windows.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def padding(windows: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row: sequences, ids, and ids of padding (windows whose size is a power of two have none)."""
    whole = F.bit_count("n_ids") == 1
    return windows.agg(F.count("*").alias("sequences"), F.sum(F.col("n_ids").cast("long")).alias("ids"), F.sum(F.when(whole, 0).otherwise(window - F.col("n_ids"))).alias("padding"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "packed")
    windows = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    drop_at_exit(spark, path)
    return pieces_of(windows)
