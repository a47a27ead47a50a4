"""Operator 11: how far the sources of a language diverge in their words, by a sorted stream of counts.

Terms are runs of letters (A-Z lower-cased, every character beyond ASCII counts as a letter). A task first counts the terms of
its own documents in a bounded table: (lang, term, source, block of documents) with document frequency and count. These rows are dealt by
(lang, term) and sorted by (lang, term, source, block); a scan over the runs adds them up, holding the sources of one term at a
time. A language keeps the terms of at least MIN_DOCUMENTS documents.

The kept runs are stored with their counts by source. With the totals of every group (lang, source), a second scan works out
smoothed shares for each term: p = 1 + floor(SCALE * (count + PRIOR) / (N + PRIOR * V)), N the group's and V the language's kept
terms. Per run it emits partial pairs and terms: to every pair of sources the amount by which |p - q| differs from what it would be if
neither held the term, and to every source the terms that it holds more of than its language. A task adds partial pairs
up in a matrix and keeps the TOP terms of each group; sums and ranks over the tasks follow. What pairs have in common when neither holds
a term is one number times V, so terms that a source lacks cost nothing. All numbers are integers without overflow or rounding.

Groups are numbered and taken in blocks of BLOCK; each pair of blocks is one scan over the kept runs, so what is broadcast
and held is bounded by BLOCK whatever the number of sources (up to BLOCK groups, one scan).

Defined results: null text, lang and source count as empty; a row is a document, also where it repeats an id or another row; a
group without terms has all pairs, and no terms; a language without kept terms has pairs of value 0; a source alone in its language has no
pairs; an empty table gives an empty result; other columns are ignored; texts are counted whole.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakevec.llm.shared import numbered, stored
from lakevec.llm.textkernel import as_bytes

MIN_DOCUMENTS, PRIOR, SCALE, TOP = 30, 5, 1_000_000_000, 50
MAX_COUNTED = 400_000  # terms of all groups in a task's table before it is emitted
BLOCK = 1_000  # groups
TEXT_BYTES = 1 << 22  # of a text counted at a time
COUNTED = "lang string, term string, source string, block long, documents long, n long"
_COUNTED = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("block", pa.int64()), ("documents", pa.int64()), ("n", pa.int64())])
RUNS = "lang string, term string, sources array<string>, counts array<long>, n long"
_RUNS = pa.schema([("lang", pa.string()), ("term", pa.string()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("n", pa.int64())])
PARTIAL = "part string, lang string, source string, item string, value long"
_PARTIAL = pa.schema([("part", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: bytes):
    """Lists of the terms of a text, one list for each TEXT_BYTES or so."""
    at = 0
    while at < len(text):
        to = min(at + TEXT_BYTES, len(text))
        part = text[at:to].translate(_LETTERS)
        while to < len(text) and part[-1:] != b" ":  # go on to the end of the term
            more = text[to : to + 4096].translate(_LETTERS)
            cut = more.find(b" ")
            part, to = part + (more if cut < 0 else more[: cut + 1]), to + (len(more) if cut < 0 else cut + 1)
        yield part.split()
        at = to


def counted(docs: DataFrame, most: int = MAX_COUNTED) -> DataFrame:
    """COUNTED rows of ``docs`` (text, lang, source), each task's documents added up in blocks."""

    def run(batches):
        table: dict[tuple, tuple[Counter, Counter]] = {}
        block, held = TaskContext.get().partitionId() << 32, 0

        def rows():
            for (lang, source), (n, documents) in table.items():
                terms = list(n)
                for at in range(0, len(terms), 20_000):
                    part = terms[at : at + 20_000]
                    columns = [pa.repeat(lang, len(part)), pa.array(part, pa.binary()).cast(pa.string()), pa.repeat(source, len(part)), pa.repeat(pa.scalar(block, pa.int64()), len(part))]
                    columns += [pa.array(list(map(of.__getitem__, part)), pa.int64()) for of in (documents, n)]
                    yield pa.RecordBatch.from_arrays(columns, schema=_COUNTED)

        for batch in batches:
            for text, lang, source in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                n, documents = table.setdefault((lang, source), (Counter(), Counter()))
                own, before = set(), len(n)
                for terms in terms_of(text):
                    n.update(terms)
                    own.update(terms)
                documents.update(own)
                held += len(n) - before
                if held > most:
                    yield from rows()
                    table, block, held = {}, block + 1, 0
        yield from rows()

    return docs.mapInArrow(run, COUNTED)


def _starts(columns: list[pa.Array]) -> np.ndarray:
    """Where the values of sorted columns change, 0 included."""
    n = len(columns[0])
    new = np.ones(n, bool)
    if n > 1:
        new[1:] = np.logical_or.reduce([pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False) for c in columns])
    return np.flatnonzero(new)


def kept_runs(rows: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """RUNS of the terms in at least ``min_documents`` documents, by a scan over sorted COUNTED rows. Of the last term of a
    batch, which may go on in the next, one row a source is carried over."""
    names = ["lang", "term", "source", "documents", "n"]

    def finished(table: pa.Table, terms: np.ndarray):
        """``table``: one row a source; ``terms``: where its terms begin."""
        if not len(terms):
            return
        keep = np.add.reduceat(table["documents"].to_numpy(), terms) >= min_documents
        sizes = np.diff([*terms, len(table)])
        n = np.add.reduceat(table["n"].to_numpy(), terms)[keep]
        heads, own = table.take(terms[keep]), table.filter(pa.array(np.repeat(keep, sizes)))
        ends = pa.array(np.cumsum([0, *sizes[keep]]), pa.int32())
        one = lambda t, c: t[c].combine_chunks()
        yield from pa.Table.from_arrays([one(heads, "lang"), one(heads, "term"), pa.ListArray.from_arrays(ends, one(own, "source")), pa.ListArray.from_arrays(ends, one(own, "n")), pa.array(n)], schema=_RUNS).to_batches(max_chunksize=2_000)

    def scan(batches):
        carried = None
        for batch in batches:
            table = pa.Table.from_batches([batch]).select(names)
            table = (table if carried is None else pa.concat_tables([carried, table])).combine_chunks()
            if not len(table):
                continue
            sources = _starts([table[c].combine_chunks() for c in names[:3]])
            added = [pa.array(np.add.reduceat(table[c].to_numpy(), sources)) for c in names[3:]]
            table = pa.Table.from_arrays([*(table[c].take(pa.array(sources)).combine_chunks() for c in names[:3]), *added], names=names)
            terms = _starts([table[c].combine_chunks() for c in names[:2]])
            yield from finished(table.slice(0, terms[-1]).combine_chunks(), terms[:-1])
            carried = table.slice(terms[-1])
        if carried is not None:
            yield from finished(carried.combine_chunks(), np.zeros(1, np.int64))

    return rows.repartition("lang", "term").sortWithinPartitions("lang", "term", "source", "block").mapInArrow(scan, RUNS)


def shares(counts: np.ndarray, n: np.ndarray, v: int) -> np.ndarray:
    """Exact: counts too large for 64 bits are worked out as Python's integers."""
    kind = np.int64 if not len(counts) or int(counts.max()) < (1 << 63) // SCALE - 2 * PRIOR else object
    return (1 + SCALE * (counts.astype(kind) + PRIOR) // (n.astype(kind) + PRIOR * v)).astype(np.int64)


class Side:
    """The groups of one block in one language: their places by source, terms, and shares of a term that they lack."""

    def __init__(self, groups: list[tuple[str, int]], v: int):
        self.place = {source: k for k, (source, _) in enumerate(groups)}
        self.n = np.array([n for _, n in groups], np.int64)
        self.zero = shares(np.zeros(len(groups), np.int64), self.n, v) if v else np.zeros(len(groups), np.int64)


class Scan:
    """What one task adds up for one language and pair of blocks."""

    def __init__(self, left: Side, right: Side | None, top: int):
        self.left, self.right, self.top = left, right, top
        if right:
            self.found = np.zeros((len(left.n), len(right.n)), np.int64)
            self.base = np.abs(left.zero[:, None] - right.zero[None, :])
            self.order = np.array([[b > a for b in right.place] for a in left.place])
        self.least = np.ones(len(left.n), np.int64)  # the excess that a further term needs
        self.best: list[list] = [[] for _ in left.n]

    def pairs(self, a: np.ndarray, p: np.ndarray, b: np.ndarray, q: np.ndarray) -> None:
        """``a``, ``p``: the groups of the left that hold a term, and their shares; ``b``, ``q``: those of the right. Where both hold it,
        the lesser source counts it."""
        other = self.right.zero.copy()
        other[b] = q
        more = np.abs(p[:, None] - other[None, :]) - self.base[a]
        more[:, b] *= self.order[a][:, b]
        self.found[a] += more

    def terms(self, term: str, a: np.ndarray, over: np.ndarray) -> None:
        for k, value in zip(a.tolist(), over.tolist()):
            held = self.best[k]
            held.append((-value, term))
            if len(held) >= 4 * self.top:
                self.cut(k)

    def cut(self, k: int) -> list:
        held = self.best[k]
        held.sort(key=lambda x: (x[0], as_bytes(x[1])))
        del held[self.top :]
        if len(held) == self.top:
            self.least[k] = max(-held[-1][0], 1)
        return held


def partials(runs: DataFrame, left: list[tuple], right: list[tuple], totals: dict[str, tuple[int, int]], with_terms: bool, top: int = TOP) -> DataFrame:
    """PARTIAL rows of a pair of blocks. ``left``, ``right``: (lang, source, n) of their groups; ``totals``: (n, v) of their languages."""
    same = left is right

    def scan(batches):
        sides = [{lang: Side([x[1:] for x in groups if x[0] == lang], totals[lang][1]) for lang in {x[0] for x in groups}} for groups in ([left] if same else [left, right])]
        scans = {lang: Scan(side, sides[-1].get(lang), top) for lang, side in sides[0].items()}

        def held(side: Side, sources: list[str], counts: np.ndarray, v: int) -> tuple[np.ndarray, np.ndarray]:
            at = np.array([side.place.get(s, -1) for s in sources])
            here = at >= 0
            at = at[here]
            return at, shares(counts[here], side.n[at], v)

        for batch in batches:
            for lang, term, sources, counts, n in zip(*(batch.column(k).to_pylist() for k in ("lang", "term", "sources", "counts", "n"))):
                own = scans.get(lang)
                if own is None:
                    continue
                total, v = totals[lang]
                counts = np.array(counts, np.int64)
                a, p = held(own.left, sources, counts, v)
                if own.right:
                    own.pairs(a, p, *((a, p) if own.right is own.left else held(own.right, sources, counts, v)))
                if with_terms:
                    over = p - shares(np.array([n], np.int64), np.array([total], np.int64), v)
                    more = over >= own.least[a]
                    own.terms(term, a[more], over[more])

        rows = []
        for lang, own in scans.items():
            if own.right:
                items = list(own.right.place)
                for source, row in zip(own.left.place, own.found):
                    rows += [("pair", lang, source, items[k], int(row[k])) for k in np.flatnonzero(row).tolist() if items[k] != source]
            for k, source in enumerate(own.left.place):
                rows += [("term", lang, source, term, -less) for less, term in own.cut(k)]
        for at in range(0, len(rows), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[at : at + 20_000]), _PARTIAL)], schema=_PARTIAL)

    return runs.mapInArrow(scan, PARTIAL)


def divergence(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank): parts ``pair`` and ``term`` of every group."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    docs = docs.select(empty("text"), empty("lang"), empty("source"))
    runs = stored(kept_runs(counted(docs), min_documents), "runs")
    held = runs.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"))
    langs = runs.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.count("*").alias("v"))
    groups = docs.select("lang", "source").distinct().join(held, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select(F.lit(0).alias("one"), "lang", "source", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n", "lang_n", "v")))
    groups = stored(numbered(groups, ["one"], ["lang", "source"], "numbered").select("index", "lang", "source", "n", "lang_n", "v"), "groups")
    blocks = -(-groups.count() // block)
    of = lambda k: [tuple(r) for r in groups.where(F.floor(F.col("index") / block) == k).orderBy("index").select("lang", "source", "n", "lang_n", "v").collect()]  # noqa: E731  at most ``block`` rows
    found = docs.sparkSession.createDataFrame([], PARTIAL)
    for a in range(blocks):
        left = of(a)
        for b in range(blocks):
            right = left if a == b else of(b)
            if b and not {x[0] for x in left} & {x[0] for x in right}:
                continue
            totals = {lang: (n, v) for lang, _, _, n, v in left + right}
            found = found.unionByName(partials(runs, [x[:3] for x in left], [x[:3] for x in right], totals, b == 0, top))
    found = stored(found, "partials")
    first, second = groups.alias("a"), groups.alias("b")
    pairs = first.join(second, F.expr("a.lang = b.lang and a.source <> b.source")).select("a.lang", F.col("a.source"), F.col("b.source").alias("item"), F.col("a.v").alias("v"), F.col("a.n").alias("n"), F.col("b.n").alias("m"))
    zero = lambda n: F.expr(f"if(v = 0, 0L, 1 + {SCALE * PRIOR}L div ({n} + {PRIOR} * v))")
    both = found.where("part = 'pair'")
    both = both.select("lang", "source", "item", "value").unionByName(both.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    both = both.groupBy("lang", "source", "item").agg(F.sum("value").alias("more"))
    pairs = pairs.join(both, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("v") * F.abs(zero("n") - zero("m")) + F.coalesce("more", F.lit(0))).alias("value"))
    result = pairs.unionByName(found.where("part = 'term'").select("lang", "source", "part", "item", "value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return result.withColumn("rank", F.row_number().over(order)).where((F.col("part") == "pair") | (F.col("rank") <= top))


def op11_divergence(spark, sf_dir: str) -> DataFrame:
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))
