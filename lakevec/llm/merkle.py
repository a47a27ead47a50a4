"""Operator 13: Merkle manifest of a table, built by combining children into parents as soon as they are whole.

A leaf is the SHA-256 of a row's fields. The leaves of a source, in ascending order of doc_id, form a tree of ARITY; the
roots of the sources, in order of the source (null first, then by UTF-8 bytes), form another, whose root stands for the table.

Each node knows how many leaves its tree has, so the number of children of every parent follows from the sizes. A task takes
nodes as events: a child goes into its partial parent under its own number; the parent whose children are all there becomes a
node, is emitted with their digests, and is an event for its own parent. What a task cannot finish (the children of parents
that reach into other tasks) is its frontier: at most ARITY - 1 children for each level at either end of its range. Frontiers
are shuffled by parent and combined again by the same function, until none is left: one round a level at most. Rounds
are stored, so a lost executor costs one task of one round.

A node holds its children's digests, which link parents to children in reverse: proofs go down from the root, one join for each
level, each on a table ARITY times the last; all leaves under one parent share one row of proof until the end.

Defined results: null fields are written as '-'; a null doc_id comes first and its text is never altered; rows that share a doc_id are
ordered by their leaf; equal rows are leaves of their own; a table of one row has its leaf as root; an empty table has
no root and gives an empty result; columns other than the five fields are ignored; texts are hashed whole.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakevec.llm.shared import numbered, stored

FIELDS, ARITY = ("doc_id", "source", "lang", "n_chars", "text"), 16
MAX_ROUNDS = 64
EVENTS = "tree string, size long, level int, index long, digest binary, children binary"
_EVENTS = pa.schema([("tree", pa.string()), ("size", pa.int64()), ("level", pa.int32()), ("index", pa.int64()), ("digest", pa.binary()), ("children", pa.binary())])
PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, proof array<binary>"
_PROOFS = pa.schema([("doc_id", pa.int64()), *((n, pa.string()) for n in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), ("verified", pa.bool_()), ("proof", pa.list_(pa.binary()))])
_DIGEST = 32


@dataclass
class Manifest:
    """``leaves``: (tree, doc_id, leaf, altered, index, size); ``nodes``: EVENTS of each tree of documents; ``subroots``:
    (source, digest, tree, index, size); ``top``: EVENTS of the tree of subroots; ``root``: its digest, None for no rows."""

    leaves: DataFrame
    nodes: DataFrame
    subroots: DataFrame
    top: DataFrame
    root: bytes | None


def parent_digest(children: bytes) -> bytes:
    """Digests are put together as hex text."""
    return hashlib.sha256(children.hex().encode()).digest()


def leaf_digest(*fields) -> F.Column:
    """Each field as its length in bytes, a colon and its value, or as '-' where it is null."""
    texts = [f.cast("string") for f in fields]
    return F.unhex(F.sha2(F.concat(*(F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t), F.lit(":"), t)) for t in texts)), 256))


def altered_text(doc_id, text) -> F.Column:
    """What tampering leaves of a text: A-Z as a-z where 5 divides the CRC-32 of the decimal doc_id."""
    return F.when(F.crc32(doc_id.cast("string")) % 5 == 0, F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(text)


def combine(batches):
    """Nodes as events in any order; yields the finished parents with their children, then the frontier without."""
    partial: dict[tuple, dict[int, bytes]] = {}
    sizes: dict[str, int] = {}
    rows: list[tuple] = []
    for batch in batches:
        for tree, size, level, index, digest in zip(*(batch.column(n).to_pylist() for n in ("tree", "size", "level", "index", "digest"))):
            while (width := -(-size // ARITY**level)) > 1:
                parent, number = divmod(index, ARITY)
                children = partial.setdefault((tree, level, parent), {})
                children[number] = digest
                if len(children) < min(ARITY, width - ARITY * parent):
                    sizes[tree] = size
                    break
                del partial[tree, level, parent]
                run = b"".join(children[k] for k in range(len(children)))
                level, index, digest = level + 1, parent, parent_digest(run)
                rows.append((tree, size, level, index, digest, run))
        if len(rows) >= 5_000:
            yield _batch(rows, _EVENTS)
            rows = []
    for (tree, level, parent), children in partial.items():
        rows += [(tree, sizes[tree], level, parent * ARITY + k, d, None) for k, d in children.items()]
        if len(rows) >= 5_000:
            yield _batch(rows, _EVENTS)
            rows = []
    if rows:
        yield _batch(rows, _EVENTS)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def ancestors(leaves: DataFrame) -> DataFrame:
    """``leaves``: (tree, size, index, digest). All nodes above them, each with its children, stored."""
    events, nodes = leaves.select("tree", "size", F.lit(0).alias("level"), "index", "digest"), None
    for _ in range(MAX_ROUNDS):
        done = stored(events.mapInArrow(combine, EVENTS), "merkle")
        whole = done.where("children is not null")
        nodes = whole if nodes is None else nodes.unionByName(whole)
        frontier = done.where("children is null").drop("children")
        if frontier.isEmpty():
            return nodes
        events = frontier.repartition("tree", "level", F.floor(F.col("index") / ARITY))
    raise RuntimeError("children are missing: sizes and leaves do not agree")


def is_root(size="size", level="level") -> F.Column:
    return F.col(size) <= F.pow(F.lit(ARITY), F.col(level)).cast("long")


def build(docs: DataFrame) -> Manifest:
    """The manifest of ``docs``; their texts are read once."""
    field = [F.col(n) for n in FIELDS]
    text = altered_text(F.col("doc_id"), F.col("text"))
    leaves = docs.select(
        F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), F.col("source").cast("string"))).alias("tree"),
        F.col("doc_id").cast("long"), leaf_digest(*field).alias("leaf"), leaf_digest(*field[:-1], text).alias("altered"),
    )
    leaves = numbered(leaves, ["tree"], ["doc_id", "leaf"], "leaves")
    nodes = ancestors(leaves.withColumnRenamed("leaf", "digest"))
    roots = leaves.where("size = 1").select(F.col("tree").alias("source"), F.col("leaf").alias("digest"))
    roots = roots.unionByName(nodes.where(is_root()).select(F.col("tree").alias("source"), "digest"))
    subroots = numbered(roots.withColumn("tree", F.lit("")), ["tree"], ["source"], "subroots")
    top = ancestors(subroots)
    root = top.where(is_root()).select("digest").unionByName(subroots.where("size = 1").select("digest")).first()
    return Manifest(leaves, nodes, subroots, top, bytes(root[0]) if root else None)


def _step(index: str, children: str) -> F.Column:
    """One step of a path: which child, and the digests of all children of its parent."""
    return F.struct((F.col(index) % ARITY).cast("int").alias("at"), F.col(children).alias("run"))


def lowest(nodes: DataFrame, tops: DataFrame) -> DataFrame:
    """(tree, index, children, path, subroot) of the parents of leaves. ``tops``: (tree, path, subroot) of each tree's root; a path
    has the steps from a node up to the root of all."""
    above = None
    height = nodes.agg(F.max("level")).first()[0] or 0  # a logarithm of the rows
    tops = tops.withColumnRenamed("tree", "of")
    for level in range(height, 0, -1):
        own = nodes.where(F.col("level") == level)
        now = own.where(is_root()).join(tops, F.col("tree") == F.col("of")).select("tree", "index", "children", "path", "subroot")
        if above is not None:
            above = above.select(F.col("tree").alias("of"), F.col("index").alias("parent"), F.col("children").alias("run"), "path", "subroot")
            inner = own.join(above, (F.col("tree") == F.col("of")) & (F.floor(F.col("index") / ARITY) == F.col("parent")))
            now = now.unionByName(inner.select("tree", "index", "children", F.concat(F.array(_step("index", "run")), F.col("path")).alias("path"), "subroot"))
        above = now
    return above


def proofs(manifest: Manifest) -> DataFrame:
    """PROOFS of every leaf: the siblings' digests from the leaf's up to the root's children, their digest, and the root that the altered leaf
    and these siblings lead to."""
    spark = manifest.leaves.sparkSession
    if manifest.root is None:
        return spark.createDataFrame([], PROOFS)
    none = F.array().cast("array<struct<at:int,run:binary>>")
    sources = manifest.subroots.select("source", "index", "digest", F.floor(F.col("index") / ARITY).alias("parent"))
    low = lowest(manifest.top, manifest.subroots.select("tree").limit(1).select("tree", none.alias("path"), F.lit(None).cast("binary").alias("subroot")))
    if low is None:
        tops = sources.select(F.col("source").alias("tree"), none.alias("path"), F.col("digest").alias("subroot"))
    else:
        low = low.select(F.col("index").alias("parent"), "children", "path")
        tops = sources.join(low, "parent").select(F.col("source").alias("tree"), F.concat(F.array(_step("index", "children")), F.col("path")).alias("path"), F.col("digest").alias("subroot"))
    leaf = F.struct((F.col("index") % ARITY).cast("int").alias("at"), "doc_id", "leaf", "altered")
    alone = manifest.leaves.where("size = 1").join(tops, "tree").select(F.array(leaf).alias("leaves"), F.lit(None).cast("binary").alias("children"), "path", "subroot")
    low = lowest(manifest.nodes, tops)
    if low is not None:
        runs = manifest.leaves.where("size > 1").groupBy(F.col("tree").alias("of"), F.floor(F.col("index") / ARITY).alias("parent")).agg(F.collect_list(leaf).alias("leaves"))  # ARITY at most
        alone = alone.unionByName(runs.join(low, (F.col("of") == F.col("tree")) & (F.col("parent") == F.col("index"))).select("leaves", "children", "path", "subroot"))
    root = manifest.root

    def prove(batches):
        for batch in batches:
            rows = []
            for leaves, children, path, subroot in zip(*(batch.column(n).to_pylist() for n in ("leaves", "children", "path", "subroot"))):
                above = [(s["at"], s["run"]) for s in path]
                subroot = subroot.hex()
                for x in leaves:
                    steps = above if children is None else [(x["at"], children), *above]
                    siblings = [run[k : k + _DIGEST] for at, run in steps for k in range(0, len(run), _DIGEST) if k != at * _DIGEST]
                    folded = fold(x["altered"], steps)
                    rows.append((x["doc_id"], x["leaf"].hex(), subroot, root.hex(), parent_digest(b"".join(siblings)).hex(), folded.hex(), folded == root, siblings))
                if len(rows) >= 1_000:
                    yield _batch(rows, _PROOFS)
                    rows = []
            if rows:
                yield _batch(rows, _PROOFS)

    return alone.mapInArrow(prove, PROOFS)


def fold(leaf: bytes, steps: list[tuple[int, bytes]]) -> bytes:
    """The root that ``leaf`` leads to, by (which child, digests of all children) of each level."""
    for at, run in steps:
        leaf = parent_digest(run[: at * _DIGEST] + leaf + run[(at + 1) * _DIGEST :])
    return leaf


def op13_merkle(spark, sf_dir: str) -> DataFrame:
    return proofs(build(spark.read.parquet(f"{sf_dir}/documents.parquet"))).drop("proof")
