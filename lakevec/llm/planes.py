"""Operator 5: token ids in a binary file format of compressed planes, with a chunk index.

Documents are range-partitioned and sorted by doc_id and text; each partition is one shard. A shard's ids, every document followed
by the end id, are cut into chunks of CHUNK_IDS. A chunk is transposed into planes (bit planes: bit k of every id; byte
planes: byte k of every id), and each plane is compressed with zstandard apart. One row of the stored table is one chunk:
its planes, where each ends, and the index of the documents in it (doc_id, start in the shard, ids before this chunk,
ids in it). Spark's writer commits the files, so a lost executor leaves no part behind.

Reading takes chunks in any order: a document that spans chunks is put together from the CRC-32 of its parts
(crc32_combine), so no shard needs to be read as one. Shard totals (one number for each shard) give the starts.

Defined results: a null text counts as empty and holds the end id alone; null doc_ids sort first; rows that share a
doc_id are ordered by text; an empty table gives no chunk and an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakevec.llm.bpe import codec
from lakevec.llm.shared import drop_at_exit, scratch_path, texts_of

VOCABULARY, END_ID, CHUNK_IDS, LEVEL = "byte_bpe_50k.json", 2, 1 << 16, 3
#: Pieces that a codec remembers in each table: more than operator 4, for fewer CPU seconds.
REMEMBERED = 400_000
#: Rows that share a doc_id are dealt out by so much of their text, which keeps the order by text.
ORDERED_CHARS = 32
CHUNKS = "shard int, chunk int, n_ids int, plane_bits int, planes binary, plane_ends array<int>, doc_id array<long>, doc_start array<long>, before array<long>, here array<int>"
_ARROW = pa.schema([("shard", pa.int32()), ("chunk", pa.int32()), ("n_ids", pa.int32()), ("plane_bits", pa.int32()), ("planes", pa.binary()), ("plane_ends", pa.list_(pa.int32())), ("doc_id", pa.list_(pa.int64())), ("doc_start", pa.list_(pa.int64())), ("before", pa.list_(pa.int64())), ("here", pa.list_(pa.int32()))])


def to_planes(ids: np.ndarray, plane_bits: int) -> list[bytes]:
    """Planes of 1 or 8 bits, least significant first, up to the highest used."""
    used = int(ids.max(initial=0)).bit_length()
    if plane_bits == 8:
        return [(ids >> np.uint32(8 * k)).astype(np.uint8).tobytes() for k in range(-(-used // 8))]
    return [np.packbits((ids >> np.uint32(k)).astype(np.uint8) & 1).tobytes() for k in range(used)]


def from_planes(planes: list[bytes], n: int, plane_bits: int) -> np.ndarray:
    ids = np.zeros(n, np.uint32)
    for k, plane in enumerate(planes):
        raw = np.frombuffer(plane, np.uint8)
        ids |= (raw if plane_bits == 8 else np.unpackbits(raw, count=n)).astype(np.uint32) << np.uint32(k * plane_bits)
    return ids


def pack(ids: np.ndarray, plane_bits: int, level: int = LEVEL) -> tuple[bytes, list[int]]:
    press = zstandard.ZstdCompressor(level=level)
    parts = [press.compress(p) for p in to_planes(ids, plane_bits)]
    return b"".join(parts), np.cumsum([len(p) for p in parts], dtype=np.int64).tolist()


def unpack(data: bytes, ends: list[int], n: int, plane_bits: int) -> np.ndarray:
    press = zstandard.ZstdDecompressor()
    return from_planes([press.decompress(data[a:b], max_output_size=max(n, 1)) for a, b in zip([0, *ends[:-1]], ends)], n, plane_bits)


def crc32_combine(first: int, second: int, length: int) -> int:
    """CRC-32 of two runs of bytes put together, from theirs and the second's length (zlib's matrix method)."""

    def times(matrix: list[int], vector: int) -> int:
        out = k = 0
        while vector:
            if vector & 1:
                out ^= matrix[k]
            vector >>= 1
            k += 1
        return out

    if not length:
        return first
    step = [0xEDB88320, *(1 << k for k in range(31))]  # one zero bit
    for _ in range(3):  # squared to one zero byte
        step = [times(step, x) for x in step]
    while length:
        if length & 1:
            first = times(step, first)
        step = [times(step, x) for x in step]
        length >>= 1
    return first ^ second


def write_ids(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID, plane_bits: int = 8, chunk_ids: int = CHUNK_IDS) -> None:
    """Encode ``docs`` and write the chunk table at ``path``."""
    vocabulary = vocabulary or public_tokenizers.path(VOCABULARY)
    spark = docs.sparkSession
    docs = texts_of(docs)

    def shards(batches):
        c, shard = codec(vocabulary, REMEMBERED), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        held, index, size, chunk, total = [], [], 0, 0, 0

        def rows(last: bool):
            nonlocal held, index, size, chunk
            ids = np.frombuffer(b"".join(held), "<u4")
            at, done, out = 0, 0, []
            while len(ids) - at >= chunk_ids or last and at < len(ids):
                part = ids[at : at + chunk_ids]
                own, room = [], len(part)
                while room:
                    doc_id, start, before, length = index[done]
                    here = min(length, room)
                    own.append((doc_id, start, before, here))
                    index[done] = (doc_id, start, before + here, length - here)
                    done, room = done + (here == length), room - here
                data, ends = pack(part, plane_bits)
                out.append((shard, chunk, len(part), plane_bits, data, ends, *map(list, zip(*own))))
                chunk, at = chunk + 1, at + len(part)
            held, size, index = [ids[at:].tobytes()], len(ids) - at, index[done:]
            return pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(zip(*out), _ARROW)], schema=_ARROW) if out else None

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = c.encode(text or "") + end
                held.append(ids)
                index.append((doc_id, total, 0, len(ids) // 4))
                total, size = total + len(ids) // 4, size + len(ids) // 4
                if size >= 8 * chunk_ids and (got := rows(False)) is not None:
                    yield got
        if size and (got := rows(True)) is not None:
            yield got

    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    ordered = docs.repartitionByRange(n, "doc_id", F.substring("text", 1, ORDERED_CHARS)).sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(shards, CHUNKS).write.option("compression", "uncompressed").parquet(path)


def read_pieces(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document of each chunk: (shard, doc_id, doc_start, before, here, crc), crc that of its ids here."""

    def pieces(batches):
        for batch in batches:
            col = {n: batch.column(n).to_pylist() for n in batch.schema.names}
            out = {n: [] for n in ("shard", "doc_id", "doc_start", "before", "here", "crc")}
            for i, data in enumerate(col["planes"]):
                raw = unpack(data, col["plane_ends"][i], col["n_ids"][i], col["plane_bits"][i]).astype("<u4").tobytes()
                at = 0
                for n in col["here"][i]:
                    out["crc"].append(zlib.crc32(raw[at : at + 4 * n]))
                    at += 4 * n
                out["shard"] += [col["shard"][i]] * len(col["here"][i])
                for n in ("doc_id", "doc_start", "before", "here"):
                    out[n] += col[n][i]
            yield pa.RecordBatch.from_arrays([pa.array(out["shard"], pa.int32()), *(pa.array(out[n], pa.int64()) for n in ("doc_id", "doc_start", "before", "here", "crc"))], names=list(out))

    return spark.read.schema(CHUNKS).parquet(path).mapInArrow(pieces, "shard int, doc_id long, doc_start long, before long, here long, crc long")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, before, ids array<int>): the stored ids by document and chunk, for general use."""

    def parts(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                ids = unpack(row["planes"], row["plane_ends"], row["n_ids"], row["plane_bits"])
                cuts = np.cumsum(row["here"])[:-1]
                out += [(row["shard"], d, s, b, part.astype(np.int32)) for d, s, b, part in zip(row["doc_id"], row["doc_start"], row["before"], np.split(ids, cuts))]
            names = [("shard", pa.int32()), ("doc_id", pa.int64()), ("doc_start", pa.int64()), ("before", pa.int64()), ("ids", pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, (_, t) in zip(zip(*out), names)], names=[n for n, _ in names])

    return spark.read.schema(CHUNKS).parquet(path).mapInArrow(parts, "shard int, doc_id long, doc_start long, before long, ids array<int>")


def documents_in(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each stored document, from the files alone."""
    chunks = spark.read.schema(CHUNKS).parquet(path)
    sums = sorted(tuple(r) for r in chunks.groupBy("shard").agg(F.sum(F.col("n_ids").cast("long"))).collect())  # one row a shard
    bases = np.cumsum([0, *(n for _, n in sums)])[:-1].tolist()
    base = F.broadcast(spark.createDataFrame([(s, b) for (s, _), b in zip(sums, bases)], "shard int, base long"))
    found = read_pieces(spark, path)
    whole = found.groupBy("shard", "doc_start").agg(F.first("doc_id").alias("doc_id"), F.sum("here").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("before", "here", "crc"))).alias("parts"))  # parts of one document

    def combined(batches):
        for batch in batches:
            crc = []
            for parts in batch.column("parts").to_pylist():
                value = parts[0]["crc"]
                for p in parts[1:]:
                    value = crc32_combine(value, p["crc"], 4 * p["here"])
                crc.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = whole.join(base, "shard").select("doc_id", (F.col("doc_start") + F.col("base")).alias("start"), "n_tokens", "parts")
    return placed.mapInArrow(combined, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_planes(spark, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "ids")
    write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    drop_at_exit(spark, path)
    return documents_in(spark, path)
