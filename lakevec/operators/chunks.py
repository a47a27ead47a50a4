"""Chunking, keys, metadata and stub embeddings of parsed documents, as column expressions.

A document row has ``source`` and ``text``; chunk rows add ``chunk_idx``, ``chunk`` and, for headings, ``section_path``.
Sizes are in tokens of four characters; offsets and lengths are in characters.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakevec.errors import Validation
from lakevec.functions.sentences import unicode_sentences

CHARS_PER_TOKEN, SIZE, OVERLAP = 4, 400, 80
#: Fixed names of the standard metadata.
META_SOURCE, META_CONTENT, META_INDEX, META_HASH = "S3VECTORS-EMBED-SRC-LOCATION", "S3VECTORS-EMBED-SRC-CONTENT", "S3VECTORS-EMBED-CHUNK-IDX", "S3VECTORS-EMBED-CONTENT-HASH"
CONTENT_CHARS = 8192


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(text) / CHARS_PER_TOKEN).cast("long")


def windows(size: int, overlap: int) -> tuple[int, int]:
    """Window and step in characters."""
    if size < 1 or not 0 <= overlap < size:
        raise Validation("chunk size must be positive and the overlap smaller")
    return size * CHARS_PER_TOKEN, (size - overlap) * CHARS_PER_TOKEN


def chunk_off(docs: DataFrame) -> DataFrame:
    """The whole text as chunk 0; empty texts give none."""
    return docs.where(F.length("text") > 0).withColumn("chunk_idx", F.lit(0)).withColumn("chunk", F.col("text"))


def fixed_windows(text: str, window: int, step: int) -> list[tuple[int, str]]:
    """``chunk_fixed`` of one text, for table functions."""
    last = max(0, -(-(len(text) - window) // step))
    cut = ((i, text[i * step : i * step + window].strip(" ")) for i in range(last + 1))
    return [(i, piece) for i, piece in cut if piece]


def chunk_fixed(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, back_off: int = 0) -> DataFrame:
    """Windows of ``size`` tokens every ``size - overlap``, trimmed, blank ones left out; the last reaches the end.

    ``back_off``: a window that would end inside a word ends before it, if that is at most so many characters back. No text
    is lost, as it is never more than the overlap.
    """
    window, step = windows(size, overlap)
    last = F.greatest(F.ceil((F.length("text") - window) / step), F.lit(0)).cast("int")
    placed = docs.where(F.length("text") > 0).withColumn("chunk_idx", F.explode(F.sequence(F.lit(0), last)))
    piece = F.substring(F.col("text"), F.col("chunk_idx") * step + 1, F.lit(window))
    if back := min(back_off, window - step):
        after = F.substring(F.col("text"), F.col("chunk_idx") * step + 1 + window, F.lit(1))
        whole = F.regexp_extract(piece, rf"(?s)^(.*\s)\S{{1,{back}}}\z", 1)
        piece = F.when(after.rlike(r"\S") & (whole != ""), whole).otherwise(piece)
    return placed.withColumn("chunk", F.trim(piece)).where("chunk != ''")


_SENTENCE_END = re.compile(r"(?<=[.!?])[ \t\n\x0B\f\r]+")


def packed_sentences(text: str, limit: int) -> list[str]:
    """Sentences joined by a space while they fit ``limit`` characters; longer ones are cut."""
    out, held, length = [], [], 0
    for sentence in _SENTENCE_END.split(text):
        sentence = sentence.strip(" ")
        for at in range(0, len(sentence), limit):
            piece = sentence[at : at + limit].strip(" ")
            if not piece:
                continue
            if held and length + 1 + len(piece) > limit:
                out.append(" ".join(held))
                held, length = [], 0
            length += len(piece) + (1 if held else 0)
            held.append(piece)
    return [*out, " ".join(held)] if held else out


def chunk_sentence(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """Sentences (split after . ! ? and white space) packed while they fit ``size`` tokens; longer ones are cut. The packing is one loop
    over a text, which no built-in function has in linear time; texts go to it in Arrow batches."""
    limit = size * CHARS_PER_TOKEN

    def pack(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: packed_sentences(t or "", limit))

    packed = F.pandas_udf(pack, "array<string>")
    return docs.where(F.length("text") > 0).select("*", F.posexplode(packed("text")).alias("chunk_idx", "chunk"))


def packed_whole(sentences: list[str], limit: int) -> list[str]:
    """Sentences put together as they stand while they fit ``limit`` characters, trimmed; a longer one is cut, its pieces stand alone."""
    out, held, length = [], [], 0
    for sentence in sentences:
        if held and length + len(sentence) > limit:
            out.append("".join(held))
            held, length = [], 0
        if len(sentence) > limit:
            out += [sentence[at : at + limit] for at in range(0, len(sentence), limit)]
        else:
            held.append(sentence)
            length += len(sentence)
    return [piece for piece in (c.strip() for c in [*out, "".join(held)]) if piece]


def chunk_unicode_sentence(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """Sentences of any script (``functions.sentences``) packed while they fit ``size`` tokens; those without a letter or a digit are left
    out. Null and empty texts give no chunk."""
    limit = size * CHARS_PER_TOKEN

    def pack(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: packed_whole(unicode_sentences(t or ""), limit))

    packed = F.pandas_udf(pack, "array<string>")
    return docs.where(F.length("text") > 0).select("*", F.posexplode(packed("text")).alias("chunk_idx", "chunk"))


def headings(text: str) -> list[tuple[int, int, str]]:
    """(start, level, title) of the ATX and Setext headings outside code fences."""
    out, at, fence, above = [], 0, "", None
    for line in text.split("\n"):
        bare = line.strip()
        mark = bare[:3] if bare[:3] in ("```", "~~~") else ""
        if fence:
            fence = "" if mark == fence else fence
            above = None
        elif mark:
            fence, above = mark, None
        else:
            level = len(bare) - len(bare.lstrip("#"))
            if 1 <= level <= 6 and (len(bare) == level or bare[level] in " \t"):
                out.append((at, level, bare[level:].strip().rstrip("#").strip()))
                above = None
            elif above and bare and (set(bare) == {"="} or set(bare) == {"-"}):
                out.append((above[0], 1 if bare[0] == "=" else 2, above[1]))
                above = None
            else:
                above = (at, bare) if bare else None
        at += len(line) + 1
    return out


def md_sections(docs: DataFrame) -> DataFrame:
    """(…, start, level, title): one row per heading of the Markdown in ``text``."""

    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: [{"start": s, "level": n, "title": x} for s, n, x in headings(t or "")])

    sections = F.pandas_udf(find, "array<struct<start:int,level:int,title:string>>")
    return docs.select("*", F.explode(sections("text")).alias("h")).select("*", "h.start", "h.level", "h.title").drop("h")


def markdown_regions(text: str, window: int, step: int) -> list[dict]:
    """(chunk_idx, chunk, section_path) of one text: a region for each heading and one before the first, cut by windows."""
    found, path, out, last = headings(text), [], [], 0
    edges = [(0, 0, ""), *found] if not found or found[0][0] > 0 else found
    for (start, level, title), end in zip(edges, [*(s for s, _, _ in edges[1:]), len(text)]):
        if level:
            path = [p for p in path if p[0] < level] + [(level, title)]
        region = text[start:end].strip(" ")
        parts = max(0, -(-(len(region) - window) // step)) + 1 if len(region) > window else 1
        for i in range(parts):
            chunk = region[i * step : i * step + window].strip(" ")
            if chunk.strip():
                out.append({"chunk_idx": last, "chunk": chunk, "section_path": [t for _, t in path]})
                last += 1
    return out


def chunk_markdown(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """One region per heading (and one before the first), cut by windows where it is longer than ``size`` tokens; each
    chunk knows the titles above it, outermost first."""
    window, step = windows(size, overlap)

    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: markdown_regions(t or "", window, step))

    chunks = F.pandas_udf(find, "array<struct<chunk_idx:int,chunk:string,section_path:array<string>>>")
    return docs.select("*", F.explode(chunks("text")).alias("c")).select("*", "c.chunk_idx", "c.chunk", "c.section_path").drop("c")


def capped(chunks: DataFrame, max_chunks: int) -> DataFrame:
    """The first ``max_chunks`` chunks in order of source and index."""
    return chunks.orderBy("source", "chunk_idx").limit(max_chunks)


def content_key(source: Column, idx: Column, text: Column) -> Column:
    """32 hex digits that depend on source, index and text."""
    return F.substring(F.sha2(F.concat_ws("\x1f", source, idx.cast("string"), text), 256), 1, 32)


def file_key(source: Column, idx: Column) -> Column:
    return F.concat(F.element_at(F.split(source, "/"), -1), F.lit("#"), idx.cast("string"))


def path_key(source: Column, idx: Column) -> Column:
    return F.concat(source, F.lit("#"), idx.cast("string"))


def metadata(source: Column, idx: Column, chunk: Column, content: bool = True, section_path: Column | None = None) -> Column:
    """The standard metadata as JSON text; an empty section path is left out."""
    fields = [source.alias(META_SOURCE)]
    if content:
        fields.append(F.substring(chunk, 1, CONTENT_CHARS).alias(META_CONTENT))
    fields += [idx.cast("int").alias(META_INDEX), F.sha2(chunk, 256).alias(META_HASH)]
    if section_path is not None:
        fields.append(F.when(F.size(section_path) > 0, section_path).alias("section_path"))
    return F.to_json(F.struct(*fields))


def merged_metadata(standard: Column, user: dict) -> Column:
    """``user`` put over the standard metadata, field by field."""
    if not isinstance(user, dict):
        raise Validation("user metadata must be an object")
    both = F.map_concat(F.map_filter(F.from_json(standard, "map<string,string>"), lambda k, _: ~k.isin(list(user))), F.from_json(F.lit(json.dumps(user)), "map<string,string>"))
    return F.to_json(both)


def embed_stub(text: Column, dimension: int = 768) -> Column:
    """A deterministic unit vector: byte i mod 32 of the text's SHA-256 over 255, normalised."""
    once = lambda value, use: F.transform(F.array(value), use)[0]  # noqa: E731  a lambda's argument is worked out once
    byte = lambda digest: lambda i: F.conv(F.substring(digest, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255
    digest = once(F.sha2(text, 256), lambda digest: F.transform(F.sequence(F.lit(0), F.lit(min(dimension, 32) - 1)), byte(digest)))
    raw = F.slice(F.flatten(F.array_repeat(digest, -(-dimension // 32))), 1, dimension)
    length = lambda r: F.sqrt(F.aggregate(r, F.lit(0.0), lambda s, x: s + x * x))
    return once(raw, lambda r: once(length(r), lambda n: F.transform(r, lambda x: x / n)))
