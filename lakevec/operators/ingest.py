"""Documents to vectors: parsed rows are chunked, keyed, described and embedded; counts come from one aggregate."""

from __future__ import annotations

import random
import time
from abc import ABC, abstractmethod
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakevec.errors import Validation
from lakevec.functions.distance import vector_literal
from lakevec.operators import chunks
from lakevec.operators.vectors import search


MAX_HITS = 20


class EmbeddingProvider(ABC):
    """A model behind an interface: ``embed`` takes at most ``max_batch`` texts and returns one vector for each."""

    name, model, dimension, max_batch, max_tokens_per_input = "", "", 0, 100, 8192

    @abstractmethod
    def embed(self, texts: list[str]) -> list[list[float]]: ...


def with_retry(call, attempts: int = 6, first: float = 0.25, cap: float = 30.0, sleep=time.sleep):
    """``call()`` again after a failure, waiting twice as long each time and up to a quarter more at random."""
    for n in range(attempts):
        try:
            return call()
        except Exception:
            if n == attempts - 1:
                raise
            sleep(min(cap, first * 2**n) * (1 + random.random() / 4))


def embed_with(provider: EmbeddingProvider):
    """An Arrow iterator UDF text -> array<float>; a batch whose vectors do not match its texts gives nulls."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for at in range(0, len(texts), provider.max_batch):
                part = texts.iloc[at : at + provider.max_batch].tolist()
                vectors = with_retry(lambda part=part: provider.embed(part))
                out += vectors if len(vectors) == len(part) else [None] * len(part)
            yield pd.Series(out, dtype=object)

    return F.pandas_udf(run, "array<float>")


CHUNKERS = {"off": chunks.chunk_off, "fixed": chunks.chunk_fixed, "sentence": chunks.chunk_unicode_sentence, "stops": chunks.chunk_sentence, "markdown": chunks.chunk_markdown}
KEYS = {
    "content-hash": lambda: chunks.content_key(F.col("source"), F.col("chunk_idx"), F.col("chunk")),
    "filename": lambda: chunks.file_key(F.col("source"), F.col("chunk_idx")),
    "path": lambda: chunks.path_key(F.col("source"), F.col("chunk_idx")),
}


def attempted(docs: DataFrame, chunker: str = "fixed", key: str = "content-hash", dimension: int = 768, embed=None, user_metadata: dict | None = None, **options) -> DataFrame:
    """(source, key, vec, meta) of every chunk of ``docs`` (source, text); vec is null where embedding failed. Without ``embed``, the
    stub embedder."""
    found = CHUNKERS[chunker](docs.where("text is not null"), **options)
    path = F.col("section_path") if "section_path" in found.columns else None
    meta = chunks.metadata(F.col("source"), F.col("chunk_idx"), F.col("chunk"), section_path=path)
    if user_metadata:
        meta = chunks.merged_metadata(meta, user_metadata)
    vector = embed(F.col("chunk")) if embed else chunks.embed_stub(F.col("chunk"), dimension)
    return found.select("source", KEYS[key]().alias("key"), vector.cast("array<float>").alias("vec"), meta.alias("meta"))


def embedded(docs: DataFrame, *args, **options) -> DataFrame:
    """(key, vec, meta) of the chunks that have a vector; arguments as in ``attempted``."""
    return attempted(docs, *args, **options).where("vec is not null").drop("source")


def put(vectors: DataFrame, dimension: int) -> DataFrame:
    """``vectors`` as they may be stored: a vector of another size fails the write."""
    wrong = F.concat(F.lit(f"vector must have length {dimension}, but has length "), F.size("vec"))
    return vectors.withColumn("vec", F.when(F.size("vec") == dimension, F.col("vec")).otherwise(F.raise_error(wrong).cast("array<float>")))


def stats(parsed: DataFrame, tried: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """One row of counts over a run: raw, parsed, parse_failures, chunks, embedded, embed_failures, put. ``tried``: ``attempted`` chunks;
    ``stored``: the rows put (key), else every embedded chunk counts as put."""
    docs = parsed.agg(F.count("*").alias("raw"), F.count_if(~F.col("failed")).alias("parsed"), F.count_if("failed").alias("parse_failures"))
    done = tried.agg(F.count("*").alias("chunks"), F.count("vec").alias("embedded"), F.count_if(F.col("vec").isNull()).alias("embed_failures"))
    puts = done.withColumn("put", F.col("embedded")) if stored is None else done.join(stored.agg(F.count("*").alias("put")))
    return docs.join(puts)


def ledger(parsed: DataFrame, tried: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """A run's records: (source, content_hash, chunks, puts, status, at). ``done`` where all chunks were put, ``partial`` where embedding or
    putting failed; a document without chunks is done at once. Arguments as in ``stats``."""
    if stored is not None:
        tried = tried.join(stored.select("key", F.lit(True).alias("_put")).distinct(), "key", "left").withColumn("vec", F.when(F.col("_put"), F.col("vec")))
    counts = tried.groupBy("source").agg(F.count("*").alias("chunks"), F.count("vec").alias("puts"))
    found = parsed.where("not failed").join(counts, "source", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("chunks", "puts")})
    status = F.when(F.col("puts") >= F.col("chunks"), "done").otherwise("partial")
    return found.select("source", "content_hash", "chunks", "puts", status.alias("status"), F.current_timestamp().alias("at"))


def text_query(vectors: DataFrame, query: str, k: int = 5, dimension: int = 768, where: dict | None = None, embed: Column | None = None) -> DataFrame:
    """The k chunks nearest to a text: (source, chunk_idx, snippet, distance, key)."""
    if not query.strip():
        raise Validation("the query is empty")
    vector = embed if embed is not None else chunks.embed_stub(F.lit(query), dimension)
    own = vectors.sparkSession.range(1).select(vector.cast("array<double>")).first()[0]  # the query, once
    hits = search(vectors, vector_literal(own), k, where=where)
    get = lambda name: F.get_json_object("meta", f"$['{name}']")
    return hits.select(get(chunks.META_SOURCE).alias("source"), get(chunks.META_INDEX).cast("int").alias("chunk_idx"), F.substring(get(chunks.META_CONTENT), 1, 60).alias("snippet"), "distance", "key")


def retrieve(vectors: DataFrame, query: str, k: int = 5, **options) -> DataFrame:
    """``text_query`` for callers that may ask for anything: k is taken to 1..MAX_HITS."""
    return text_query(vectors, query, min(max(k, 1), MAX_HITS), **options)
