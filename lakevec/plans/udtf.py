"""Chunkers and parsers as table functions of SQL, over any table with the columns they read:

    SELECT * FROM chunk(TABLE(docs), 'fixed', 400, 80)
    SELECT * FROM sentences(TABLE(docs))
    SELECT * FROM parse(TABLE(files))

Rows go to Python in Arrow batches, each partition of the table by itself. All other columns stay; columns of the table that are named as a
result are replaced, as ``withColumn`` does.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from lakevec.errors import Validation
from lakevec.functions.sentences import unicode_sentences
from lakevec.operators import chunks
from lakevec.sources import files

_CHUNK = StructType().add("chunk_idx", "integer").add("chunk", "string")
_RESULTS = {"off": _CHUNK, "fixed": _CHUNK, "sentence": _CHUNK, "stops": _CHUNK, "markdown": StructType([*_CHUNK]).add("section_path", ArrayType(StringType()))}
_SENTENCE = StructType().add("sentence_idx", "integer").add("sentence", "string")
_PARSED = StructType().add("kind", "string").add("text", "string").add("failed", "boolean").add("reason", "string")


def _with(table: AnalyzeArgument, needs: tuple[str, ...], result: StructType, without: tuple[str, ...] = ()) -> AnalyzeResult:
    if not table.isTable:
        raise Validation("the first argument must be a TABLE")
    if missing := [n for n in needs if n not in table.dataType.names]:
        raise Validation(f"the table has no column {', '.join(missing)}")
    kept = [f for f in table.dataType.fields if f.name not in {*result.names, *without}]
    return AnalyzeResult(StructType([*kept, *result.fields]))


def _others(row: Row, result: StructType, without: tuple[str, ...] = ()) -> tuple:
    return tuple(v for n, v in zip(row.__fields__, row) if n not in {*result.names, *without})


def _constant(argument: AnalyzeArgument | None, default):
    if argument is None:
        return default
    if not argument.isConstantExpression:
        raise Validation("method, size and overlap must be constants")
    return argument.value


def _pieces(text: str, method: str, size: int, overlap: int) -> list[tuple]:
    limit = size * chunks.CHARS_PER_TOKEN
    if method == "markdown":
        return [(r["chunk_idx"], r["chunk"], r["section_path"]) for r in chunks.markdown_regions(text, *chunks.windows(size, overlap))]
    if method == "fixed":
        return chunks.fixed_windows(text, *chunks.windows(size, overlap))
    found = [text] if method == "off" else chunks.packed_whole(unicode_sentences(text), limit) if method == "sentence" else chunks.packed_sentences(text, limit)
    return list(enumerate(found))


@udtf(useArrow=True)
class Chunk:
    """``chunk(TABLE(t), method, size, overlap)``: the rows of the chunkers of ``operators.chunks`` over the column ``text``."""

    @staticmethod
    def analyze(table: AnalyzeArgument, method: AnalyzeArgument = None, size: AnalyzeArgument = None, overlap: AnalyzeArgument = None) -> AnalyzeResult:
        name = _constant(method, "fixed")
        if name not in _RESULTS:
            raise Validation(f"method must be one of {', '.join(_RESULTS)}")
        chunks.windows(_constant(size, chunks.SIZE), _constant(overlap, chunks.OVERLAP))
        return _with(table, ("text",), _RESULTS[name])

    def eval(self, row: Row, method: str = "fixed", size: int = chunks.SIZE, overlap: int = chunks.OVERLAP) -> Iterator[tuple]:
        others = _others(row, _RESULTS[method])
        for piece in _pieces(row["text"], method, size, overlap) if row["text"] else ():
            yield (*others, *piece)


@udtf(useArrow=True)
class Sentences:
    """``sentences(TABLE(t))``: one row for each sentence of the column ``text``."""

    @staticmethod
    def analyze(table: AnalyzeArgument) -> AnalyzeResult:
        return _with(table, ("text",), _SENTENCE)

    def eval(self, row: Row) -> Iterator[tuple]:
        others = _others(row, _SENTENCE)
        for n, sentence in enumerate(unicode_sentences(row["text"] or "")):
            yield (*others, n, sentence)


@udtf(useArrow=True)
class Parse:
    """``parse(TABLE(files))``: ``sources.files.parse_files`` over the columns ``ext`` and ``content``, which do not come back."""

    @staticmethod
    def analyze(table: AnalyzeArgument) -> AnalyzeResult:
        return _with(table, ("ext", "content"), _PARSED, ("ext", "content"))

    def eval(self, row: Row) -> Iterator[tuple]:
        if row["ext"] in files.KNOWN:
            yield (*_others(row, _PARSED, ("ext", "content")), *files.parsed(row["ext"], row["content"]))


def register(spark: SparkSession) -> None:
    """``chunk``, ``sentences`` and ``parse`` as functions of the session."""
    for name, handler in (("chunk", Chunk), ("sentences", Sentences), ("parse", Parse)):
        spark.udtf.register(name, handler)
