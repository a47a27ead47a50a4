"""Files as document rows: listing, filters, hashes and text extraction."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakevec.sources.pdf import page_texts

MAX_FILE_BYTES = 50 << 20
#: Of all parts of a packed file together, as they are unpacked.
MAX_UNPACKED_BYTES = 256 << 20
#: Of the files that a task parses and hands on at a time; a larger file goes alone.
SLICE_BYTES = 4 << 20
#: Fixed lists: what each parser takes.
TEXT = ("txt", "text", "log", "rst", "csv", "tsv", "json", "jsonl", "yaml", "yml", "toml")
MARKDOWN, HTML = ("md", "markdown", "mdx"), ("html", "htm", "xhtml")
OFFICE = ("docx", "docm", "pptx", "pptm", "odt", "odp", "xlsx", "xlsm")
PDF = ("pdf",)
KNOWN = (*TEXT, *MARKDOWN, *HTML, *OFFICE, *PDF)
INLINE = "<text-value>"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def read_files(spark: SparkSession, paths: str | list[str], recursive: bool = True) -> DataFrame:
    """(source, ext, length, content, content_hash) of every file below ``paths``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(paths)
    return files.select(F.col("path").alias("source"), extension(F.col("path")).alias("ext"), "length", "content").withColumn("content_hash", F.sha2("content", 256))


def eligible(files: DataFrame, max_bytes: int = MAX_FILE_BYTES, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Files of at most ``max_bytes`` whose extension is included and not excluded (any case, with or without a dot)."""
    bare = lambda names: [n.lower().lstrip(".") for n in names]
    out = files.where(F.col("length") <= max_bytes)
    if include:
        out = out.where(F.col("ext").isin(bare(include)))
    return out.where(~F.col("ext").isin(bare(exclude))) if exclude else out


class _Text(HTMLParser):
    def __init__(self, scripts: bool):
        super().__init__(convert_charrefs=True)
        self.parts, self.skip, self.scripts = [], 0, scripts

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style") and not self.scripts

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style") and not self.scripts and self.skip > 0

    def handle_data(self, data):
        if not self.skip and data.strip():
            self.parts.append(data.strip())


def html_text(html: str, scripts: bool = False) -> str:
    """Trimmed text nodes joined by one space."""
    parser = _Text(scripts)
    parser.feed(html)
    parser.close()
    return " ".join(parser.parts)


def html_to_text(html: Column) -> Column:
    """The same as built-in expressions: scripts, styles and tags become spaces, white space is squeezed."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"<[^>]+>", " "), r"\s+", " "))


def _xml_text(data: bytes) -> str:
    return " ".join(t.strip() for t in ElementTree.fromstring(data).itertext() if t.strip())


class TooLarge(ValueError):
    pass


class Unpacked:
    """What may still be unpacked of one file; more than MAX_UNPACKED_BYTES is an error before it is in memory."""

    def __init__(self):
        self.left = MAX_UNPACKED_BYTES

    def took(self, size: int) -> None:
        self.left -= size
        if self.left < 0:
            raise TooLarge(f"more than {MAX_UNPACKED_BYTES} bytes when unpacked")

    def _took(self, data: bytes) -> bytes:
        self.took(len(data))
        return data

    def member(self, z: zipfile.ZipFile, name: str) -> bytes:
        with z.open(name) as f:
            return self._took(f.read(self.left + 1))

    def inflated(self, data: bytes) -> bytes:
        return self._took(zlib.decompressobj().decompress(data, self.left + 1))


def office_text(content: bytes, ext: str) -> str:
    """Text of an office file: its parts one per line; a sheet begins with a heading of its name."""
    unpacked = Unpacked()
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        if ext in ("docx", "docm"):
            wanted = ["word/document.xml"]
        elif ext in ("odt", "odp"):
            wanted = ["content.xml"]
        elif ext in ("pptx", "pptm"):
            wanted = sorted((n for n in names if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        else:
            return _sheets(z, names, unpacked)
        return "\n".join(t for t in (_xml_text(unpacked.member(z, n)) for n in wanted if n in names) if t)


def _sheets(z: zipfile.ZipFile, names: set[str], unpacked: Unpacked) -> str:
    local = lambda e: e.tag.rpartition("}")[2]
    shared = []
    if "xl/sharedStrings.xml" in names:
        shared = ["".join(si.itertext()).strip() for si in ElementTree.fromstring(unpacked.member(z, "xl/sharedStrings.xml")) if local(si) == "si"]
    titles = []
    if "xl/workbook.xml" in names:
        titles = [e.get("name") for e in ElementTree.fromstring(unpacked.member(z, "xl/workbook.xml")).iter() if local(e) == "sheet"]
    sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
    out = []
    for i, name in enumerate(sheets):
        cells = []
        for c in ElementTree.fromstring(unpacked.member(z, name)).iter():
            if local(c) == "c" and c.get("t") == "s":
                v = next((e.text for e in c if local(e) == "v"), None)
                cells.append(shared[int(v)] if v and int(v) < len(shared) else "")
            elif local(c) == "c" and c.get("t") == "inlineStr":
                cells.append("".join(c.itertext()).strip())
        out.append("\n".join([f"# {titles[i] if i < len(titles) else f'Sheet{i + 1}'}", *(c for c in cells if c)]))
    return "\n".join(out)


_STREAM = re.compile(rb"<<((?:(?!stream).)*?)>>\s*stream\r?\n(.*?)\r?\n?endstream", re.S)
_TEXT_BLOCK = re.compile(rb"\bBT\b(.*?)\bET\b", re.S)
_SHOWN = re.compile(rb"\[((?:\((?:\\.|[^\\()])*\)|[^\]()])*)\]\s*TJ|(\((?:\\.|[^\\()])*\))\s*(?:Tj|'|\")|(T\*|T[dD]\b)", re.S)
_STRING = re.compile(rb"\(((?:\\.|[^\\()])*)\)|(-\d+(?:\.\d+)?)", re.S)
_ESCAPE = re.compile(rb"\\([0-7]{1,3}|\r?\n|.)", re.S)
#: Fixed values of the format: what a letter after a backslash stands for.
_LETTERS = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def pdf_text(content: bytes) -> str:
    """Text that a PDF shows, one page after another by form feeds, in the order of its page tree and by its fonts' maps to Unicode. Where no
    page tree can be found, content streams in the order of the file, in one-byte encodings. Files that are encrypted or show no text
    that can be read are errors."""
    content = content.lstrip()
    if not content.startswith(b"%PDF-"):
        raise ValueError("no PDF header")
    unpacked = Unpacked()
    pages = page_texts(content, unpacked.inflated, unpacked.took)
    if pages is None:
        if b"/Encrypt" in content:
            raise ValueError("encrypted")
        pages = _loose_streams(content)
    if not any(pages):
        raise ValueError("no text that can be read")
    return "\f".join(pages)


def _loose_streams(content: bytes) -> list[str]:
    shown = lambda raw: _ESCAPE.sub(lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else b"" if m[1] in (b"\n", b"\r\n") else _LETTERS.get(m[1], m[1]), raw)
    pages, unpacked = [], Unpacked()
    for header, data in _STREAM.findall(content):
        if b"/FlateDecode" in header:
            try:
                data = unpacked.inflated(data)
            except zlib.error:
                continue  # not text, or damaged: other pages go on
        elif b"/Filter" in header:
            continue
        parts = []
        for block in _TEXT_BLOCK.findall(data):
            for array, string, move in _SHOWN.findall(block):
                if move:
                    parts.append(b" ")
                for piece, gap in _STRING.findall(array or string):
                    parts.append(shown(piece) if not gap else b" " if float(gap) < -200 else b"")
            parts.append(b" ")
        if words := b"".join(parts).decode("cp1252", "replace").split():
            pages.append(" ".join(words))
    return pages


def inline(spark: SparkSession, text: str) -> DataFrame:
    """One text given as such, as a parsed document."""
    row = spark.createDataFrame([(INLINE, "text", text)], "source string, kind string, text string")
    return row.select("*", F.sha2("text", 256).alias("content_hash"), F.lit(False).alias("failed"), F.lit(None).cast("string").alias("reason"))


def parsed(ext: str, content: bytes | None) -> tuple[str, str | None, bool, str | None]:
    """(kind, text, failed, reason) of one file of a known extension."""
    kind = "text" if ext in TEXT else "markdown" if ext in MARKDOWN else "html" if ext in HTML else "pdf" if ext in PDF else "office"
    try:
        content = bytes(content or b"")
        text = office_text(content, ext) if kind == "office" else pdf_text(content) if kind == "pdf" else content.decode("utf-8", "replace")
        return kind, html_text(text) if kind == "html" else text, False, None
    except Exception as e:  # a damaged file is reported, the others go on
        return kind, None, True, f"{type(e).__name__}: {e}"


def parse_files(files: DataFrame) -> DataFrame:
    """(source, kind, text, content_hash, failed, reason): files of a known kind; a file that cannot be read has failed set and
    says why. A task holds SLICE_BYTES of files and their texts at a time, besides the Arrow batch that they come in."""
    known = files.where(F.col("ext").isin(*KNOWN))
    return known.select("source", "ext", "content", "content_hash").mapInArrow(_parse, "source string, kind string, text string, content_hash string, failed boolean, reason string")


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _slices(batch):
            found = [parsed(ext, content.as_py()) for ext, content in zip(part.column("ext").to_pylist(), part.column("content"))]
            kinds, texts, failed, reasons = zip(*found)
            out = [part.column("source"), pa.array(kinds, pa.string()), pa.array(texts, pa.string()), part.column("content_hash"), pa.array(failed, pa.bool_()), pa.array(reasons, pa.string())]
            yield pa.RecordBatch.from_arrays(out, names=["source", "kind", "text", "content_hash", "failed", "reason"])


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows in order, in slices of at most SLICE_BYTES of content, or of one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column("content")), 0).to_pylist()
    first = held = 0
    for at, size in enumerate(sizes):
        if at > first and held + size > SLICE_BYTES:
            yield batch.slice(first, at - first)
            first, held = at, 0
        held += size
    if first < len(sizes):
        yield batch.slice(first)


def sampled(rows: DataFrame, by: Column, fraction: float, seed: int = 0) -> DataFrame:
    """About ``fraction`` of the rows: those whose hash of ``by`` and ``seed`` is low. The same rows on every run, however they are dealt
    into files and partitions."""
    number = F.conv(F.substring(F.md5(F.concat_ws(":", by.cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("long")
    return rows.where(number < int(fraction * 2**32))


def not_done(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files without a done record of the same source and content in ``ledger`` (source, content_hash, status)."""
    return files.join(ledger.where("status = 'done'").select("source", "content_hash"), ["source", "content_hash"], "left_anti")
