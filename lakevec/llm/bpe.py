"""Operator 4: byte-level BPE encoding and decoding with the tokenizers library, over Arrow batches.

Text is cut at single spaces between visible characters. The splitting pattern always begins a new match there, so the
pieces encode apart; equal pieces are encoded once and remembered by each worker in a bounded table. A piece not seen yet is
cut into the pattern's matches; a match not seen yet is written with one character for each byte and merged by the
library's BPE model, whose merges are every way to build a token from two others in order of rank (that gives the ids of
the rank file, which has no merge list). The vocabulary's byte table
(each byte stands as one printable character) is reversed for decoding: tokens become bytes again and are joined before
UTF-8 is read, so characters split over several tokens come out whole.

This equals the library's own ``encode``: its byte-level pre-tokenizer cuts by the same pattern, and its model merges each match
apart from the others. Added tokens of a tokenizer.json are taken out of the text first, as the library does; the rank
file has none.

Offsets are ranges of characters of the text, by the bytes of the tokens: tokens that share a split character share its range.

Defined results: a null text counts as empty: no ids, no bytes. With the rank file, ids of text that looks like a special
token are those of ordinary text; with a tokenizer.json an added token has its id. Repeated rows are encoded alike and kept; an empty table gives an empty result; other columns are
ignored; text is never cut short.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lakevec.llm.shared import texts_of

RANKS = "byte_bpe_multi_50k.tiktoken"
MAX_REMEMBERED = 150_000  # pieces in each table of a codec
BLOCK = 100_000  # characters
_CUT = re.compile(r"(?<=[!-~\w]) (?=[!-~\w])")


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if printable, else the next free one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


def _library(vocabulary: str):
    """A tokenizers.Tokenizer, its tokens' bytes, and its added tokens by text, from a tokenizer.json or a file of ranks."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer, models

    chars = byte_characters()
    if vocabulary.endswith(".json"):
        library = Tokenizer.from_file(vocabulary)
        added = library.get_added_tokens_decoder()
        if odd := [t.content for t in added.values() if t.lstrip or t.rstrip or t.single_word or t.normalized]:
            raise ValueError(f"added tokens that take in white space, whole words or normalized text: {odd}")
        back = {c: b for b, c in enumerate(chars)}
        known = {i: bytes(back[c] for c in t) for t, i in library.get_vocab(with_added_tokens=False).items()} | {i: t.content.encode() for i, t in added.items()}
        return library, [known.get(i, b"") for i in range(max(known) + 1)], {t.content: i for i, t in added.items()}
    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    shown = {t: "".join(chars[b] for b in t) for t in ranks}
    # every way to put a token together from two others, the lowest resulting rank first
    merges = [(shown[t[:k]], shown[t[k:]]) for t in sorted(ranks, key=ranks.get) for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
    library = Tokenizer(models.BPE(vocab={shown[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    tokens = [b""] * (max(ranks.values()) + 1)
    for t, r in ranks.items():
        tokens[r] = t
    return library, tokens, {}


class _Uncut(Exception):
    """A piece begins or ends with something other than a visible character."""


class _Remembered(dict):
    """Ids by text; what is missing is worked out once. At ``limit`` entries the table becomes the old one, from which
    texts still in use come back, and the old one before it goes: memory stays within two tables."""

    def __init__(self, find, limit: int):
        super().__init__()
        self.find, self.limit, self.old = find, limit, {}

    def __missing__(self, text: str) -> bytes:
        ids = self.old.get(text)
        if ids is None:
            ids = self.find(text)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[text] = ids
        return ids

    def forget(self) -> None:
        self.clear()
        self.old = {}


def _visible(c: str) -> bool:
    return "!" <= c <= "~" or c.isalnum() or c == "_"


class Codec:
    """Encoder and decoder of one vocabulary. Ids travel as little-endian unsigned 32-bit integers."""

    def __init__(self, vocabulary: str, remembered: int = MAX_REMEMBERED):
        self.library, self.tokens, self.added = _library(vocabulary)
        self.cut_added = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.model = self.library.model
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.shown = {b: c for b, c in enumerate(byte_characters())}
        self.space = self.shown[ord(" ")]
        self.match, self.piece, self.spaced = (_Remembered(find, remembered) for find in (self._match, self._piece, self._spaced))
        lengths = np.fromiter(map(len, self.tokens), np.int64, len(self.tokens))
        self.lengths, self.at = lengths, np.cumsum(lengths) - lengths
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)

    def _match(self, text: str) -> bytes:
        """One match of the pattern: its bytes as characters, merged by the library's model."""
        return self._merged(text.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.shown))

    def _merged(self, shown: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _piece(self, text: str) -> bytes:
        """Letters, and letters with a full stop or comma, need no pattern."""
        if text.isalpha():
            return self.match[text]
        if text[-1:] in (".", ",") and text[:-1].isalpha():
            return self.match[text[:-1]] + self.match[text[-1]]
        return b"".join([self.match[m] for m in self.split(text)])

    def _spaced(self, text: str) -> bytes:
        """A piece that stands after one space. One line break between visible characters is a match of its own."""
        if text.isalpha():
            return self._merged(self.space + text) if text.isascii() else self._match(" " + text)
        if text[-1:] in (".", ",") and text[:-1].isalpha():
            return self.spaced[text[:-1]] + self.match[text[-1]]
        if not text or not _visible(text[0]) or not _visible(text[-1]):
            raise _Uncut
        above, line, below = text.partition("\n")
        if line and "\n" not in below and _visible(above[-1]) and _visible(below[0]):
            return self.spaced[above] + self.match[line] + self.piece[below]
        return self._piece(" " + text)

    def encode(self, text: str) -> bytes:
        """The ids of a text."""
        if not self.added or not any(a in text for a in self.added):
            return self._ordinary(text)
        out, at = [], 0
        for m in self.cut_added.finditer(text):
            out += [self._ordinary(text[at : m.start()]), array("I", [self.added[m[0]]]).tobytes()]
            at = m.end()
        return b"".join([*out, self._ordinary(text[at:])])

    def _ordinary(self, text: str) -> bytes:
        """The ids of a text without added tokens. A long one is cut into blocks at single spaces between visible characters."""
        out, at = [], 0
        while at < len(text):
            cut = _CUT.search(text, at + BLOCK)
            end = cut.start() if cut else len(text)
            out.append(self._block(text[at:end], at > 0))
            at = end + 1
        return b"".join(out)

    def _block(self, text: str, after_space: bool) -> bytes:
        head, rest = b"", text.split(" ")
        try:
            if after_space or len(rest) == 1 or rest[0] and _visible(rest[0][-1]):
                head = b"" if after_space else self.piece[rest.pop(0)]
                return head + b"".join(map(self.spaced.__getitem__, rest))
        except _Uncut:
            pass
        rest = _CUT.split(text)
        head = b"" if after_space else self.piece[rest.pop(0)]
        return head + b"".join([self._piece(" " + p) if p and not (_visible(p[0]) and _visible(p[-1])) else self.spaced[p] for p in rest])

    def forget(self) -> None:
        """Give back the memory of the tables, as a worker outlives its tasks."""
        for table in (self.match, self.piece, self.spaced):
            table.forget()

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of a run of ids; whole characters appear once their tokens stand together."""
        n = self.lengths[ids]
        first = np.cumsum(n) - n
        return self.bytes[np.repeat(self.at[ids] - first, n) + np.arange(int(n.sum()))].tobytes()

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, int]:
        """(len(ids), 2) character ranges in ``text``, and how many tokens begin or end inside a character."""
        if not len(ids):
            return np.zeros((0, 2), np.int64), 0
        end = np.cumsum(self.lengths[ids])
        start = end - self.lengths[ids]
        if text.isascii():
            return np.stack([start, end], axis=1), 0
        begins = (np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8) & 0xC0) != 0x80
        character = np.cumsum(begins) - 1
        whole = begins[start] & np.r_[begins, True][end]
        return np.stack([character[start], character[end - 1] + 1], axis=1), int((~whole).sum())


@lru_cache(maxsize=4)
def codec(vocabulary: str, remembered: int = MAX_REMEMBERED) -> Codec:
    """One codec for each vocabulary and worker process."""
    return Codec(vocabulary, remembered)


def encoded(docs: DataFrame, vocabulary: str | None = None, offsets: bool = False) -> DataFrame:
    """(doc_id, ids array<int>, starts and ends array<int>): the general interface; starts and ends are null unless asked for."""
    vocabulary = vocabulary or public_tokenizers.path(RANKS)

    def run(batches):
        c = codec(vocabulary)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = [np.frombuffer(c.encode(t), "<u4") for t in texts]
            spans = [c.offsets(t, i)[0] for t, i in zip(texts, ids)] if offsets else []
            column = lambda k: pa.array([s[:, k].astype(np.int32) for s in spans] if offsets else [None] * len(ids), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([i.view(np.int32) for i in ids], pa.list_(pa.int32())), column(0), column(1)], names=["doc_id", "ids", "starts", "ends"])
        c.forget()

    return texts_of(docs).mapInArrow(run, "doc_id long, ids array<int>, starts array<int>, ends array<int>")


def round_trips(docs: DataFrame, vocabulary: str | None = None, with_ids: bool = False, with_offsets: bool = False) -> DataFrame:
    """Encode, decode the ids, and digest both: (doc_id, n_tokens, ids_sha256, decoded_sha256); if asked for the ids, and of the
    offsets their CRC-32 (pairs of little-endian 32-bit integers) and the number of tokens that cut through a character."""
    vocabulary = vocabulary or public_tokenizers.path(RANKS)

    def run(batches):
        c = codec(vocabulary)
        decimal = [str(i).encode() for i in range(len(c.tokens))]
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n, ids_sha, decoded_sha, kept, crc, split = [], [], [], [], [], []
            for t in texts:
                ids = np.frombuffer(c.encode(t), "<u4")
                n.append(len(ids))
                if with_ids:
                    kept.append(ids.view(np.int32))
                if with_offsets:
                    spans, cuts = c.offsets(t, ids)
                    crc.append(zlib.crc32(spans.astype("<i4").tobytes()))
                    split.append(cuts)
                ids_sha.append(hashlib.sha256(b",".join([decimal[i] for i in ids.tolist()])).hexdigest())
                decoded_sha.append(hashlib.sha256(c.decode(ids)).hexdigest())
            more = [pa.array(kept, pa.list_(pa.int32()))] * with_ids + [pa.array(x, pa.int64()) for x in (crc, split) if with_offsets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string()), *more], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids, *["offsets_crc32", "split_tokens"] * with_offsets])
        c.forget()

    return texts_of(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", offsets_crc32 long, split_tokens long" * with_offsets)


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trips(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_offsets=True)
