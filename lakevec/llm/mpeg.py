"""Operator 3: media columns of MPEG audio.

A payload is stored as a stream of MPEG-1 Layer III frames (48 kHz, stereo): an ID3v2 tag with the unpadded size, a
first frame with a variable-bitrate table (frame count, byte count, 100 seek points), one silent frame for each unit of
576 payload bytes, and an ID3v1 tag. The frames' side information is all zero (no main data, silence), so the whole rest
of a frame is ancillary data, and there the unit stands: 4 header bytes, 2 CRC bytes, 32 of side information, 576 of
payload, 4 of their CRC-32, and zeros up to the frame's length (224 kbit/s: 672 bytes). Any decoder plays silence of the
stream's length.

Parsing takes any bytes: it reads ID3v2 (2.2 to 2.4, unsynchronised or not) and ID3v1 tags, looks for frame headers,
resynchronises after damage on a header whose successor agrees with it, reads Xing, Info and VBRI tables, and verifies each
frame's CRC-16 (header and side information in Layer III, header, bit allocation and scale factor selection in Layers I and II).
The exact duration (samples over sample rate) and the byte offset of every frame are stored as columns beside the bytes,
so that a reader seeks without parsing.

Defined results: a null text counts as empty and stores one unit of 255s; payloads are padded by 255s to a positive
multiple of 576; equal texts give equal bytes; frames whose CRC-16 fails are counted and not read, as are units whose CRC-32
fails; repeated rows are kept; an empty table gives an empty result; other columns are ignored; texts are stored whole at
any length.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakevec.llm.shared import drop_at_exit, scratch_path, texts_of

UNIT, FILL, BITRATE, SAMPLE_RATE = 576, 255, 224, 48000
#: Fixed values of the format (ISO/IEC 11172-3 and 13818-3): kbit/s by version, layer and index; Hz by version and index.
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
SAMPLE_RATES = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}
_VERSIONS = {0: 2.5, 2: 2, 3: 1}


def crc16(data: bytes, bits: int | None = None) -> int:
    """CRC-16 with polynomial 0x8005 from 0xFFFF over the first ``bits`` of ``data`` (all), the most significant bit first."""
    crc = 0xFFFF
    for k in range(8 * len(data) if bits is None else bits):
        top = crc >> 15 ^ data[k >> 3] >> (7 - (k & 7)) & 1
        crc = (crc << 1 ^ (0x8005 if top else 0)) & 0xFFFF
    return crc


@dataclass(frozen=True)
class Header:
    version: float
    layer: int
    protected: bool
    bitrate: int
    sample_rate: int
    padding: bool
    mono: bool
    bound: int = 32  # subbands of which each channel has its own allocation

    @property
    def samples(self) -> int:
        return 384 if self.layer == 1 else 576 if self.layer == 3 and self.version != 1 else 1152

    @property
    def length(self) -> int:
        if self.layer == 1:
            return (12000 * self.bitrate // self.sample_rate + self.padding) * 4
        return self.samples // 8 * 1000 * self.bitrate // self.sample_rate + self.padding

    @property
    def side(self) -> int:
        """Bytes of Layer III side information."""
        return 0 if self.layer != 3 else (17 if self.mono else 32) if self.version == 1 else (9 if self.mono else 17)


def header(data: bytes, at: int) -> Header | None:
    """The frame header at ``at``; None if there is none (free format counts as none)."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return None
    b, c, d = data[at + 1], data[at + 2], data[at + 3]
    version, layer = _VERSIONS.get(b >> 3 & 3), 4 - (b >> 1 & 3)
    if version is None or layer == 4 or c >> 4 in (0, 15) or c >> 2 & 3 == 3:
        return None
    bitrate = BITRATES[1 if version == 1 else 2, layer][c >> 4]
    bound = 4 * (d >> 4 & 3) + 4 if d >> 6 == 1 else 32
    return Header(version, layer, not b & 1, bitrate, SAMPLE_RATES[version][c >> 2 & 3], bool(c & 2), d >> 6 == 3, bound)


#: Fixed values of the format: bits of a Layer II subband's allocation, as (bits, subbands) from the lowest.
ALLOCATION = {
    "a": ((4, 11), (3, 12), (2, 4)),
    "b": ((4, 11), (3, 12), (2, 7)),
    "c": ((4, 2), (3, 6)),
    "d": ((4, 2), (3, 10)),
    "lsf": ((4, 4), (3, 7), (2, 19)),
}


def allocation_bits(head: Header) -> list[int]:
    """Bits of each subband's allocation in a Layer II frame."""
    each = head.bitrate // (1 if head.mono else 2)
    if head.version != 1:
        name = "lsf"
    elif each <= 48:
        name = "d" if head.sample_rate == 32000 else "c"
    else:
        name = "a" if head.sample_rate == 48000 or each <= 80 else "b"
    return [bits for bits, n in ALLOCATION[name] for _ in range(n)]


def protected_bits(data: bytes, at: int, head: Header) -> int:
    """How many bits after the frame's CRC it covers (besides the header's last two bytes)."""
    if head.layer == 3:
        return 8 * head.side
    channels = 1 if head.mono else 2
    if head.layer == 1:
        return 4 * (32 * channels if head.mono else 2 * head.bound + 32 - head.bound)
    body, place, used = int.from_bytes(data[at + 6 : at + 6 + 64].ljust(64, b"\0"), "big"), 0, 0
    for k, bits in enumerate(allocation_bits(head)):
        own = channels if k < head.bound else 1
        for _ in range(own):
            place += bits
            if body >> (512 - place) & (1 << bits) - 1:  # a shared allocation has a selection for each channel
                used += channels if own < channels else 1
    return place + 2 * used


def good_crc(data: bytes, at: int, head: Header) -> bool:
    bits = protected_bits(data, at, head)
    covered = data[at + 2 : at + 4] + data[at + 6 : at + 6 + (bits + 7) // 8]
    return len(covered) * 8 >= 16 + bits and crc16(covered, 16 + bits) == int.from_bytes(data[at + 4 : at + 6], "big")


def _synchsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def _head(protected: bytes) -> bytes:
    """Header, CRC and zero side information of one of our frames."""
    first = bytes([0xFF, 0xFA, BITRATES[1, 3].index(BITRATE) << 4 | SAMPLE_RATES[1].index(SAMPLE_RATE) << 2, 0])
    return first + crc16(first[2:] + protected).to_bytes(2, "big") + protected


_HEAD = _head(bytes(32))
_FRAME = header(_HEAD, 0).length


def encode(payload: bytes, n_bytes: int) -> bytes:
    """The stored form of a payload whose length is a positive multiple of UNIT."""
    units = len(payload) // UNIT
    frames = np.zeros((units + 1, _FRAME), np.uint8)
    frames[:, : len(_HEAD)] = np.frombuffer(_HEAD, np.uint8)
    frames[1:, len(_HEAD) : len(_HEAD) + UNIT] = np.frombuffer(payload, np.uint8).reshape(units, UNIT)
    sums = np.array([zlib.crc32(payload[k : k + UNIT]) for k in range(0, len(payload), UNIT)], "<u4")
    frames[1:, len(_HEAD) + UNIT : len(_HEAD) + UNIT + 4] = sums.view(np.uint8).reshape(units, 4)
    total = frames.size
    # every frame has the same length, so seek point k of 256 parts of the stream is k percent of it
    table = b"Xing" + (7).to_bytes(4, "big") + units.to_bytes(4, "big") + total.to_bytes(4, "big") + bytes(k * 256 // 100 for k in range(100))
    frames[0, len(_HEAD) : len(_HEAD) + len(table)] = np.frombuffer(table, np.uint8)
    text = b"\x03n_bytes\x00" + str(n_bytes).encode()
    tag = b"TXXX" + _synchsafe(len(text)) + b"\x00\x00" + text
    return b"ID3\x04\x00\x00" + _synchsafe(len(tag)) + tag + frames.tobytes() + b"TAG" + b"payload".ljust(125, b"\x00")


@dataclass
class Stream:
    """What parsing finds. offsets: byte offsets of the audio frames (a table's own frame is none of them)."""

    tags: dict[str, str] = field(default_factory=dict)
    first: Header | None = None
    offsets: list[int] = field(default_factory=list)
    lengths: list[int] = field(default_factory=list)
    bodies: list[int] = field(default_factory=list)
    samples: int = 0
    bad_crc: int = 0
    skipped: int = 0
    table: dict | None = None

    @property
    def duration(self) -> Fraction:
        return Fraction(self.samples, self.first.sample_rate) if self.first else Fraction(0)


def _id3v2(data: bytes, tags: dict[str, str]) -> int:
    """Read the tag at the start, if any; where the audio begins."""
    if data[:3] != b"ID3" or len(data) < 10:
        return 0
    size = lambda b: b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]
    version, flags, end = data[3], data[5], 10 + size(data[6:10])
    body, at = data[10:end], 0
    if flags & 0x80 and version < 4:
        body = body.replace(b"\xff\x00", b"\xff")
    if flags & 0x40 and version > 2 and len(body) > 4:  # an extended header
        at = size(body[:4]) if version == 4 else 4 + int.from_bytes(body[:4], "big")
    letters = 3 if version == 2 else 4
    head = 6 if version == 2 else 10
    while at + head <= len(body) and body[at]:
        raw = body[at + letters : at + 2 * letters]
        n = size(raw) if version == 4 else int.from_bytes(raw, "big")
        value = body[at + head : at + head + n]
        if version == 4 and body[at + 9] & 2 or version == 4 and flags & 0x80:
            value = value.replace(b"\xff\x00", b"\xff")
        if version == 4 and body[at + 9] & 1:
            value = value[4:]  # its length without unsynchronisation
        if body[at : at + 1] == b"T" and value:
            text = value[1:].decode(("latin-1", "utf-16", "utf-16-be", "utf-8")[value[0] & 3], "replace")
            own = body[at : at + letters]
            name, _, text = text.partition("\x00") if own in (b"TXXX", b"TXX") else (own.decode("latin-1"), "", text)
            tags[name.lstrip("\ufeff")] = text.lstrip("\ufeff").rstrip("\x00")
        at += head + n
    return end + (10 if flags & 0x10 and version == 4 else 0)


def _table(data: bytes, at: int, head: Header) -> dict | None:
    """The Xing, Info or VBRI table in the frame at ``at``: its frames, bytes and seek points."""
    number = lambda p, n=4: int.from_bytes(data[p : p + n], "big")
    if data[at + 36 : at + 40] == b"VBRI":
        p = at + 40
        entries, scale, width = number(p + 14, 2), number(p + 16, 2), number(p + 18, 2)
        return {"bytes": number(p + 6), "frames": number(p + 10), "frames_per_entry": number(p + 20, 2), "seek": [scale * number(p + 22 + k * width, width) for k in range(entries)]}
    p = at + 4 + 2 * head.protected + head.side
    if data[p : p + 4] not in (b"Xing", b"Info"):
        p = at + 4 + head.side  # writers that leave the CRC out of account
    if head.layer != 3 or data[p : p + 4] not in (b"Xing", b"Info"):
        return None
    flags, p = number(p + 4), p + 8
    out: dict = {}
    for bit, name in ((1, "frames"), (2, "bytes")):
        if flags & bit:
            out[name], p = number(p), p + 4
    if flags & 4:
        out["seek"] = list(data[p : p + 100])
    return out


def parse(data: bytes) -> Stream:
    """Tags, frames and checksums of a stream, resynchronising wherever no frame stands."""
    out = Stream()
    at = _id3v2(data, out.tags)
    end = len(data) - 128 if len(data) >= 128 and data[-128:-125] == b"TAG" else len(data)
    if end < len(data):
        out.tags["TAG"] = data[end + 3 : end + 33].rstrip(b"\x00 ").decode("latin-1")
    heads: dict[bytes, Header | None] = {}
    checks: dict[bytes, bool] = {}
    begun = False
    while at < end:
        key = data[at : at + 4]
        if key not in heads:
            heads[key] = header(data, at)
        head = heads[key]
        fits = head is not None and at + head.length <= end
        if fits and (not out.offsets or out.skipped):  # in doubt until the next header agrees
            after = header(data, at + head.length)
            fits = at + head.length == end or after is not None and (after.version, after.layer, after.sample_rate) == (head.version, head.layer, head.sample_rate)
        if not fits or out.first and (head.version, head.layer, head.sample_rate) != (out.first.version, out.first.layer, out.first.sample_rate):
            step = data.find(b"\xff", at + 1, end)
            out.skipped += (step if step >= 0 else end) - at
            at = step if step >= 0 else end
            continue
        out.first = out.first or head
        body = at + 4 + 2 * head.protected + head.side
        good = True
        if head.protected:
            covered = data[at : body if head.layer == 3 else at + 70]
            if covered not in checks:
                if len(checks) > 4096:
                    checks.clear()
                checks[covered] = good_crc(data, at, head)
            good = checks[covered]
        table = None if begun else _table(data, at, head)
        begun = True
        if table is not None:
            out.table = table
        elif not good:
            out.bad_crc += 1
        else:
            out.offsets.append(at)
            out.lengths.append(head.length)
            out.bodies.append(body)
            out.samples += head.samples
        at += head.length
    return out


def payload_of(data: bytes, stream: Stream) -> tuple[bytes, int]:
    """The units in the ancillary data of the frames ``encode`` writes, and how many were left out for their CRC-32."""
    raw, units = memoryview(data), []
    for body in stream.bodies:
        unit = raw[body : body + UNIT]
        if len(unit) == UNIT and zlib.crc32(unit) == int.from_bytes(raw[body + UNIT : body + UNIT + 4], "little"):
            units.append(unit)
    return b"".join(units), len(stream.bodies) - len(units)


def pad(text: bytes) -> bytes:
    return text + bytes([FILL]) * (-len(text) % UNIT if text else UNIT)


INDEX = "duration_samples long, sample_rate int, frame_offsets array<long>, bad_crc long, skipped long, tags map<string,string>"


def indexed(doc_id, media: list[bytes | None]) -> pa.RecordBatch:
    """Rows of (doc_id, media and the columns of INDEX): what parsing finds, beside the bytes."""
    found = [parse(m or b"") for m in media]
    types = {"duration_samples": pa.int64(), "sample_rate": pa.int32(), "frame_offsets": pa.list_(pa.int64()), "bad_crc": pa.int64(), "skipped": pa.int64(), "tags": pa.map_(pa.string(), pa.string())}
    values = [[s.samples for s in found], [s.first.sample_rate if s.first else None for s in found], [s.offsets for s in found], [s.bad_crc for s in found], [s.skipped for s in found], [list(s.tags.items()) for s in found]]
    return pa.RecordBatch.from_arrays([doc_id, pa.array(media, pa.binary()), *(pa.array(v, t) for v, t in zip(values, types.values()))], names=["doc_id", "media", *types])


def _groups(sizes: list[int], limit: int = 8_000_000):
    """Consecutive [from, to) of about ``limit`` bytes each; a longer one stands alone."""
    at = 0
    while at < len(sizes):
        size, to = 0, at
        while to < len(sizes) and (to == at or size + sizes[to] < limit):
            size, to = size + sizes[to], to + 1
        yield at, to
        at = to


def index_media(media: DataFrame) -> DataFrame:
    """``media`` (doc_id, media binary: any bytes) with exact durations, every frame's seek offset, tags and counts of damage."""

    def run(batches):
        for batch in batches:
            for a, b in _groups(pc.binary_length(batch.column(1)).fill_null(0).to_pylist()):
                yield indexed(batch.column(0)[a:b], batch.column(1)[a:b].to_pylist())

    return media.select(F.col("doc_id").cast("long"), "media").mapInArrow(run, f"doc_id long, media binary, {INDEX}")


def write_media(docs: DataFrame, path: str) -> None:
    """Store each text as a media column with its index: (doc_id, media binary, and the columns of INDEX)."""

    def run(batches):
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            for a, b in _groups(list(map(len, texts))):
                yield indexed(batch.column(0)[a:b], [encode(pad(t), len(t)) for t in texts[a:b]])

    texts_of(docs).mapInArrow(run, f"doc_id long, media binary, {INDEX}").write.option("compression", "zstd").parquet(path)


def read_media(spark: SparkSession, path: str) -> DataFrame:
    """The media column and its index, as stored."""
    return spark.read.schema(f"doc_id long, media binary, {INDEX}").parquet(path)


def features_of(media: DataFrame) -> DataFrame:
    """Digests of the stored bytes, read back by parsing them, and the features of the stored index, which parsing confirms."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "duration", "n_frames", "bad_frames"]

    def run(batches):
        for batch in batches:
            out = []
            for m, samples, rate, stored_offsets in zip(*(batch.column(c) for c in ("media", "duration_samples", "sample_rate", "frame_offsets"))):
                m, samples, rate, stored_offsets = m.as_py() or b"", samples.as_py(), rate.as_py(), stored_offsets.values.to_numpy() if stored_offsets.is_valid else np.zeros(0, np.int64)
                s = parse(m)
                payload, bad_units = payload_of(m, s)
                seconds = Fraction(samples or 0, rate or 1)
                kept = s.samples == samples and np.array_equal(np.array(s.offsets, np.int64), stored_offsets)
                feature = f"MPEG{s.first.version if s.first else 0}L{s.first.layer if s.first else 0};frames={len(stored_offsets)};table={(s.table or {}).get('frames', 0)};duration={seconds.numerator}/{seconds.denominator};offsets={zlib.crc32(stored_offsets.astype('<i8').tobytes()):08x};index={'kept' if kept else 'differs'};bad_crc={s.bad_crc};bad_units={bad_units};skipped={s.skipped}"
                n_bytes = s.tags.get("n_bytes", "")
                out.append((int(n_bytes) if re.fullmatch("[0-9]{1,18}", n_bytes) else 0, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature, float(seconds), len(stored_offsets), s.bad_crc + bad_units))
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 10, types))], names=names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, duration double, n_frames long, bad_frames long"
    return media.select("doc_id", "media", "duration_samples", "sample_rate", "frame_offsets").mapInArrow(run, schema)


def op3_mpeg(spark, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "media")
    write_media(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    drop_at_exit(spark, path)
    return features_of(read_media(spark, path))
