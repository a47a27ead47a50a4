import hashlib
import random
import zlib
from fractions import Fraction

from pyspark.sql import functions as F

from lakevec.llm import mpeg


def want(rows):
    out = []
    for doc_id, text in rows:
        raw = (text or "").encode()
        payload = raw + b"\xff" * ((-len(raw)) % 576 or (0 if raw else 576))
        out.append((-1 if doc_id is None else doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])))
    return sorted(out)


def test_stored_bytes_give_back_every_payload(spark, small_docs, edge_docs, no_docs, tmp_path):
    for n, docs in enumerate((small_docs, edge_docs, no_docs)):
        path = f"{tmp_path}/{n}"
        mpeg.write_media(docs, path)
        media = mpeg.read_media(spark, path)
        got = mpeg.features_of(media).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
        assert all("index=kept;bad_crc=0;bad_units=0;skipped=0" in r.feature and r.bad_frames == 0 and r.duration == r.n_frames * 1152 / 48000 for r in got)
        by_payload = {}
        for r in got:
            if r.n_bytes:
                assert by_payload.setdefault((r.payload_sha256, r.n_bytes), (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)
        stored = {r.media_sha256 for r in got}
        assert {hashlib.sha256(r.media).hexdigest() for r in media.collect()} == stored


def test_durations_and_offsets_are_stored(spark, edge_docs, tmp_path):
    mpeg.write_media(edge_docs, f"{tmp_path}/m")
    for r in mpeg.read_media(spark, f"{tmp_path}/m").select("duration_samples", "sample_rate", "frame_offsets", F.length("media").alias("n")).collect():
        assert r.sample_rate == 48000 and r.duration_samples == 1152 * len(r.frame_offsets)
        assert all(b - a == 672 for a, b in zip(r.frame_offsets, r.frame_offsets[1:])) and r.frame_offsets[-1] == r.n - 128 - 672


def test_any_media_is_indexed_and_wrong_indexes_are_seen(spark):
    whole = mpeg.encode(b"x" * 1152, 1100)
    rows = [(1, whole), (2, None), (3, b""), (4, b"no audio"), (None, whole[100:])]
    media = mpeg.index_media(spark.createDataFrame(rows, "doc_id long, media binary"))
    got = {r.doc_id: r for r in media.collect()}
    assert (got[1].duration_samples, len(got[1].frame_offsets), got[1].tags["n_bytes"]) == (2304, 2, "1100") and got[2].frame_offsets == got[3].frame_offsets == got[4].frame_offsets == []
    assert got[4].sample_rate is None and got[4].skipped == 8 and len(got[None].frame_offsets) == 2
    moved = media.withColumn("duration_samples", F.col("duration_samples") + 1)
    assert {r.doc_id: "index=kept" in r.feature for r in mpeg.features_of(moved).where("doc_id in (1, 4)").collect()} == {1: False, 4: False}


def test_resynchronises_after_damage():
    payload = random.Random(1).randbytes(576 * 20)
    whole = mpeg.encode(payload, len(payload))
    s = mpeg.parse(whole)
    assert len(s.offsets) == 20 and s.table["frames"] == 20 and s.table["bytes"] == 21 * 672 and len(s.table["seek"]) == 100
    assert s.duration == Fraction(20 * 1152, 48000) and mpeg.payload_of(whole, s) == (payload, 0) and s.tags == {"n_bytes": str(len(payload)), "TAG": "payload"}
    cut = s.offsets[7]
    s = mpeg.parse(whole[:cut] + b"\xff\xfa junk \xff" + whole[cut:])
    assert (len(s.offsets), s.skipped) == (20, 9)
    s = mpeg.parse(whole[: cut + 100] + whole[s.offsets[8] :])
    assert 18 <= len(s.offsets) <= 19 and s.duration == Fraction(len(s.offsets) * 1152, 48000)
    broken = bytearray(whole)
    broken[cut + 20] ^= 1  # in the protected side information
    s = mpeg.parse(bytes(broken))
    assert (s.bad_crc, len(s.offsets)) == (1, 19)
    broken = bytearray(whole)
    broken[cut + 300] ^= 1  # in the payload
    s = mpeg.parse(bytes(broken))
    assert (s.bad_crc, len(s.offsets)) == (0, 20) and mpeg.payload_of(bytes(broken), s) == (payload[: 576 * 7] + payload[576 * 8 :], 1)


def frame(head, rest, covered):
    """A protected frame: its header, CRC over ``covered`` bits, and the rest."""
    length = mpeg.header(head, 0).length
    crc = mpeg.crc16(head[2:] + rest, 16 + covered)
    return (head + crc.to_bytes(2, "big") + rest).ljust(length, b"\0")


def test_checksums_of_layers_one_and_two():
    one = [(b"\xff\xfe\xc4\x00", 256), (b"\xff\xfe\xc4\x50", 4 * (16 + 24)), (b"\xff\xfe\xc4\xc0", 128)]  # stereo, joint at 8, mono
    # Layer II mono 192 kbit/s at 48 kHz: 11 subbands of 4 bits, 12 of 3, 4 of 2; allocated are the first two and the last
    two = int("1111" "0001" + "0000" * 9 + "000" * 12 + "00" * 3 + "11", 2)
    rest = (two << 400 - 88).to_bytes(50, "big")
    for head, bits, body in [(h, b, random.Random(b).randbytes(50)) for h, b in one] + [(b"\xff\xfc\xa4\xc0", 88 + 6, rest)]:
        good = frame(head, body, bits)
        for flip, bad in ((None, 0), (6 + (bits - 1) // 8, 2), (6 + bits // 8 + 1, 0)):
            data = bytearray(good * 4)
            if flip:
                data[len(good) + flip] ^= 1 << (7 - (bits - 1) % 8)
                data[2 * len(good) + flip] ^= 1 << (7 - (bits - 1) % 8)
            s = mpeg.parse(bytes(data))
            assert (len(s.offsets) + s.bad_crc, s.bad_crc) == (4, bad), (head, flip)
    assert sum(mpeg.allocation_bits(mpeg.header(b"\xff\xfd\xa0\x00", 0))) == 44 + 36 + 14  # 96 kbit/s a channel at 44.1 kHz
    assert sum(mpeg.allocation_bits(mpeg.header(b"\xff\xf5\x80\x00", 0))) == 16 + 21 + 38


def test_vbri_tables_and_old_tags():
    silent = bytes(mpeg._HEAD).ljust(672, b"\0")
    table = b"VBRI" + b"".join(n.to_bytes(w, "big") for n, w in ((1, 2), (0, 2), (75, 2), (672 * 3, 4), (2, 4), (2, 2), (4, 2), (2, 2), (1, 2), (168, 2), (168, 2)))
    first = silent[:36] + table + silent[36 + len(table) :]
    first = first[:4] + mpeg.crc16(first[2:4] + first[6:38]).to_bytes(2, "big") + first[6:]
    s = mpeg.parse(first + silent * 2)
    assert s.table == {"bytes": 2016, "frames": 2, "frames_per_entry": 1, "seek": [672, 672]} and len(s.offsets) == 2
    v22 = b"TT2" + b"\0\0\x03" + b"\0Hi" + b"TXX" + b"\0\0\x06" + b"\0k\0val"
    v23 = b"".join((b"TIT2", b"\0\0\0\x07\0\0", b"\x01\xff\xfeH\0i\0"))
    tag = lambda v, flags, body: b"ID3" + bytes([v, 0, flags]) + mpeg._synchsafe(len(body)) + body
    assert mpeg.parse(tag(2, 0, v22) + silent * 2).tags == {"TT2": "Hi", "k": "val"}
    plain = mpeg.parse(tag(3, 0, v23) + silent * 2)
    loose = mpeg.parse(tag(3, 0x80, v23.replace(b"\xff", b"\xff\x00")) + silent * 2)
    assert plain.tags == loose.tags == {"TIT2": "Hi"} and len(plain.offsets) == len(loose.offsets) == 2
    extended = (6).to_bytes(4, "big") + bytes(6)
    assert mpeg.parse(tag(3, 0x40, extended + v23) + silent * 2).tags == {"TIT2": "Hi"}


def test_payloads_full_of_sync_words():
    payload = b"\xff\xfa\xb4\x00" * 144 * 3
    whole = mpeg.encode(payload, len(payload))
    assert mpeg.payload_of(whole, mpeg.parse(whole)) == (payload, 0)
    assert mpeg.parse(b"").offsets == [] and mpeg.parse(b"\xff" * 5000).offsets == [] and mpeg.parse(b"ID3").offsets == []


def test_headers():
    assert mpeg.header(b"\xff\xfb\x90\x00", 0).length == 417 and mpeg.header(b"\xff\xfb\x92\x00", 0).length == 418
    h = mpeg.header(b"\xff\xf3\x80\xc0", 0)
    assert (h.version, h.layer, h.bitrate, h.sample_rate, h.samples, h.length, h.side) == (2, 3, 64, 22050, 576, 208, 9)
    assert mpeg.header(b"\xff\xff\xc4\x00", 0).length == 12000 * 384 // 48000 * 4
    assert all(mpeg.header(x, 0) is None for x in (b"\xff\xfb\xf0\x00", b"\xff\xfb\x00\x00", b"\xff\xfb\x9c\x00", b"\xff\xe9\x90\x00", b"\xff\xf9\x90", b"\xfe\xfb\x90\x00"))
    assert mpeg.crc16(b"123456789") == 0xAEE7
