import random
import struct
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lakevec.llm import packing


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def checked(rows, texts, library, window=packing.WINDOW):
    """Every id of every text lies in one piece, pieces lie without gaps; returns (sequences, ids, padding)."""
    wanted, sequences = defaultdict(int), defaultdict(list)
    whole = [library.encode(t or "", add_special_tokens=False).ids + [packing.END_ID] for t in texts]
    crc = lambda ids: zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(by_doc) == set(range(len(texts)))
    for doc, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(whole[doc]) and r.ids_crc32 == crc(whole[doc][at : at + r.length])
            at += r.length
        assert at == len(whole[doc])
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
        wanted["ids"] += at
        wanted["padding"] += 0 if at & (at - 1) == 0 else window - at
    return len(sequences), wanted["ids"], wanted["padding"]


@pytest.mark.parametrize("parts", [1, 9, 70])
def test_whole_documents_in_few_windows(spark, library, parts, tmp_path):
    rng = random.Random(parts)
    texts = [" ".join(rng.choices(["alpha", "beta", "Ünï", "漢字", "x" * 30], k=int(rng.paretovariate(0.7)) % 6_000)) for _ in range(400)] + ["", None, "word " * 60_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts).withColumns({n: packing.F.lit(n) for n in ("ids", "start", "task", "closed")})
    windows = packing.pack(docs, str(tmp_path / "w"))
    sequences, ids, padding = checked(packing.pieces_of(windows).collect(), texts, library)
    assert padding < 0.01 * ids and sequences < ids / packing.WINDOW + 12
    told = packing.padding(windows).first()
    assert (told.sequences, told.ids, told.padding) == (sequences, ids, padding)


def test_few_windows_are_open_and_documents_stay_whole():
    """No more than the limit is held; most documents that fit into a window are not cut."""
    rng, packer, closed, cut, n = random.Random(1), packing.Packer(limit=16, window=256, least=8), 0, 0, 4_000
    for doc in range(n):
        length = rng.randint(1, 200)
        for unit in packer.put(packing.Unit(bytes(4 * length), [(doc, 0, length, length)])):
            closed += 1
            assert sum(p[2] for p in unit.pieces) == len(unit) > 256 - 2 * 8
            cut += sum(p[1] > 0 for p in unit.pieces)
        assert len(packer.sizes) == sum(map(len, packer.open.values())) <= 16 and packer.sizes == sorted(packer.sizes)
    assert cut < 0.2 * n and closed > 1_000


def test_best_fit_and_the_fullest():
    packer = packing.Packer(limit=2, window=100, least=10)
    unit = lambda doc, n: packing.Unit(bytes(4 * n), [(doc, 0, n, n)])
    assert not [*packer.put(unit(0, 70))] and not [*packer.put(unit(1, 50))]
    assert not [*packer.put(unit(2, 20))] and packer.sizes == [50, 90]  # into the one that it leaves the least room in
    (full,) = packer.put(unit(3, 60))  # fits nowhere: the fullest goes, its room of 10 filled by the head
    assert full.pieces == [(0, 0, 70, 70), (2, 0, 20, 20), (3, 0, 10, 60)] and packer.sizes == [50, 50]
    assert [len(u) for u in packer.put(unit(4, 230))] == [100, 100] and packer.sizes == [50, 80]
    (full,) = packer.put(unit(5, 50))
    assert [p[0] for p in full.pieces] == [3, 5]
    assert [len(u) for u in packer.finish()] == [64, 16]
    packer = packing.Packer(limit=1, window=100, least=10)
    assert not [*packer.put(unit(0, 40))]
    (full,) = packer.put(unit(1, 65))  # a little too long for the room of 60: what is left is no shorter than the least piece
    assert [p[2] for p in full.pieces] == [40, 55] and packer.sizes == [10]


def test_leftovers_of_many_tasks_meet_in_rounds(spark, library, tmp_path, monkeypatch):
    monkeypatch.setattr(packing, "MERGED", 3)
    texts = [f"document {k} " * (k % 40) for k in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(20)
    windows = packing.pack(docs, str(tmp_path / "w"), window=64, open_windows=4)
    assert len(list((tmp_path / "w").iterdir())) >= 4  # 20 tasks, 7, 3, 1
    _, ids, padding = checked(packing.pieces_of(windows).collect(), texts, library, 64)
    assert padding < 0.25 * ids  # windows of 64 ids, of which up to 15 stay empty


def test_edge_rows(spark, edge_docs, no_docs, library, tmp_path):
    rows = packing.pieces_of(packing.pack(edge_docs, str(tmp_path / "a"))).collect()
    want = {}
    for r in edge_docs.collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + len(library.encode(r.text or "", add_special_tokens=False).ids) + 1
    got = defaultdict(int)
    for r in rows:
        got[r.doc_id] += r.length
    assert got == want
    assert packing.pieces_of(packing.pack(no_docs, str(tmp_path / "b"))).count() == 0
