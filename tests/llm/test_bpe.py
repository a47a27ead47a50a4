import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from lakevec.llm import bpe, planes


@pytest.fixture(scope="module")
def plain():
    with open(public_tokenizers.path(bpe.RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(planes.VOCABULARY))


def key(i):
    return -1 if i is None else i


def digests(rows, plain):
    out = []
    for doc_id, text in rows:
        ids = plain.encode_ordinary(text or "")
        out.append((key(doc_id), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out)


def test_round_trips(small_docs, edge_docs, no_docs, plain):
    for docs in (small_docs, edge_docs):
        got = sorted((key(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trips(docs).collect())
        assert got == digests([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], plain)
    assert bpe.round_trips(no_docs).count() == 0


def test_odd_strings_as_both_libraries_encode_them(plain, library):
    random.seed(2)
    parts = ["a", "e", " ", "  ", "\n", "\t", "-", "=", "é", "漢", "🙂", "'s", "1", "aa", "---", " ", "　", "\x1c", "th", "the", "<|endoftext|>", ".", " x", "\r\n", "ß", "'ll", "́", "​"]
    ranks, merges = bpe.codec(public_tokenizers.path(bpe.RANKS)), bpe.codec(public_tokenizers.path(planes.VOCABULARY))
    for _ in range(3000):
        text = "".join(random.choices(parts, k=random.randint(0, 40)))
        assert np.frombuffer(ranks.encode(text), "<u4").tolist() == plain.encode_ordinary(text), repr(text)
        assert np.frombuffer(merges.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_memory_limit_changes_nothing(plain, small_docs):
    c = bpe.Codec(public_tokenizers.path(bpe.RANKS))
    for table in (c.match, c.piece, c.spaced):
        table.limit = 50
    for r in small_docs.limit(20).collect():
        assert np.frombuffer(c.encode(r.text), "<u4").tolist() == plain.encode_ordinary(r.text)
        assert max(len(t) + len(t.old) for t in (c.match, c.piece, c.spaced)) <= 100


def test_offsets(edge_docs):
    for r in bpe.encoded(edge_docs.where("doc_id = 6"), offsets=True).collect():
        text = edge_docs.where("doc_id = 6").first().text
        c = bpe.codec(public_tokenizers.path(bpe.RANKS))
        for i, a, b in zip(r.ids, r.starts, r.ends):
            assert c.tokens[i] in text[a:b].encode()
        assert r.starts[0] == 0 and r.ends[-1] == len(text) and r.starts == sorted(r.starts)


def test_offsets_equal_a_plain_count(spark, edge_docs, plain):
    rows = [(1, "漢字 é🙂 <|endoftext|> ̈x"), (2, "plain words"), (3, ""), (4, None), (5, "🧬🧬 \u200b\U000e0001"), *((r.doc_id, r.text) for r in edge_docs.select("doc_id", "text").collect())]
    want = []
    for doc_id, text in rows:
        place = [k for k, c in enumerate(text or "") for _ in c.encode()]
        ends = {len(text[: k + 1].encode()) for k in range(len(text or ""))} | {0}
        spans, at, split = [], 0, 0
        for i in plain.encode_ordinary(text or ""):
            n = len(plain.decode_single_token_bytes(i))
            spans.append((place[at], place[at + n - 1] + 1))
            split += at not in ends or at + n not in ends
            at += n
        want.append((key(doc_id), zlib.crc32(np.array(spans, "<i4").tobytes()), split))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((key(r.doc_id), r.offsets_crc32, r.split_tokens) for r in bpe.round_trips(docs, with_offsets=True).collect())
    assert got == sorted(want) and any(n for _, _, n in got)


def test_added_tokens_are_those_of_the_library(spark, library, tmp_path):
    rows = [(n, t) for n, t in enumerate(["<|endoftext|>", " a <|endoftext|>  <|endoftext|>b", "x" * 500 + " <|endoftext|> " + "y z " * 300, "<|endoftext", "<|endoftext|><|endoftext|>", "  <|endoftext|>\n\n"])]
    path = f"{tmp_path}/ids"
    planes.write_ids(spark.createDataFrame(rows, "doc_id long, text string"), path)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in planes.documents_in(spark, path).collect()) == layout(rows, library)
    c = bpe.codec(public_tokenizers.path(planes.VOCABULARY))
    assert all(c.decode(np.frombuffer(c.encode(t), "<u4")).decode() == t for _, t in rows)


def test_rows_of_one_id_fill_several_shards(spark, library, tmp_path):
    rows = [(None, f"{n % 900} some text") for n in range(2000)]
    path = f"{tmp_path}/ids"
    planes.write_ids(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), path, chunk_ids=256)
    got = sorted((-1, r.start, r.n_tokens, r.ids_crc32) for r in planes.documents_in(spark, path).collect())
    assert got == layout(rows, library) and spark.read.parquet(path).select("shard").distinct().count() > 3


def layout(rows, library):
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (key(r[0]), r[1] is not None, r[1] or "")):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((key(doc_id), start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return sorted(out)


@pytest.mark.parametrize("bits, chunk", [(8, 1 << 16), (1, 1000)])
def test_files_give_back_every_document(spark, small_docs, edge_docs, no_docs, library, tmp_path, bits, chunk):
    for n, docs in enumerate((small_docs, edge_docs, no_docs)):
        path = f"{tmp_path}/{n}"
        planes.write_ids(docs, path, plane_bits=bits, chunk_ids=chunk)
        got = sorted((key(r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in planes.documents_in(spark, path).collect())
        assert got == layout([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], library)


def test_stored_ids_read_back(spark, small_docs, library, tmp_path):
    path = f"{tmp_path}/ids"
    planes.write_ids(small_docs.limit(30), path, chunk_ids=512)
    got = {}
    for r in sorted(planes.read_ids(spark, path).collect(), key=lambda r: (r.doc_id, r.before)):
        got.setdefault(r.doc_id, []).extend(r.ids)
    assert got == {r.doc_id: library.encode(r.text, add_special_tokens=False).ids + [2] for r in small_docs.limit(30).collect()}


def test_planes_and_crc():
    rng = np.random.default_rng(1)
    for ids in (np.zeros(0, np.uint32), np.zeros(5, np.uint32), rng.integers(0, 2**32, 1001, dtype=np.uint32), rng.integers(0, 50257, 70000, dtype=np.uint32)):
        for bits in (1, 8):
            data, ends = planes.pack(ids, bits)
            assert (planes.unpack(data, ends, len(ids), bits) == ids).all()
    for n in (0, 1, 5, 70000):
        a, b = b"abc" * 99, rng.bytes(n)
        assert planes.crc32_combine(zlib.crc32(a), zlib.crc32(b), n) == zlib.crc32(a + b)


def test_long_texts_in_blocks_and_forgotten_tables(monkeypatch, plain):
    monkeypatch.setattr(bpe, "BLOCK", 40)
    c = bpe.Codec(public_tokenizers.path(bpe.RANKS), 20)
    for text in ["word " * 50, "a  b\n c" * 60, " lead and trail " * 9, "été, naïve 漢字 1234. " * 30, "x" * 500, " " * 90]:
        assert np.frombuffer(c.encode(text), "<u4").tolist() == plain.encode_ordinary(text)
        c.forget()
        assert not c.spaced and not c.spaced.old
