import io
import re
import time
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from lakevec.errors import Validation
from lakevec.operators import chunks, ingest
from lakevec.sources import files
from lakevec.streaming.ingest import ingest as stream_ingest


def plain_sentences(text, limit):
    out, held = [], ""
    for s in re.split(r"(?<=[.!?])\s+", text):
        s = s.strip(" ")
        for piece in [s[i : i + limit].strip(" ") for i in range(0, len(s), limit)]:
            if held and len(held) + 1 + len(piece) <= limit:
                held += " " + piece
            else:
                out, held = out + [held] if held else out, piece
    return out + [held] if held else out


def docs(spark, *texts):
    return spark.createDataFrame([(f"/d/{i}.txt", t) for i, t in enumerate(texts)], "source string, text string")


def test_fixed_windows(spark):
    text = "lorem ipsum " * 800
    got = chunks.chunk_fixed(docs(spark, text, "", "short"), 100, 20).orderBy("source", "chunk_idx").collect()
    own = [r for r in got if r.source == "/d/0.txt"]
    assert len(own) >= 5 and [r.chunk_idx for r in own] == list(range(len(own))) and all(own[i].chunk == text[i * 320 : i * 320 + 400].strip(" ") for i in range(len(own)))
    assert own[-1].chunk.endswith("ipsum") and [r.chunk for r in got if r.source != "/d/0.txt"] == ["short"]
    for bad in ((0, 0), (10, 10), (10, -1)):
        with pytest.raises(Validation):
            chunks.chunk_fixed(docs(spark, "a"), *bad)


def test_sentences_equal_a_plain_version(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(-1, "Alpha bravo. Charlie delta echo. Foxtrot golf. " * 200), (-2, "x" * 1000), (-3, "")], "doc_id long, text string"))
    got = {}
    for r in chunks.chunk_sentence(d, 60).orderBy("doc_id", "chunk_idx").collect():
        got.setdefault(r.doc_id, []).append(r.chunk)
    assert got == {r.doc_id: plain_sentences(r.text, 240) for r in d.collect() if r.text}
    assert len(got[-1]) > 5


def test_markdown(spark):
    text = "intro\n# Top\na\n## Methodology\n" + "word " * 600 + "\n```\n# no heading\n```\n## Results\nb\nTitle\n=====\nc"
    got = chunks.chunk_markdown(docs(spark, text), 100, 20).orderBy("chunk_idx").collect()
    paths = [r.section_path for r in got]
    assert [r.chunk_idx for r in got] == list(range(len(got))) and paths[0] == [] and paths[1] == ["Top"] and ["Top", "Methodology"] in paths and ["Top", "Results"] in paths and paths[-1] == ["Title"]
    assert chunks.headings("# A\n## B\n### C") == [(0, 1, "A"), (4, 2, "B"), (9, 3, "C")]
    assert chunks.headings("#no\n####### seven\n\n---\n") == []


def test_windows_end_at_words(spark):
    text = " ".join(f"word{n}" for n in range(500)) + " " + "x" * 900
    got = [r.chunk for r in chunks.chunk_fixed(docs(spark, text), 50, 20, back_off=128).orderBy("chunk_idx").collect()]
    plain = [text[k : k + 200] for k in range(0, len(text) - 80, 120)]
    want = []
    for k, p in enumerate(plain):
        cut = re.match(r"(?s)(.*\s)\S{1,80}\Z", p)
        want.append((cut[1] if cut and text[k * 120 + 200 : k * 120 + 201].strip() else p).strip(" "))
    assert got == [w for w in want if w] and any(w != p.strip(" ") for w, p in zip(want, plain))


def test_sentence_packing_is_linear():
    began = time.time()
    assert len(chunks.packed_sentences("Ab cd. " * 400_000, 1600)) > 1000 and time.time() - began < 5


def test_pdf_inline_and_samples(spark, tmp_path):
    page = lambda body, compress: (b"<< /Length %d%s >>\nstream\n" % (len(body), b" /Filter /FlateDecode" * compress)) + (zlib.compress(body) if compress else body) + b"\nendstream\n"
    body = b"%PDF-1.4\n1 0 obj\n" + page(b"BT /F1 12 Tf (A plain \\(first\\) page) Tj 0 -14 Td [(spl) -20 (it) -300 (word)] TJ ET", False) + page(b"BT (second \\351) Tj ET", True) + page(b"q 1 0 0 1 0 0 cm Q", True) + b"%%EOF"
    (tmp_path / "a.pdf").write_bytes(body)
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4 /Encrypt 1 0 R")
    (tmp_path / "c.pdf").write_bytes(b"not one")
    got = {r.source[-5]: (r.kind, r.text, r.failed, r.reason) for r in files.parse_files(files.read_files(spark, str(tmp_path))).collect()}
    assert got["a"] == ("pdf", "A plain (first) page split word\fsecond é", False, None)
    assert got["b"][1:3] == got["c"][1:3] == (None, True) and "encrypted" in got["b"][3] and "header" in got["c"][3]
    one = ingest.embedded(files.inline(spark, "some text"), "off", "path", 8).first()
    assert one.key == "<text-value>#0" and len(one.vec) == 8
    rows = spark.range(2000)
    sample = {r.id for r in files.sampled(rows, F.col("id"), 0.1, 3).collect()}
    assert sample == {r.id for r in files.sampled(rows.repartition(7), F.col("id"), 0.1, 3).collect()} and 140 < len(sample) < 260
    assert sample != {r.id for r in files.sampled(rows, F.col("id"), 0.1, 4).collect()}


def test_keys_metadata_and_stub(spark):
    d = docs(spark, "hello", "world", "hello")
    row = chunks.chunk_off(d).withColumn("k", chunks.content_key(F.col("source"), F.col("chunk_idx"), F.col("chunk"))).withColumn("e", chunks.embed_stub(F.col("chunk"), 64)).withColumn("f", chunks.file_key(F.col("source"), F.col("chunk_idx"))).withColumn("m", chunks.merged_metadata(chunks.metadata(F.col("source"), F.col("chunk_idx"), F.col("chunk")), {chunks.META_SOURCE: "mine"})).orderBy("source").collect()
    assert len({r.k for r in row}) == 3 and all(len(r.k) == 32 for r in row) and row[1].f == "1.txt#0"
    assert row[0].e == row[2].e != row[1].e and abs(sum(x * x for x in row[0].e) - 1) < 1e-9 and len(row[0].e) == 64
    assert '"mine"' in row[0].m and all(n in row[0].m for n in (chunks.META_CONTENT, chunks.META_INDEX, chunks.META_HASH))
    got = [r.n for r in docs(spark, "", "a", "abcd", "abcde").orderBy("source").select(chunks.token_estimate(F.col("text")).alias("n")).collect()]
    assert got == [0, 1, 1, 2]


def office(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "in" / "sub"
    d.mkdir(parents=True)
    (d.parent / "a.txt").write_text("lorem ipsum dolor sit amet " * 800)
    (d.parent / "b.md").write_text("# Top\ntext\n## Part\nmore")
    (d / "c.HTML").write_text("<h1>Hi</h1><p>there <b>world</b></p><script>no()</script>")
    (d / "skip.bin").write_bytes(b"\0\1")
    (d / "e.docx").write_bytes(office({"word/document.xml": "<w><p>Spark</p><p>paragraph</p></w>"}))
    (d / "f.pptx").write_bytes(office({f"ppt/slides/slide{n}.xml": f"<s><t>slide {n}</t></s>" for n in (1, 2, 10)}))
    (d / "g.xlsx").write_bytes(office({"xl/workbook.xml": '<w><sheets><sheet name="Data"/></sheets></w>', "xl/sharedStrings.xml": "<sst><si><t>shared</t></si></sst>", "xl/worksheets/sheet1.xml": '<s><c t="s"><v>0</v></c><c><v>7</v></c><c t="inlineStr"><is><t>inline</t></is></c></s>'}))
    (d / "bad.docx").write_bytes(b"not a zip")
    return str(d.parent)


def test_files(spark, folder):
    found = files.read_files(spark, folder)
    parsed = {r.source.rpartition("/")[2]: r for r in files.parse_files(found).collect()}
    assert set(parsed) == {"a.txt", "b.md", "c.HTML", "e.docx", "f.pptx", "g.xlsx", "bad.docx"} and [n for n, r in parsed.items() if r.failed] == ["bad.docx"]
    assert parsed["c.HTML"].text == "Hi there world" and parsed["e.docx"].text == "Spark paragraph" and parsed["f.pptx"].text == "slide 1\nslide 2\nslide 10" and parsed["g.xlsx"].text == "# Data\nshared\ninline"
    assert {r.ext for r in files.eligible(found, 1000, exclude=[".BIN"]).collect()} == {"md", "html", "docx", "pptx", "xlsx"}
    ledger = found.where("ext = 'txt'").select("source", "content_hash", F.lit("done").alias("status"))
    assert files.not_done(found, ledger).count() == found.count() - 1


def test_files_are_parsed_by_slices(monkeypatch):
    """What a task takes beside a batch of 40 MB is some slices; rows, nulls and files larger than a slice come as one by one."""
    import tracemalloc

    import pyarrow as pa

    def batch(contents):
        columns = [[f"s{i}" for i in range(len(contents))], ["txt", "html"] * (len(contents) // 2), contents, [f"h{i}" for i in range(len(contents))]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.binary(), pa.string()))], names=["source", "ext", "content", "content_hash"])

    large, texts = batch([b"some words \xe9 " * 300] * 10_000), 0
    tracemalloc.start()
    for part in files._parse(iter([large])):
        texts += part.num_rows
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert texts == 10_000 and most < 6 * files.SLICE_BYTES
    monkeypatch.setattr(files, "SLICE_BYTES", 8)
    odd = [b"ab", b"<p>c</p>", b"long as nothing else", None, b"", b"<b>x"]
    parts = list(files._parse(iter([batch([]), batch(odd)])))
    assert len(parts) == 4 and [tuple(r.values()) for p in parts for r in p.to_pylist()] == [(f"s{i}", *files.parsed(e, c)[:2], f"h{i}", *files.parsed(e, c)[2:]) for i, (e, c) in enumerate(zip(["txt", "html"] * 3, odd))]


def test_counts_do_not_depend_on_slices(spark, folder):
    """Every file in a slice of its own gives the rows of the default size."""
    parsed = files.parse_files(files.read_files(spark, str(folder)))
    batches = parsed.select("source", "text", "failed").toArrow()
    rows = files.read_files(spark, str(folder)).where(F.col("ext").isin(*files.KNOWN)).select("source", "ext", "content", "content_hash").toArrow().to_batches()
    saved, files.SLICE_BYTES = files.SLICE_BYTES, 1
    try:
        parts = list(files._parse(iter(rows)))
    finally:
        files.SLICE_BYTES = saved
    one = {(r["source"], r["text"], r["failed"]) for p in parts for r in p.to_pylist()}
    assert all(p.num_rows == 1 for p in parts) and one == {tuple(r.values()) for r in batches.to_pylist()} and len(one) == sum(p.num_rows for p in parts)


def test_pipeline_query_and_stats(spark, folder):
    parsed = files.parse_files(files.read_files(spark, folder))
    tried = ingest.attempted(parsed, "fixed", "path", 64, size=100, overlap=20)
    row = ingest.stats(parsed, tried).first()
    assert (row.raw, row.parsed, row.parse_failures, row.embed_failures) == (7, 6, 1, 0) and row.chunks == row.embedded == row.put > 6
    assert ingest.stats(parsed, tried, tried.limit(3)).first().put == 3 and {r.status for r in ingest.ledger(parsed, tried).collect()} == {"done"}
    named = ingest.embedded(docs(spark, "alpha", "beta", "gamma"), "off", "filename", 32, user_metadata={"team": "x"})
    top = ingest.text_query(named, "alpha", 3, 32).collect()
    assert top[0].snippet == "alpha" and top[0].distance < 1e-6 and len(top) == 3
    assert ingest.text_query(named, "alpha", 3, 32, where={"team": "y"}).count() == 0


def test_stream_resumes(spark, tmp_path, folder):
    run = lambda: stream_ingest(spark, folder, f"{tmp_path}/out", f"{tmp_path}/ck", chunker="off", key="path", dimension=16).awaitTermination()
    run()
    first = spark.read.parquet(f"{tmp_path}/out").count()
    with open(f"{folder}/new.txt", "w") as f:
        f.write("one more")
    run()
    run()
    keys = [r.key for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert first == 6 and len(keys) == len(set(keys)) == 7


class Provider(ingest.EmbeddingProvider):
    name, dimension, max_batch = "lengths", 2, 2

    def embed(self, texts):
        return [[len(t), 1.0] for t in texts if t != "drop"]


def test_provider_and_retry(spark):
    got = ingest.embedded(docs(spark, "a", "bb", "ccc").coalesce(1), "off", "path", embed=ingest.embed_with(Provider())).collect()
    assert sorted(r.vec[0] for r in got) == [1, 2, 3]
    assert ingest.embedded(docs(spark, "drop"), "off", "path", embed=ingest.embed_with(Provider())).count() == 0
    parsed = docs(spark, "a", "bb", "drop", "ccc", "").coalesce(1).selectExpr("*", "md5(text) as content_hash", "false as failed")
    tried = ingest.attempted(parsed, "off", "path", embed=ingest.embed_with(Provider()))
    row = ingest.stats(parsed, tried).first()
    assert (row.raw, row.chunks, row.embedded, row.embed_failures, row.put) == (5, 4, 2, 2, 2)  # the batch with "drop" fails as a whole
    kept = {r.source[-5]: (r.chunks, r.puts, r.status) for r in ingest.ledger(parsed, tried).collect()}
    assert kept == {"0": (1, 1, "done"), "1": (1, 1, "done"), "2": (1, 0, "partial"), "3": (1, 0, "partial"), "4": (0, 0, "done")}
    assert {r.source[-5] for r in files.not_done(parsed, ingest.ledger(parsed, tried)).collect()} == {"2", "3"}
    lost = {r.source[-5]: r.status for r in ingest.ledger(parsed, tried, tried.where("source like '%0.txt'")).collect()}
    assert lost["0"] == "done" and lost["1"] == "partial"
    with pytest.raises(Exception, match="length 3"):
        ingest.put(tried, 3).where("vec is not null").collect()
    calls, waits = [], []
    def flaky():
        calls.append(1)
        if len(calls) < 4:
            raise OSError
        return "ok"

    assert ingest.with_retry(flaky, sleep=waits.append) == "ok" and len(waits) == 3 and waits[2] >= 1.0
    with pytest.raises(ZeroDivisionError):
        ingest.with_retry(lambda: 1 / 0, attempts=2, sleep=lambda s: None)
