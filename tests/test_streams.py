import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lakevec.sources import files, tables
from lakevec.streaming import ledger

START = datetime(2024, 1, 1)


@pytest.fixture
def feed(spark, tmp_path):
    """Write rows as one file of a folder; read the folder as a stream, one file a batch."""

    class Feed:
        def __init__(self, name, schema):
            self.folder, self.schema, self.n = tmp_path / name, schema, 0
            self.folder.mkdir()

        def add(self, *rows):
            names = [x.split()[0] for x in self.schema.split(", ")]
            lines = [json.dumps({k: (START + timedelta(minutes=v)).isoformat() if k.endswith("at") else v for k, v in zip(names, r) if v is not None}) for r in rows]
            self.n += 1
            path = self.folder / f"{self.n:04d}.json"
            path.write_text("\n".join(lines))
            os.utime(path, (1_700_000_000 + self.n,) * 2)  # batches in this order

        def stream(self):
            return spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).json(str(self.folder))

        def table(self):
            return spark.read.schema(self.schema).json(str(self.folder))

    return Feed


def run(df, out, check):
    q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def test_documents_are_sealed_across_restarts(spark, feed, tmp_path):
    puts = feed("puts", "source string, content_hash string, chunks int, chunk_idx int, at timestamp")
    again = lambda: run(ledger.ledger_stream(puts.stream(), "10 minutes", 600_000), f"{tmp_path}/out", f"{tmp_path}/ck")
    records = lambda: sorted((r.source, r.chunks, r.puts, r.status) for r in spark.read.schema(ledger.RECORDS).parquet(f"{tmp_path}/out").collect())
    puts.add(("a", "h1", 3, None, 0), ("a", "h1", None, 0, 1), ("b", "h1", 0, None, 0), ("late", "h1", 2, 0, 1))
    again()
    assert records() == [("b", 0, 0, "done")]
    puts.add(("a", "h1", None, 0, 2), ("a", "h1", None, 1, 2))  # the first put again, in another run
    again()
    assert records() == [("b", 0, 0, "done")]
    puts.add(("a", "h1", None, 2, 3), ("c", "h1", None, 1, 3), ("c", "h1", 1, None, 4))
    again()
    assert records() == [("a", 3, 3, "done"), ("b", 0, 0, "done"), ("c", 1, 1, "done")]
    puts.add(("a", "h1", None, 2, 5), ("d", "h1", 1, 0, 60))  # a sealed document again; time goes on
    puts.add(("e", "h1", 1, 0, 61))
    puts.add(("f", "h1", 5, 0, 120))
    puts.add(("a", "h2", 1, 0, 121))  # a new content of a known document
    again()
    assert records() == sorted([("a", 1, 1, "done"), ("a", 3, 3, "done"), ("b", 0, 0, "done"), ("c", 1, 1, "done"), ("d", 1, 1, "done"), ("e", 1, 1, "done"), ("late", 2, 1, "partial")])


def test_stream_joins_equal_the_batch_answer(spark, feed, tmp_path):
    """Events that come twice and late, in a replay of several batches."""
    clicks, buys = feed("clicks", "user_id int, click_id int, click_at timestamp"), feed("buys", "user_id int, buy_id int, buy_at timestamp")
    for k in range(4):
        clicks.add(*((u, 100 * k + u, 30 * k + u) for u in range(5)), *(((0, 1000 + k, 30 * k - 20),) if k else ()))
        buys.add(*((u, 100 * k + u, 30 * k + 2 * u) for u in range(5)), *((u, 100 * k + u, 30 * k + 2 * u) for u in range(2)))
    both = lambda a, b: ledger.interval_join(a, ledger.once(b, ["buy_id"], "buy_at", "2 hours"), ["user_id"], "click_at", "buy_at", "25 minutes", "2 hours")
    run(both(clicks.stream(), buys.stream()), f"{tmp_path}/o", f"{tmp_path}/c")
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/o").collect()))
    want = sorted(map(tuple, both(clicks.table(), buys.table()).collect()))
    assert got == want and len(want) > 20 and len(set(want)) == len(want)


def test_rows_after_the_watermark_are_counted(feed, tmp_path):
    rows = feed("rows", "id int, at timestamp")
    for k in range(3):
        rows.add((k, 100 * k), (50 + k, 100 * k + 1))
    rows.add((99, 0), (98, 1), (97, 300))
    q = run(ledger.once(rows.stream(), ["id"], "at", "10 minutes"), f"{tmp_path}/o", f"{tmp_path}/c")
    assert ledger.late_rows(q) == 2


def test_packed_files_are_bounded(spark, monkeypatch):
    import io
    import zipfile
    import zlib

    monkeypatch.setattr(files, "MAX_UNPACKED_BYTES", 1_000_000)
    big = b"<w>" + b"word " * 600_000 + b"</w>"
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", big)
    slides = io.BytesIO()
    with zipfile.ZipFile(slides, "w", zipfile.ZIP_DEFLATED) as z:
        for n in range(3):
            z.writestr(f"ppt/slides/slide{n}.xml", b"<a>" + b"x" * 400_000 + b"</a>")
    pdf = b"%PDF-1.4\n<< /Filter /FlateDecode >>\nstream\n" + zlib.compress(b"BT (text) Tj ET " * 200_000) + b"\nendstream\n"
    for call in (lambda: files.office_text(packed.getvalue(), "docx"), lambda: files.office_text(slides.getvalue(), "pptx"), lambda: files.pdf_text(pdf)):
        with pytest.raises(ValueError, match="more than 1000000 bytes"):
            call()
    monkeypatch.setattr(files, "MAX_UNPACKED_BYTES", 100 << 20)
    assert files.office_text(packed.getvalue(), "docx").startswith("word word") and files.pdf_text(pdf).startswith("text text")


def test_csv_in_pieces_and_rejected_values(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("id,name\n" + "\n".join(f"{n if n % 100 else 'none'},name {n}" for n in range(20_000)))
    fields = [{"name": "id", "type": "int"}, {"name": "name", "type": "string"}]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        split = tables.read_csv(spark, str(path), fields, multi_line=False, rejects="bad")
        assert split.rdd.getNumPartitions() > 3 and tables.read_csv(spark, str(path), fields).rdd.getNumPartitions() == 1
        assert split.where(F.array_contains("bad", "id")).count() == 200 and split.where(F.size("bad") == 0).count() == 19_800
        assert sorted(split.drop("bad").collect(), key=str) == sorted(tables.read_csv(spark, str(path), fields).collect(), key=str)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
