import pytest
from pyspark.errors import AnalysisException

from lakevec.operators import chunks
from lakevec.plans import udtf
from lakevec.sources import files


@pytest.fixture(scope="module")
def door(spark, sf_dir):
    udtf.register(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", "if(doc_id % 50 = 0, null, text) AS text", "'old' AS chunk")
    md = docs.selectExpr("doc_id", "concat('# Doc ', doc_id, '\\n', replace(text, '\\n', '\\n## Part\\n')) AS text")
    docs.createOrReplaceTempView("udtf_docs")
    md.createOrReplaceTempView("udtf_md")
    return docs, md


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize(
    ("call", "same"),
    [
        ("'fixed', 100, 20", lambda d: chunks.chunk_fixed(d, 100, 20)),
        ("'off'", chunks.chunk_off),
        ("'sentence', 60", lambda d: chunks.chunk_unicode_sentence(d, 60)),
        ("'stops', 60", lambda d: chunks.chunk_sentence(d, 60)),
    ],
)
def test_chunks_equal_the_operators(spark, door, call, same):
    found = spark.sql(f"SELECT * FROM chunk(TABLE(udtf_docs), {call if ',' not in call or 'fixed' in call else call + ', 0'})")
    assert found.columns == ["doc_id", "text", "chunk_idx", "chunk"]
    assert rows(found, "doc_id", "chunk_idx", "chunk") == rows(same(door[0].drop("chunk")), "doc_id", "chunk_idx", "chunk")


def test_markdown_sentences_and_joins(spark, door):
    found = spark.sql("SELECT * FROM chunk(TABLE(udtf_md), 'markdown', 200, 40)")
    assert rows(found, "doc_id", "chunk_idx", "chunk", "section_path") == rows(chunks.chunk_markdown(door[1], 200, 40), "doc_id", "chunk_idx", "chunk", "section_path")
    joined = spark.sql("SELECT d.doc_id, count(*) AS n FROM sentences(TABLE(SELECT doc_id, text FROM udtf_docs)) s JOIN udtf_docs d USING (doc_id) WHERE s.sentence_idx > 0 GROUP BY 1")
    assert all(r.n > 0 for r in joined.collect()) and joined.count() > 50


def test_refusals(spark, door):
    for call in ("chunk(TABLE(udtf_docs), 'none')", "chunk(TABLE(udtf_docs), 'fixed', 10, 10)", "chunk(TABLE(SELECT 1 AS a))", "sentences(TABLE(SELECT 1 AS a))", "chunk('text')"):
        with pytest.raises(AnalysisException):
            spark.sql(f"SELECT * FROM {call}").collect()


def test_empty_tables(spark, door):
    assert spark.sql("SELECT * FROM chunk(TABLE(SELECT * FROM udtf_docs WHERE false))").collect() == []


def test_parse(spark, door, tmp_path):
    (tmp_path / "a.html").write_text("<p>One</p><p>Two</p>")
    (tmp_path / "b.pdf").write_bytes(b"not one")
    (tmp_path / "c.bin").write_bytes(b"\0")
    (tmp_path / "d.txt").write_text("Plain.")
    found = files.read_files(spark, str(tmp_path))
    found.createOrReplaceTempView("udtf_files")
    names = ("source", "kind", "text", "content_hash", "failed", "reason")
    assert rows(spark.sql("SELECT * FROM parse(TABLE(udtf_files))"), *names) == rows(files.parse_files(found), *names)
