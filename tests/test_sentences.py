import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakevec.functions.sentences import sentences, split_sentences, unicode_sentences
from lakevec.operators import chunks


@pytest.mark.parametrize(
    "parts",
    [
        ["He left. ", "She stayed."],
        ["the resp. leaders are"],
        ["Mr. ", "Smith came. ", "He sat."],
        ["Version 3.4 of c.d and U.S.A. goods"],
        ["3.", "Next"],
        ["etc.)’ ‘(the next"],
        ["“Go.” ", "‘He did.’"],
        ["(How do you do?) ", "Well"],
        ["He said, “Stop!” ", "Then he left"],
        ["What?! ", "Yes"],
        ["Wait... ", "Now"],
        ["One. 1, 2 and 3"],
        ["To be, e.g. , sure"],
        ["それはペンです。", "これは本です。"],
        ["他说：“好。”", "然后走了。"],
        ["यह है। ", "वह है।"],
        ["สวัสดีครับ ผมชื่อ"],
        ["a\r\n", "b\n", "\n", "c"],
        ["End.\n", "small start"],
        ["Ab.́ ", "C"],
        ["é.X is one"],
        [],
    ],
)
def test_boundaries(parts):
    assert split_sentences("".join(parts)) == parts


def test_sentences_without_words_are_left_out():
    assert unicode_sentences("One. *** !!! Two.\n\n---\n42") == ["One. ", "Two.\n", "42"]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aB1.!?,) \n\ŕ。”éا(", max_size=40))
def test_nothing_is_lost_and_line_breaks_always_end(text):
    parts = split_sentences(text)
    assert "".join(parts) == text and all(parts)
    assert all("\n" not in p[:-1] for p in parts)


@pytest.mark.parametrize("text", [". " * 200_000, ")" * 400_000, "." * 400_000, "1" * 400_000 + ".", (". " + "1, " * 20) * 15_000, "a" + "́" * 400_000 + ".B", "a.́B" * 80_000, ". " + " (" * 200_000])
def test_time_is_linear(text):
    began = time.time()
    split_sentences(text)
    assert time.time() - began < 3


def test_packing(spark):
    limit = 40
    assert chunks.packed_whole(["One two. ", "Three. ", "x" * 90, "Four."], limit) == ["One two. Three.", "x" * 40, "x" * 40, "x" * 10, "Four."]
    assert chunks.packed_whole([], limit) == chunks.packed_whole(["  "], limit) == []
    docs = spark.createDataFrame([("a", "One. Two e.g. three. これは。本です。", 1), ("b", None, 2), ("c", "", 3), ("d", "...", 4)], "source string, text string, extra int")
    got = [(r.source, r.chunk_idx, r.chunk, r.extra) for r in chunks.chunk_unicode_sentence(docs, 3).orderBy("source", "chunk_idx").collect()]
    assert got == [("a", 0, "One.", 1), ("a", 1, "Two e.g. thr", 1), ("a", 2, "ee.", 1), ("a", 3, "これは。本です。", 1)]
    assert {r.source: r.n for r in docs.select("source", F.size(sentences(F.col("text"))).alias("n")).collect()} == {"a": 4, "b": 0, "c": 0, "d": 0}
