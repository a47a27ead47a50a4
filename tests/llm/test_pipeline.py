import base64
import hashlib
import re

import public_tokenizers
import pytest
import tiktoken

from lakevec.llm import bpe, decontam, substring, toxicity
from lakevec.llm.queries import QUERIES
from tests.llm.test_decontam import plain_score
from tests.llm.test_simhash import brute_force as groups_of
from tests.llm.test_substring import brute_force as windows_of

pipeline = pytest.importorskip("corpus_pipeline")


def leaks(rows, items):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    grams = lambda w: {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
    out = set()
    for doc_id, text in rows:
        w = words(text)
        g = grams(w)
        for item in items:
            i = words(item)
            if g & grams(i) and plain_score(i, w) >= min(decontam.THRESHOLD * len(i), decontam.LONG_SCORE):
                out.add(doc_id)
    return out


def test_every_stage_against_a_plain_version(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    toxic = {r.doc_id for r in QUERIES["op10_toxicity"](spark, sf_dir).where("predicted = 1").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id not in toxic]
    rows = [(i, t) for (i, t) in rows if i in {c for _, _, c in groups_of(rows)}]
    kept = {i: sha for i, _, _, sha in windows_of(rows, substring.WINDOW)}
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]

    now, texts = docs, {}
    for name, stage in pipeline.STAGES[:-1]:
        now = stage(spark, now, sf_dir).cache()
        assert now.columns == docs.columns
        if name == "substring_dedup":
            texts = {r.doc_id: r.text for r in now.collect()}
            assert {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts.items()} == kept
    gone = leaks(texts.items(), items)
    assert {r.doc_id for r in now.collect()} == set(texts) - gone

    with open(public_tokenizers.path(bpe.RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r.ids for r in pipeline.run(spark, sf_dir).collect()}
    assert got == {i: plain.encode_ordinary(t) for i, t in texts.items() if i not in gone}
    assert toxic and gone and len(rows) < docs.count() - len(toxic)


def test_edge_rows(spark, edge_docs, no_docs, sf_dir):
    model = toxicity.train(no_docs, spark.read.parquet(f"{sf_dir}/labels.parquet").limit(0))
    assert toxicity.without_toxic(edge_docs, model).count() == edge_docs.count()
    cut = substring.without_repeats(edge_docs)
    assert cut.columns == edge_docs.columns and cut.count() == edge_docs.count()
    assert {r.doc_id: r.text for r in cut.collect()}[8] == ""
    for _, stage in pipeline.STAGES:
        assert stage(spark, no_docs, sf_dir).count() == 0
