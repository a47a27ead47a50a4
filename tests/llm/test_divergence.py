import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lakevec.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, top):
    """Brute force over (text, lang, source) rows."""
    rows = [(t or "", lang or "", s or "") for t, lang, s in rows]
    df, n, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        terms = TERM.findall(text.translate(LOWER))
        df[lang].update(set(terms))
        n[lang, source].update(terms)
        n[lang, None].update(terms)
        groups[lang].add(source)
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, k in df[lang].items() if k >= least]

        def shares(group, kept=kept):
            total = sum(n[group][t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (n[group][t] + 5) // total for t in kept}

        q = shares((lang, None))
        p = {s: shares((lang, s)) for s in sources}
        for s in sources:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources - {s}]
            terms = [(q[t] - p[s][t], t.encode(), t) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, item, -value, rank) for rank, (value, _, item) in enumerate(found, 1)}
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = ["Straße", "word", "Word", "été", "漢字", "a-b", "x_y", "don't", "ÄB", "z9z", *(f"w{chr(97 + k)}" for k in range(26))]
    text = lambda: " ".join(rng.choices(words, k=rng.randint(0, 30)))
    made = [(text(), rng.choice(["en", "de"]), f"s{rng.randint(0, 5)}") for _ in range(300)]
    made += [(text(), "en", "hot") for _ in range(200)]  # a hot source
    return [*made, *made[:20], (None, None, None), ("", "fr", "x"), ("only a few words", "fr", "y"), ("!!! 123", "en", "no-terms"), ("one", "", "alone"), ("word " * 5000, "en", "long")]


@pytest.mark.parametrize("block", [1_000, 3])
def test_equals_brute_force(spark, rows, block):
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    docs = docs.withColumns({n: divergence.F.lit(n) for n in ("term", "part", "item", "n", "v", "one", "index")})
    got = [tuple(r) for r in divergence.divergence(docs, min_documents=20, top=7, block=block).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(rows, 20, 7)


def test_small_tables_and_batches_change_nothing(spark, rows):
    docs = spark.createDataFrame(rows, "text string, lang string, source string").na.fill("")
    whole = {tuple(r) for r in divergence.kept_runs(divergence.counted(docs), 10).collect() for r in [(r.lang, r.term, tuple(r.sources), tuple(r.counts), r.n)]}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        small = divergence.kept_runs(divergence.counted(docs.repartition(9), most=5), 10)
        assert {(r.lang, r.term, tuple(r.sources), tuple(r.counts), r.n) for r in small.collect()} == whole and whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_terms_of_long_texts_are_not_cut(monkeypatch):
    text = ("straße " * 50 + "x" * 9_000 + " End1end ").encode() * 3
    want = [w.encode() for w in TERM.findall(text.decode().translate(LOWER))]
    for size in (1, 7, 64, 5_000, 1 << 20):
        monkeypatch.setattr(divergence, "TEXT_BYTES", size)
        assert [w for part in divergence.terms_of(text) for w in part] == want


def test_shares_are_exact_beyond_64_bits():
    counts, n = [0, 3, 10**10, 4 * 10**17], [10**18, 10**12, 2 * 10**10, 5 * 10**17]
    got = divergence.shares(np.array(counts), np.array(n), 7)
    assert got.tolist() == [1 + 10**9 * (c + 5) // (m + 35) for c, m in zip(counts, n)]


def test_nothing(spark, no_docs, edge_docs):
    assert divergence.divergence(no_docs).count() == 0
    got = {tuple(r) for r in divergence.divergence(edge_docs).collect()}
    assert got == plain([(r.text, r.lang, r.source) for r in edge_docs.collect()], 30, 50)
