import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from lakevec.llm import substring
from lakevec.llm.textkernel import RunHasher, sliding_min


def brute_force(rows, window):
    split = [(i, (t or "").encode().split()) for i, t in rows]
    counts = Counter(tuple(w[p : p + window]) for _, w in split for p in range(len(w) - window + 1))
    out = []
    for i, w in split:
        gone = set()
        for p in range(len(w) - window + 1):
            if counts[tuple(w[p : p + window])] > 1:
                gone.update(range(p, p + window))
        kept = b" ".join(x for n, x in enumerate(w) if n not in gone)
        out.append((-1 if i is None else i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def result(df):
    rows = [(-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, hashlib.sha256((r.kept or "").encode()).hexdigest()) for r in df.collect()]
    return sorted(rows)


def test_equals_brute_force(small_docs):
    rows = [(r.doc_id, r.text) for r in small_docs.collect()]
    want = brute_force(rows, substring.WINDOW)
    assert result(substring.repeated_words(small_docs)) == want
    assert sum(r[2] for r in want) > 1000


def test_edge_rows(edge_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.collect() if r.doc_id != 8]
    assert result(substring.repeated_words(edge_docs.where("doc_id is null or doc_id != 8"))) == brute_force(rows, substring.WINDOW)
    long = substring.repeated_words(edge_docs).where("doc_id = 8").first()
    assert (long.n_words, long.n_removed, long.kept) == (60_000, 60_000, "")
    assert substring.repeated_words(edge_docs).where("kept is null").count() == 1
    assert substring.repeated_words(no_docs).count() == 0


@pytest.mark.parametrize("window, anchor", [(5, 2), (7, 7), (6, 1)])
def test_small_windows_with_many_ties(spark, window, anchor):
    random.seed(window)
    rows = [(n, " ".join(random.choices("abc", weights=(6, 2, 1), k=random.randint(0, 60)))) for n in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(substring.repeated_words(docs, window, anchor)) == brute_force(rows, window)


def test_words_that_polynomial_hashes_confuse_stay(spark):
    """Thue-Morse words and their complements collide in every polynomial hash modulo a power of two."""
    word = "a"
    while len(word) < 4096:
        word += word.translate(str.maketrans("ab", "ba"))
    rest = " ".join(f"w{n}" for n in range(34))
    rows = [(1, f"{word} {rest}"), (2, f"{word.translate(str.maketrans('ab', 'ba'))} {rest}"), (3, f"{word} {rest}")]
    assert result(substring.repeated_words(spark.createDataFrame(rows[:2], "doc_id long, text string"))) == brute_force(rows[:2], 35)
    got = substring.repeated_words(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.n_removed) for r in got.collect()) == [(1, 35), (2, 0), (3, 35)]


def test_rows_that_share_an_id_and_clashing_names(spark):
    words = " ".join(f"w{n}" for n in range(80))
    rows = [(1, words, "a"), (1, words[:200], "b"), (1, "other " + words[50:], "c"), (None, words[100:], "d"), (1, None, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _rest string")
    docs = docs.selectExpr("*", *(f"_rest as {c}" for c in ("rest", "carried", "alone", "tag", "id", "kept", "n_words", "c0", "n_chars")))
    want = brute_force([r[:2] for r in rows], 35)
    assert result(substring.repeated_words(docs)) == want
    cut = substring.without_repeats(docs)
    got = cut.collect()
    assert cut.columns == docs.columns and sorted(r._rest for r in got) == list("abcde")
    assert all(r.rest == r.carried == r.tag == r.kept == r._rest for r in got) and {r._rest: r.text for r in got}["e"] is None


def test_no_estimate_is_below_the_count():
    random.seed(3)
    texts = [" ".join(random.choices("abcd", k=200)).encode() for _ in range(20)]
    windows = substring.Windows(texts, RunHasher(1), 9, 3)
    counted = Counter(windows.starts.tolist())
    words = [t.split() for t in texts]
    exact = Counter(tuple(w[p : p + 9]) for w in words for p in range(len(w) - 8))
    keys = [tuple(w[p : p + 9]) for w in words for p in range(len(w) - 8)]
    assert all(counted[a] >= exact[k] for a, k in zip(windows.anchors.tolist(), keys))


def test_a_dealt_sketch_equals_brute_force(spark, small_docs, edge_docs, monkeypatch):
    """Beyond MAX_CELLS: the sketch's cells are rows, and anchors are joined to them."""
    monkeypatch.setattr(substring, "MAX_CELLS", 1)
    assert result(substring.repeated_words(small_docs)) == brute_force([(r.doc_id, r.text) for r in small_docs.collect()], substring.WINDOW)
    rows = [(r.doc_id, r.text) for r in edge_docs.collect() if r.doc_id != 8]
    assert result(substring.repeated_words(edge_docs.where("doc_id is null or doc_id != 8"))) == brute_force(rows, substring.WINDOW)
    assert substring.repeated_words(edge_docs.limit(0)).count() == 0 and substring.without_repeats(edge_docs).columns == edge_docs.columns


def test_a_dealt_sketch_rejects_single_windows_at_any_size(spark, monkeypatch):
    """As text grows tenfold the share of single windows that pass stays; the few repeated ones all pass."""
    rng = random.Random(5)
    monkeypatch.setattr(substring, "MIN_CELLS", 64)
    shares = []
    for n in (40, 400):
        rows = [(k, " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(300))) for k in range(n)]
        shared = " ".join(f"shared{k}" for k in range(40))
        rows[3], rows[7] = (3, f"{rows[3][1]} {shared}"), (7, f"{shared} {rows[7][1]}")
        docs = spark.createDataFrame(rows, "id long, text string").withColumn("tag", substring.F.lit(0).cast("long"))
        cells = substring.sketch_cells(sum(len(t) for _, t in rows))
        found = substring.repeated_anchors(docs, cells).collect()
        every = sum(len(set(substring.Windows([t.encode()], RunHasher(1), 35, 12).anchors.tolist())) for _, t in rows)
        assert {r.id for r in found} >= {3, 7}
        shares.append(len(found) / every)
    assert max(shares) < 0.15 and shares[1] < 2 * shares[0] + 0.05


def test_sliding_min():
    x = np.random.default_rng(1).integers(0, 50, 101).astype(np.uint64)
    for width in (1, 2, 7, 101):
        assert sliding_min(x, width).tolist() == [min(x[i : i + width]) for i in range(len(x) - width + 1)]
