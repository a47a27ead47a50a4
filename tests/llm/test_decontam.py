import random
import re
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest

from lakevec.llm import decontam


def plain_score(item, doc):
    row, best = [0] * (len(doc) + 1), 0
    for a in item:
        new = [0]
        for j, b in enumerate(doc, 1):
            new.append(max(0, row[j - 1] + (1 if a == b else -1), row[j] - 1, new[j - 1] - 1))
        row, best = new, max(best, *new)
    return best


def test_alignment_equals_plain_dynamic_programming():
    rng = random.Random(4)
    for _ in range(200):
        item = [rng.randint(0, 5) for _ in range(rng.randint(1, 12))]
        doc = [rng.randint(0, 5) for _ in range(rng.randint(0, 30))]
        assert decontam.smith_waterman(np.array(item), np.array(doc, dtype=np.int64))[0] == plain_score(item, doc)


@pytest.fixture(scope="module")
def planted(spark):
    """Items, verbatim and edited copies inside other prose, and clean documents that share stock phrases with items."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(3, 7)))
    prose = lambda n: ["of the and" if rng.random() < 0.15 else word() for _ in range(n)]
    items = [(i, " ".join(["of the and", *prose(30)])) for i in range(8)]
    rows, want = [], set()
    for i, text in items:
        words = text.split()
        rows.append((100 + i, " ".join([*prose(50), text.upper().replace(" ", ", "), *prose(20)])))
        edited = [word() if rng.random() < 0.12 else w for w in words]
        del edited[10]
        edited.insert(20, "extra")
        rows.append((200 + i, " ".join([*prose(400), *edited, *prose(3)])))
        want |= {(100 + i, i), (200 + i, i)}
    rows += [(300 + n, " ".join(prose(200))) for n in range(40)] + [(400 + n, rows[0][1]) for n in range(20)] + [(500, None), (501, "")]
    want |= {(400 + n, 0) for n in range(20)}
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*items, (9, None), (11, "zz")], "item_id long, text string"), want


def test_finds_copies_and_edited_copies(planted):
    docs, benchmark, want = planted
    got = decontam.contaminated(docs, benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    assert all(r.score == 1 for r in got if 100 <= r.doc_id < 200)
    left = {r.doc_id for r in decontam.without_leaks(docs, benchmark).collect()}
    assert left == {r.doc_id for r in docs.collect()} - {d for d, _ in want}


@pytest.mark.parametrize("copies", [1, 5, 1000])
@pytest.mark.parametrize("edit", ["substituted", "tail", "every fourth"])
def test_edited_copies_are_found_however_often(spark, copies, edit):
    item = [f"i{k}" for k in range(40)]
    gone = {"substituted": (5, 14, 23, 32), "tail": range(30, 40), "every fourth": range(3, 40, 4)}[edit]
    copy = [f"x{k}" if k in gone else w for k, w in enumerate(item)]
    rows = [(n, " ".join([f"a{n}", "b", *copy, f"c{n}"])) for n in range(copies)]
    docs = spark.createDataFrame([*rows, (-1, "i0 i1 i2 only")], "doc_id long, text string")
    got = decontam.contaminated(docs, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == list(range(copies)) and {r.score for r in got} == {plain_score(item, copy) / 40}


def test_the_bound_loses_nothing():
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randint(0, 9)}" for _ in range(n)) for n in [*range(3, 40), *range(3, 40), 200, 400]]
    items = [" ".join(f"w{rng.randint(0, 9)}" for _ in range(rng.randint(3, 30))) for _ in range(60)]
    found = decontam.Benchmark(list(enumerate(items))).matches([t.encode() for t in texts])
    for text, got in zip(texts, found):
        doc = text.split()
        grams = {tuple(doc[k : k + 3]) for k in range(len(doc) - 2)}
        scores = {i: plain_score(x.split(), doc) / len(x.split()) for i, x in enumerate(items) if any(tuple(x.split()[k : k + 3]) in grams for k in range(len(x.split()) - 2))}
        assert {i: s for i, s, *_ in got} == {i: s for i, s in scores.items() if s * len(items[i].split()) >= decontam.needed(len(items[i].split()))}


def test_parts_of_the_benchmark_change_nothing(planted, monkeypatch):
    docs, benchmark, want = planted
    monkeypatch.setattr(decontam, "MAX_BENCHMARK_BYTES", 500)
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, benchmark).collect()} == want
    left = {r.doc_id for r in decontam.without_leaks(docs, benchmark).collect()}
    assert left == {r.doc_id for r in docs.collect()} - {d for d, _ in want}


def test_long_excerpts_short_items_and_confusable_words(spark):
    item = [f"i{k}" for k in range(80)]
    word = "a"
    while len(word) < 2048:  # these two collide in polynomial hashes modulo a power of two
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    items = [(1, " ".join(item)), (2, "yes indeed"), (3, "no"), (4, f"{word} {word} x y"), (5, "of the"), (5, "of the")]
    docs = [(1, "a b " + " ".join(item[20:45])), (2, " ".join(item[20:44])), (3, "No, yes; INDEED!"), (4, f"{other} {other} z"), (5, "yes no indeed"), (6, "the of the")]
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, round(r.score * 80), r.first_word, r.n_words) for r in got if r.item_id == 1) == [(1, 1, 25, 0, 27)]
    assert sorted((r.doc_id, r.item_id) for r in got if r.item_id > 1) == [(3, 2), (3, 3), (5, 3), (6, 5), (6, 5)]


def test_many_words_need_pairs():
    ids = np.array([5, 3_000_000, 7, 5, 3_000_000, 9, -1, 7, 5, 3_000_000])
    at = np.array([0, 1, 2, 3, 7])
    small, large = decontam.GramIndex(ids[:7], at[:4], 1 << 20), decontam.GramIndex(ids[:7], at[:4], 1 << 22)
    assert large.pairs is not None and small.pairs is None and [x.tolist() for x in large.find(ids, at)][0] == [0, 1, 2, 3, 7]


def test_recall_of_edited_copies_against_all_alignments(spark):
    """Copies with a share of words replaced, dropped or moved; every pair is aligned in full, with or without a seed."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 6)))
    items, docs = [[word() for _ in range(rng.randint(12, 60))] for _ in range(30)], []
    for n in range(240):
        copy = [w for w in items[n % 30] if rng.random() > n % 8 * 0.03]
        copy = [word() if rng.random() < n % 10 * 0.04 else w for w in copy]
        docs.append([word() for _ in range(20)] + copy + [word() for _ in range(9)])
    reach = lambda item, doc: plain_score(item, doc) >= decontam.needed(len(item))
    want = {(d, i) for d, doc in enumerate(docs) for i in {d % 30, (d + 7) % 30} if reach(items[i], doc)}
    found = decontam.contaminated(spark.createDataFrame([(d, " ".join(x)) for d, x in enumerate(docs)], "doc_id long, text string"), spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    assert len(want) > 120 and len(got & want) >= 0.99 * len(want) and all(reach(items[i], docs[d]) for d, i in got)


def test_stock_phrases_are_no_leaks(spark):
    """Questions whose beginnings and ends clean text is full of; the questions themselves, whole and edited, are found."""
    items = [(1, "What is the capital of France?"), (2, "What is the name of the author of this book?"), (3, "one two three four five six seven eight")]
    clean = ["My question is simple: what is the point of gardening in winter?", "Tell me what is the name of your dog and the author of nothing", "Count with me: one two three four, and again one two three four"]
    docs = [(n, t) for n, t in enumerate(clean)] + [(10, "He asked what is the capital of France and left"), (11, "so what is the name of the author of that book then"), (12, "one two three four five seven eight")]
    frames = lambda docs, items: (spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(*frames(docs, items)).collect()}
    assert {d for d, _ in got} == {10, 11} and {r.doc_id for r in decontam.without_leaks(*frames(docs, items)).collect()} == {0, 1, 2, 12}


@pytest.mark.parametrize("copies", [1, 40])
def test_precision_on_clean_text_and_recall_of_copies(spark, copies):
    """Items are half stock phrases. Clean texts hold these phrases, some of them both of an item's; copies are edited, however often repeated."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(3, 7)))
    stock = ["which of the following statements best describes the main idea of", "according to the passage above what can be inferred about the author and", "choose the answer that best completes the sentence below given that"]
    items = [(i, f"{stock[i % 3]} {' '.join(word() for _ in range(rng.randint(4, 6)))} {stock[(i + 1) % 3]}") for i in range(12)]
    clean = [(1_000 + n, " ".join([*(word() for _ in range(30)), stock[n % 3], *(word() for _ in range(9 if n % 5 else 3)), stock[(n + 1) % 3 if n % 5 == 0 else n % 3], word()])) for n in range(400)]
    leaks = []
    for i, text in items:
        words = text.split()
        for n in range(copies):
            edited = [word() if rng.random() < 0.08 else w for w in words]
            leaks.append((10 * i + n % 10, " ".join([word(), word(), *edited, word()])))
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(spark.createDataFrame(clean + leaks, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {(d, d // 10) for d, _ in leaks}
    assert len(got & want) >= 0.9 * len(want) and not {d for d, _ in got if d >= 1_000}
    assert len(got - want) <= 0.1 * len(want)


def test_a_large_benchmark_is_bounded_in_memory():
    """20 MB of items: three parts, each made within 600 MB of the driver's Python and pickled to less than its budget."""
    script = """
import pickle, random, resource, sys
sys.path.insert(0, sys.argv[1])
from lakevec.llm import decontam
rng = random.Random(1)
words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(200_000)]
before, sizes = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, []
for part in range(3):
    items, size = [], 0
    while size < 20e6 / 3:
        items.append((len(items), " ".join(rng.choices(words, k=60)))); size += len(items[-1][1])
    sizes.append(len(pickle.dumps(decontam.Benchmark(items))))
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024, max(sizes) >> 20)
"""
    out = subprocess.run([sys.executable, "-c", script, str(Path(__file__).resolve().parents[2])], capture_output=True, text=True, timeout=300)
    grown, pickled = map(int, out.stdout.split()[-2:])
    assert grown < 600 and pickled < 100 and decontam.MAX_BENCHMARK_BYTES >= 20e6 / 3


def test_equals_brute_force(spark, small_docs, sf_dir):
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    items = [(r.item_id, words(r.text)) for r in benchmark.collect()]
    want = set()
    for r in small_docs.limit(60).collect():
        doc = words(r.text)
        grams = {tuple(doc[k : k + 3]) for k in range(len(doc) - 2)}
        for i, item in items:
            if any(tuple(item[k : k + 3]) in grams for k in range(len(item) - 2)) and plain_score(item, doc) >= decontam.needed(len(item)):
                want.add((r.doc_id, i))
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(small_docs.limit(60), benchmark).collect()} == want


def test_edge_rows(spark, edge_docs, no_docs):
    benchmark = spark.createDataFrame([(1, "ünïcode wörds 漢字 tis it s two spaces here"), (None, "a row without an id"), (None, None)], "item_id long, text string").withColumn("doc_id", decontam.F.lit(7))
    got = sorted((str(r.doc_id), str(r.item_id)) for r in decontam.contaminated(edge_docs, benchmark).collect())
    assert got == [("6", "1"), ("6", "1"), ("None", "None")]
    assert decontam.contaminated(no_docs, benchmark).count() == 0
    assert decontam.contaminated(edge_docs, benchmark.limit(0)).count() == 0
    assert decontam.without_leaks(edge_docs, benchmark).columns == edge_docs.columns
