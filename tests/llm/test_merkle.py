import hashlib
import zlib
from collections import defaultdict

import pytest

from lakevec.llm import merkle

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(rows):
    """Brute force over (doc_id, source, lang, n_chars, text) rows, sorted results."""
    leaf = lambda r: H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([H("".join(out[-1][k : k + 16])) for k in range(0, len(out[-1]), 16)])
        return out

    def path(tree, at):
        for level in tree[:-1]:
            run = level[at // 16 * 16 :][:16]
            yield at % 16, run
            at //= 16

    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    sources = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {s: levels([leaf(r) for r in groups[s]]) for s in sources}
    top = levels([trees[s][-1][0] for s in sources])
    root, out = top[-1][0] if rows else None, []
    for k, s in enumerate(sources):
        for at, r in enumerate(groups[s]):
            steps = [*path(trees[s], at), *path(top, k)]
            altered = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            folded = leaf((*r[:4], r[4].translate(LOWER))) if altered else leaf(r)
            for own, run in steps:
                folded = H("".join([*run[:own], folded, *run[own + 1 :]]))
            siblings = "".join(d for own, run in steps for j, d in enumerate(run) if j != own)
            out.append((r[0], leaf(r), trees[s][-1][0], root, H(siblings), folded, folded == root))
    return sorted(out, key=str)


def found(docs):
    return sorted((tuple(r) for r in merkle.proofs(merkle.build(docs)).drop("proof").collect()), key=str)


#: Source sizes around the powers of the arity: lone leaves, whole runs, a last run of one, three levels.
SIZES = (1, 2, 15, 16, 17, 31, 33, 256, 257, 273, 1)


@pytest.mark.parametrize("sources", [1, 3, 16, 17, 40])
def test_equals_brute_force(spark, sources):
    rows = [(1000 * s + k, None if s == 2 else f"sé{s}", "en" if k % 3 else None, k if k % 7 else None, f"Text {k} of {s} Ünï" if k % 11 else None) for s in range(sources) for k in range(SIZES[s % len(SIZES)])]
    docs = spark.createDataFrame(rows[::-1], "doc_id long, source string, lang string, n_chars long, text string").repartition(7)
    got = found(docs)
    assert got == plain(rows) and (sources < 3 or {r[-1] for r in got} == {True, False})


def test_a_hot_source_and_repeated_rows(spark):
    rows = [(k // 3, "hot", "en", 1, "A" if k % 3 else "a") for k in range(3_000)] + [(k, f"s{k}", "en", 1, "B") for k in range(30)]
    assert found(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")) == plain(rows)


def test_edge_rows(spark, edge_docs, no_docs):
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in edge_docs.collect()]
    assert found(edge_docs) == plain(rows)
    assert merkle.build(no_docs).root is None and merkle.proofs(merkle.build(no_docs)).count() == 0
    assert found(edge_docs.where("doc_id = 4")) == plain([r for r in rows if r[0] == 4])


def test_one_task_finishes_what_it_holds_and_hands_on_the_rest():
    """Leaves 3 to 36 of 40: one whole parent, and the children of two others; the rest finishes the tree."""
    digest = [bytes([k]) * 32 for k in range(40)]
    event = lambda numbers: merkle._batch([("t", 40, 0, k, digest[k], None) for k in numbers], merkle._EVENTS)
    rows = [r for b in merkle.combine([event(range(3, 37))]) for r in b.to_pylist()]
    whole, frontier = [r for r in rows if r["children"]], [r for r in rows if not r["children"]]
    assert [(r["level"], r["index"]) for r in whole] == [(1, 1)]
    assert sorted((r["level"], r["index"]) for r in frontier) == [(0, k) for k in [*range(3, 16), *range(32, 37)]] + [(1, 1)]
    again = [event([0, 1, 2, 37, 38, 39]), merkle._batch([tuple(r.values()) for r in frontier][::-1], merkle._EVENTS)]
    rest = [r for b in merkle.combine(again) for r in b.to_pylist()]
    assert sorted((r["level"], r["index"]) for r in rest) == [(1, 0), (1, 2), (2, 0)] and all(r["children"] for r in rest)


def test_proofs_lead_to_the_root(spark, small_docs):
    """The proof as handed out, without the manifest: siblings in order, leaf put where the sizes say."""
    manifest = merkle.build(small_docs)
    sizes = {(r.tree, r.doc_id): (r["index"], r.size) for r in manifest.leaves.collect()}
    tops = {r.source: (r["index"], r.size) for r in manifest.subroots.collect()}
    source = {r.doc_id: "" if r.source is None else f"={r.source}" for r in small_docs.collect()}
    for r in merkle.proofs(manifest).collect():
        node, rest = bytes.fromhex(r.leaf), list(r.proof)
        for index, size in (sizes[source[r.doc_id], r.doc_id], tops[source[r.doc_id]]):
            while size > 1:
                width = min(16, size - index // 16 * 16) - 1
                run, rest = rest[:width], rest[width:]
                run.insert(index % 16, node)
                node, index, size = merkle.parent_digest(b"".join(run)), index // 16, -(-size // 16)
        assert node == manifest.root and not rest
