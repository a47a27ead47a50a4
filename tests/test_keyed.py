import json
import re

import pytest
from pyspark.sql import functions as F

from lakevec.errors import Validation
from lakevec.operators import ingest
from lakevec.sources import keyed
from lakevec.sources.files import eligible, parse_files, read_files
from lakevec.streaming import keyed as stream

OPTIONS = {"chunker": "fixed", "dimension": 8, "size": 20, "overlap": 0}


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, v int")


@pytest.fixture
def table(spark, tmp_path):
    return keyed.KeyedTable(spark, f"{tmp_path}/t", "k string, v int", "k", 8)


def content(table, version=None):
    return sorted(map(tuple, table.rows(version).collect()), key=str)


def test_versions_replace_delete_and_insert(spark, table):
    assert table.version() is None and content(table) == []
    first = frame(spark, [(f"k{n}", n) for n in range(100)] + [(None, -1), ("k1", 101)])
    assert table.replace(0, first) and content(table) == sorted(map(tuple, first.collect()), key=str)
    assert table.replace(1, frame(spark, [("k1", 7), (None, 8), ("new", 9)]))
    want = [(k, v) for k, v in map(tuple, first.collect()) if k not in ("k1", None)] + [("k1", 7), (None, 8), ("new", 9)]
    assert content(table) == sorted(want, key=str)
    assert not table.replace(1, frame(spark, [("k1", 666)])) and content(table) == sorted(want, key=str)  # a replay
    assert table.delete(2, frame(spark, [("k2", 0), ("missing", 0)])) and content(table) == sorted(set(want) - {("k2", 2)}, key=str)
    assert table.insert_new(3, frame(spark, [("k1", 1), ("k2", 22), (None, 0)])) and content(table) == sorted([*(set(want) - {("k2", 2)}), ("k2", 22)], key=str)
    assert content(table, 0) == sorted(map(tuple, first.collect()), key=str)  # older versions stay readable
    with pytest.raises(Validation):
        keyed.KeyedTable(spark, table.path, table.schema, "k", 8).replace(-1, frame(spark, []))


def test_only_touched_buckets_are_written_and_nothing_of_the_target_is_shuffled(spark, table, monkeypatch):
    table.replace(0, frame(spark, [(f"k{n}", n) for n in range(200)]))
    before, plans = table.manifest(), []
    write = type(spark.range(1)).write.fget
    monkeypatch.setattr(type(spark.range(1)), "write", property(lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), write(df))[1]))
    table.replace(1, frame(spark, [("k5", 5)]))
    (plan,) = [p for p in plans if "LeftAnti" in p]
    assert "BroadcastHashJoin" in plan and "BroadcastNestedLoopJoin" not in plan
    kept, changed = re.split(r"\n.*LocalTableScan|\n.*Scan ExistingRDD", plan, maxsplit=1)[0], table.manifest()
    assert "Exchange hashpartitioning(k" not in kept and "SortMergeJoin" not in plan
    assert sum(before[b] != changed[b] for b in before) == 1 and sorted(before) == sorted(changed)


def test_a_run_that_dies_changes_nothing_and_runs_again(spark, table):
    table.replace(0, frame(spark, [("a", 1), ("b", 2)]))
    broken = frame(spark, [("a", 5)]).withColumn("v", F.when(F.col("v") > 0, F.raise_error("lost").cast("int")))
    with pytest.raises(Exception, match="lost"):
        table.replace(1, broken)
    assert table.version() == 0 and content(table) == [("a", 1), ("b", 2)]
    assert table.replace(1, frame(spark, [("a", 5)])) and content(table) == [("a", 5), ("b", 2)]


def test_large_changes_are_joined_by_key(spark, table, monkeypatch):
    table.replace(0, frame(spark, [(f"k{n}", n) for n in range(50)]))
    monkeypatch.setattr(keyed, "BROADCAST_BYTES", 10)
    table.replace(1, frame(spark, [(f"k{n}", -n) for n in range(25)]))
    assert content(table) == sorted([(f"k{n}", -n if n < 25 else n) for n in range(50)], key=str)


def test_vacuum_keeps_what_the_last_versions_need(spark, table):
    for n in range(4):
        table.replace(n, frame(spark, [(f"k{j}", n) for j in range(n, 20)]))
    now, before = content(table), content(table, 2)
    table.vacuum(keep=2)
    assert content(table) == now and content(table, 2) == before and table._versions("manifest", True) == [2, 3]
    table.vacuum()
    assert content(table) == now and table.replace(4, frame(spark, [])) and content(table) == now


def docs_stream(spark, folder):
    return spark.readStream.schema("source string, text string, seq long, deleted boolean").json(folder)


def drop(folder, name, *rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(dict(zip(("source", "text", "seq", "deleted"), r))) for r in rows))


def chunks_by_source(table):
    found = {}
    for r in table.rows().collect():
        found.setdefault(r.source, set()).add(json.loads(r.meta)["S3VECTORS-EMBED-SRC-CONTENT"])
    return found


def test_a_changed_document_takes_the_place_of_its_chunks(spark, tmp_path):
    table, folder, counts = stream.new_table(spark, f"{tmp_path}/t", buckets=4), tmp_path / "in", []
    run = lambda check="ck": stream.keyed_ingest(docs_stream(spark, str(folder)), table, f"{tmp_path}/{check}", "seq", lambda v, c: counts.append((v, c)), **OPTIONS).awaitTermination()
    drop(folder, "1.json", ("a", "alpha " * 20, 1, False), ("b", "beta " * 10, 1, False), ("c", "gone soon", 1, False))
    run()
    assert sorted(chunks_by_source(table)) == ["a", "b", "c"]
    long = table.rows().where("source = 'a'").count()
    drop(folder, "2.json", ("a", "old text", 2, False), ("a", "short", 3, False), ("c", "", 2, True))
    run()
    assert chunks_by_source(table)["a"] == {"short"} and long > 1 and sorted(chunks_by_source(table)) == ["a", "b"]
    rows = sorted(map(str, table.rows().collect()))
    run()  # nothing new
    assert sorted(map(str, table.rows().collect())) == rows and [v for v, _ in counts] == [0, 1]
    assert counts[1][1] == {"raw": 2, "parsed": 2, "parse_failures": 0, "chunks": 1, "embedded": 1, "embed_failures": 0, "put": 1}
    assert stream.put_batch(table, spark.createDataFrame([("a", "replayed")], "source string, text string"), 1, **OPTIONS) is None  # a batch again
    assert sorted(map(str, table.rows().collect())) == rows
    assert len({r.key for r in table.rows().collect()}) == len(rows)
    run("another checkpoint")  # all is put once more under later versions: no stale and no double keys
    assert sorted(map(str, table.rows().collect())) == rows


def test_counts_of_one_pass_equal_stats(spark, tmp_path):
    docs = spark.createDataFrame([("a", "alpha " * 20, False), ("b", None, True), ("c", "fail here " * 5, False), ("d", "", False)], "source string, text string, failed boolean")
    tried = lambda rows: ingest.attempted(rows, **OPTIONS).withColumn("vec", F.when(~F.col("meta").contains("fail"), F.col("vec")))
    stored_docs, found, counts = stream.observed_stats(docs, tried, f"{tmp_path}/s")
    want = ingest.stats(docs, tried(docs.where("not failed"))).first().asDict()
    assert counts == want and counts["embed_failures"] > 0 and found.count() == counts["put"] and stored_docs.count() == 4


def test_failed_documents_keep_their_chunks_and_bad_vectors_stop_a_batch(spark, tmp_path):
    table = stream.new_table(spark, f"{tmp_path}/t", buckets=2)
    put = lambda v, *rows, **more: stream.put_batch(table, spark.createDataFrame(rows, "source string, text string, failed boolean"), v, **(OPTIONS | more))
    put(0, ("a", "kept", False))
    assert put(1, ("a", None, True), ("b", "new", False))["parse_failures"] == 1
    assert chunks_by_source(table) == {"a": {"kept"}, "b": {"new"}}
    for bad in ({"embed": lambda c: F.array(F.lit(1.0), F.lit(2.0))},):
        with pytest.raises(Exception, match="vector must have length 8"):
            put(2, ("a", "bad", False), **bad)
    with pytest.raises(Exception, match="no source"):
        put(2, (None, "x", False))
    assert table.version() == 1 and chunks_by_source(table) == {"a": {"kept"}, "b": {"new"}}


def test_a_folder_is_followed(spark, tmp_path):
    folder = tmp_path / "docs"
    folder.mkdir()
    for name in "abc":
        (folder / f"{name}.txt").write_text(f"text of {name} " * 5)
    table, ledger = stream.new_table(spark, f"{tmp_path}/t", buckets=4), keyed.KeyedTable(spark, f"{tmp_path}/l", "source string, content_hash string", "source", 4)
    again = lambda: stream.refresh(eligible(read_files(spark, str(folder))), parse_files, table, ledger, **OPTIONS)
    assert again()["parsed"] == 3 and again() is None
    (folder / "a.txt").write_text("edited")
    (folder / "b.txt").unlink()
    assert again()["chunks"] == 1
    assert {k.rpartition("/")[2]: v for k, v in chunks_by_source(table).items()} == {"a.txt": {"edited"}, "c.txt": chunks_by_source(table)[next(k for k in chunks_by_source(table) if k.endswith("c.txt"))]}
    assert again() is None
