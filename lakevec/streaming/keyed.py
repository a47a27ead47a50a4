"""Documents from a stream into a keyed table: a document that comes again takes the place of all its chunks.

Each micro-batch is one version of the table, under its batch number, so a batch that runs again changes nothing. Within a batch the last
row of a document counts. A batch is staged first: its documents with their state, then its chunks with their vectors, each in one pass that
also counts (``Observation``); the change of the table reads the staged rows. So nothing is parsed or embedded twice, and a batch that died is
staged again. Staged rows go when their version is there.

Defined results: a failed document keeps its old chunks; a document whose text is null or empty, or that is marked deleted, loses them; chunks without
a vector are left out and counted; a null source is an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lakevec.errors import Validation
from lakevec.operators.ingest import attempted, put
from lakevec.sources.keyed import KeyedTable

ROWS = "source string, key string, vec array<float>, meta string"
COUNTS = ("raw", "parsed", "parse_failures", "chunks", "embedded", "embed_failures", "put")


def observed_stats(docs: DataFrame, chunks_of, path: str) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Stage ``docs`` (source, text, failed) and the chunks that ``chunks_of`` makes of those that did not fail below ``path``; returns both as
    stored, and the COUNTS of ``ingest.stats``, taken while the rows were written. Every chunk with a vector counts as put."""
    spark = docs.sparkSession
    seen, made = Observation(), Observation()
    marked = docs.observe(seen, F.count("*").alias("raw"), F.count_if(~F.col("failed")).alias("parsed"), F.count_if("failed").alias("parse_failures"))
    marked.write.mode("overwrite").parquet(f"{path}/docs")
    docs = spark.read.schema(docs.schema).parquet(f"{path}/docs")
    tried = chunks_of(docs.where("not failed"))
    tried = tried.observe(made, F.count("*").alias("chunks"), F.count("vec").alias("embedded"), F.count_if(F.col("vec").isNull()).alias("embed_failures"))
    tried.where("vec is not null").write.mode("overwrite").parquet(f"{path}/chunks")
    counts = seen.get | made.get
    return docs, spark.read.schema(tried.schema).parquet(f"{path}/chunks"), counts | {"put": counts["embedded"]}


def put_batch(table: KeyedTable, docs: DataFrame, version: int, order: str | None = None, **options) -> dict[str, int] | None:
    """Put ``docs`` (source, text; also failed, deleted and ``order`` if there) as ``version``; its COUNTS, or None if it is there already."""
    now = table.version()
    if now is not None and version <= now:
        return None
    for name, value in (("failed", F.lit(False)), ("deleted", F.lit(False))):
        if name not in docs.columns:
            docs = docs.withColumn(name, value)
    row = F.struct("source", "text", "failed", "deleted")
    if order:
        docs = docs.groupBy("source").agg(F.max_by(row, F.struct(order, "text", "failed", "deleted")).alias("row")).select("row.*")
    else:
        docs = docs.select("source", "text", "failed", "deleted").groupBy("source").agg(F.max(row).alias("row")).select("row.*")
    docs = docs.withColumn("source", F.when(F.col("source").isNull(), F.raise_error("a document has no source").cast("string")).otherwise(F.col("source")))

    def chunks_of(rows: DataFrame) -> DataFrame:
        found = attempted(rows.where("not deleted and text <> ''"), **options)
        return put(found, options["dimension"]) if "dimension" in options else found

    staged = f"{table.path}/staged/version={version}"
    docs, found, counts = observed_stats(docs, chunks_of, staged)
    table.replace(version, found.select("source", "key", "vec", "meta"), docs.where("not failed").select("source"))
    fs, path = table._fs(staged)
    fs.delete(path, True)
    return counts


def keyed_ingest(docs: DataFrame, table: KeyedTable, checkpoint: str, order: str | None = None, on_counts=None, **options) -> StreamingQuery:
    """Put a stream of documents into ``table`` until what is there now is read. ``on_counts(version, counts)`` gets the numbers of each batch. A
    new checkpoint goes on after the versions that the table has."""
    spark = docs.sparkSession
    fs, path = table._fs(f"{checkpoint}/first_version")
    if fs.exists(path):
        first = int(spark.read.text(f"{checkpoint}/first_version").first()[0])
    else:
        first = (-1 if (now := table.version()) is None else now) + 1
        spark.createDataFrame([(str(first),)], "value string").coalesce(1).write.text(f"{checkpoint}/first_version")

    def run(batch: DataFrame, number: int) -> None:
        counts = put_batch(table, batch, first + number, order, **options)
        if counts is not None and on_counts:
            on_counts(first + number, counts)

    return docs.writeStream.foreachBatch(run).option("checkpointLocation", f"{checkpoint}/stream").trigger(availableNow=True).start()


def refresh(files: DataFrame, parsed_of, table: KeyedTable, ledger: KeyedTable, **options) -> dict[str, int] | None:
    """Bring ``table`` in line with ``files`` (source, content_hash, ...), a folder as it is now: new and changed files are parsed by
    ``parsed_of`` and replaced, those that are gone lose their chunks, all others are not opened again. ``ledger`` (source, content_hash) is a keyed
    table of what was put; the COUNTS, or None where nothing changed. A run that died between the two tables is made up for by the next."""
    spark = files.sparkSession
    known = ledger.rows().select("source", "content_hash")
    changed = files.join(known, ["source", "content_hash"], "left_anti")
    gone = known.join(files.select("source"), "source", "left_anti").select("source", F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("content_hash"), F.lit(False).alias("failed"), F.lit(True).alias("deleted"))
    parsed = parsed_of(changed).select("source", "text", "content_hash", "failed", F.lit(False).alias("deleted")).unionByName(gone)
    staged = f"{table.path}/staged/changes"
    parsed.write.mode("overwrite").parquet(staged)
    parsed = spark.read.schema(parsed.schema).parquet(staged)
    if parsed.isEmpty():
        return None
    counts = put_batch(table, parsed, (-1 if (v := table.version()) is None else v) + 1, **options)
    done = parsed.where("not failed")
    ledger.replace((-1 if (v := ledger.version()) is None else v) + 1, done.where("not deleted").select("source", "content_hash"), done.select("source"))
    return counts


def new_table(spark, path: str, **options) -> KeyedTable:
    if not path:
        raise Validation("a table needs a path")
    return KeyedTable(spark, path, ROWS, "source", **options)
