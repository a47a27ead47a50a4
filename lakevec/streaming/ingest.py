"""The ingestion dataflow as a stream: new files are parsed, chunked and embedded as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lakevec.operators.ingest import embedded, put
from lakevec.sources.files import eligible, extension, parse_files

FILES = "path string, modificationTime timestamp, length long, content binary"


def file_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    found = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch).load(folder)
    return found.select(F.col("path").alias("source"), extension(F.col("path")).alias("ext"), "length", "content").withColumn("content_hash", F.sha2("content", 256))


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, **options) -> StreamingQuery:
    """Append the vectors of all files not seen yet to ``out`` and stop; the checkpoint remembers what is done. With a ``dimension``, a
    vector of another size stops the stream before its batch is committed."""
    vectors = embedded(parse_files(eligible(file_stream(spark, folder))).where("not failed"), **options)
    if "dimension" in options:
        vectors = put(vectors, options["dimension"])
    return vectors.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by type and window, on a stream or a table; rows later than the watermark are left out of a stream."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp"))
    return timed.withWatermark("at", late).groupBy(F.window("at", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
