"""Session helpers of the numbered operators: shared folder, stored intermediate tables, table readers."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_CONF = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session that names none (tests) gets one of its own."""
    named = spark.sparkContext.getConf().get(_CONF) or spark.conf.get(_CONF, None) or spark.conf.get("lakevec.shared.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError(f"{_CONF} must name a folder that driver and executors share")
        named = f"file://{tempfile.mkdtemp(prefix='lakevec-')}"
        spark.conf.set("lakevec.shared.dir", named)
    return named.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors. The table
    goes when the driver ends, or earlier by ``drop_stored``."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    drop_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/lakevec/{name}-{uuid.uuid4().hex}"


def drop_at_exit(spark: SparkSession, path: str) -> None:
    """Have Spark's file system delete what is stored at ``path`` when the driver ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)


def drop_stored(df: DataFrame) -> None:
    """Delete the files of a ``stored`` table that nothing will read again."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def texts_of(docs: DataFrame, *extra: str) -> DataFrame:
    """doc_id as long and text as string, with no other column than ``extra``, whatever else ``docs`` holds."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *extra)


def map_batches(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: str) -> DataFrame:
    """Apply ``fn`` to each Arrow batch as columns; strings reach it as UTF-8 bytes, nulls as None."""
    from pyspark.sql.types import _parse_datatype_string

    out = _arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = fn(columns(batch))
            yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


def columns(batch: pa.RecordBatch) -> dict[str, list]:
    return {n: (c.cast(pa.binary()) if pa.types.is_string(c.type) else c).to_pylist() for n, c in zip(batch.schema.names, batch.columns)}


def _arrow_schema(struct) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(struct)


def numbered(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` stored in the order of ``group`` and ``order``, with ``index`` (from 0 in each group) and ``size`` (rows of the group).

    Rows are dealt by ranges, so that a hot group spreads over tasks; only one row for each task and group is summed up. The
    numbers are those of the stored rows, so a task that runs again changes none. ``group`` holds no nulls.
    """
    rows = stored(df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order).withColumn("_row", F.monotonically_increasing_id()), name)
    part = F.shiftright("_row", 33)
    marks = rows.groupBy(*group, part.alias("_part")).agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    by_part = Window.partitionBy(*group)
    before = F.coalesce(F.sum("_n").over(by_part.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marks = marks.select(*group, "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(by_part).alias("size"))
    return rows.withColumn("_part", part).join(marks, [*group, "_part"]).select(*df.columns, (F.col("_row") + F.col("_shift")).alias("index"), "size")
