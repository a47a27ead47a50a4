"""JSON snapshots of vectors: one object {key, data, metadata} a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "key string, data array<float>, metadata string, _corrupt_record string"


def write_snapshot(vectors: DataFrame, path: str) -> None:
    vectors.select("key", F.col("vec").alias("data"), F.try_parse_json("meta").alias("metadata")).select(F.to_json(F.struct("key", "data", "metadata")).alias("value")).write.text(path)


def read_snapshot(spark: SparkSession, path: str, dimension: int | None = None) -> DataFrame:
    """(key, vec, meta) of every well-formed object; malformed ones, and vectors of another dimension, are left out."""
    rows = spark.read.schema(SCHEMA).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    good = rows.where("_corrupt_record is null and key is not null and data is not null and not exists(data, x -> x is null)")
    if dimension is not None:
        good = good.where(F.size("data") == dimension)
    return good.select("key", F.col("data").alias("vec"), F.col("metadata").alias("meta"))
