"""Table schemas in the JSON form of open table formats, and catalogs as Spark namespaces and tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakevec.errors import Conflict, NotFound, Unsupported, Validation

#: Fixed names of the primitive types.
PRIMITIVES = {"boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "date": T.DateType(), "timestamp": T.TimestampNTZType(), "timestamptz": T.TimestampType(), "string": T.StringType(), "uuid": T.StringType(), "binary": T.BinaryType()}


def spark_type(declared: str | dict) -> T.DataType:
    if isinstance(declared, dict):
        kind = declared.get("type")
        if kind == "list":
            return T.ArrayType(spark_type(declared["element"]), not declared.get("element-required", False))
        if kind == "map":
            return T.MapType(spark_type(declared["key"]), spark_type(declared["value"]), not declared.get("value-required", False))
        if kind == "struct":
            return spark_schema(declared["fields"])
        raise Validation(f"unknown type {declared}")
    if m := re.fullmatch(r"decimal\(\s*(\d+)\s*,\s*(\d+)\s*\)", declared):
        return T.DecimalType(int(m[1]), int(m[2]))
    if re.fullmatch(r"fixed\[\d+\]", declared):
        return T.BinaryType()
    if declared not in PRIMITIVES:
        raise Validation(f"unknown type {declared}")
    return PRIMITIVES[declared]


def normal_fields(fields: list[dict]) -> list[dict]:
    """Fields with what may be left out filled in: the id is the position from 1, required is false."""
    if not isinstance(fields, list):
        raise Validation("schema fields must be an array")
    return [{"id": f.get("id", i), "name": f["name"], "type": f["type"], "required": bool(f.get("required", False))} for i, f in enumerate(fields, 1)]


def spark_schema(fields: list[dict]) -> T.StructType:
    return T.StructType([T.StructField(f["name"], spark_type(f["type"]), not f["required"], {"id": f["id"]}) for f in normal_fields(fields)])


def _name(segments: list[str]) -> str:
    if not segments or any(not s for s in segments):
        raise Validation("a namespace needs at least one segment, none empty")
    return "_".join(segments)


def create_namespace(spark: SparkSession, segments: list[str]) -> str:
    name = _name(segments)
    if spark.catalog.databaseExists(name):
        raise Conflict(name)
    spark.sql(f"CREATE NAMESPACE `{name}`")
    return name


def list_namespaces(spark: SparkSession, prefix: str = "") -> list[str]:
    return sorted(d.name for d in spark.catalog.listDatabases() if d.name.startswith(prefix))


def get_namespace(spark: SparkSession, segments: list[str]) -> str:
    name = _name(segments)
    if not spark.catalog.databaseExists(name):
        raise NotFound(name)
    return name


def drop_namespace(spark: SparkSession, segments: list[str]) -> None:
    """Only an empty namespace goes."""
    name = get_namespace(spark, segments)
    if spark.catalog.listTables(name):
        raise Conflict(f"{name} is not empty")
    spark.sql(f"DROP NAMESPACE `{name}`")


def create_table(spark: SparkSession, namespace: list[str], name: str, fields: list[dict], file_format: str | None = None) -> DataFrame:
    """An empty Parquet table of the declared schema."""
    space = _name(namespace)
    if file_format in ("AVRO", "ORC"):
        raise Unsupported(f"tables are not written as {file_format}")
    if file_format not in (None, "ICEBERG", "PARQUET"):
        raise Validation(f"unknown format {file_format}")
    if not spark.catalog.databaseExists(space):
        raise NotFound(space)
    if spark.catalog.tableExists(f"{space}.{name}"):
        raise Conflict(name)
    spark.createDataFrame([], spark_schema(fields)).write.format("parquet").saveAsTable(f"{space}.{name}")
    return spark.table(f"{space}.{name}")


def drop_table(spark: SparkSession, namespace: list[str], name: str) -> None:
    if not spark.catalog.tableExists(f"{_name(namespace)}.{name}"):
        raise NotFound(name)
    spark.sql(f"DROP TABLE `{_name(namespace)}`.`{name}`")


def read_csv(spark: SparkSession, path: str, fields: list[dict], optional: bool = False, multi_line: bool = True, rejects: str | None = None) -> DataFrame:
    """A CSV file with a header as a table of the declared fields, found by name in any case and cast; what does not cast, and a column
    that the file lacks, is null. A missing file is an error, or with ``optional`` an empty table.

    ``multi_line``: values may hold line breaks, for which a file is one task; without it, a file is read in pieces. ``rejects``: a column of the
    names of the fields whose value did not cast."""
    schema = spark_schema(fields)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at):
        if optional:
            none = spark.createDataFrame([], schema)
            return none if rejects is None else none.withColumn(rejects, F.array().cast("array<string>"))
        raise NotFound(path)
    raw = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').csv(path)
    found = {c.lower(): c for c in raw.columns}
    name = lambda f: found.get(f.name.lower())
    value = lambda f: F.col(f"`{name(f)}`").try_cast(f.dataType) if name(f) else F.lit(None).cast(f.dataType)
    bad = [F.when(F.col(f"`{name(f)}`").isNotNull() & value(f).isNull(), f.name) for f in schema if name(f)]
    more = [] if rejects is None else [F.array_compact(F.array(*bad)).cast("array<string>").alias(rejects)]
    return raw.select(*(value(f).alias(f.name) for f in schema), *more)


def insert_csv(target: DataFrame, path: str, fields: list[dict]) -> DataFrame:
    """``target`` with the rows of a CSV file, by the target's column names."""
    return target.unionByName(read_csv(target.sparkSession, path, fields), allowMissingColumns=True)
