"""A keyed table on plain Parquet: rows dealt by key into buckets, of which a change rewrites those it touches only.

A version is a folder of Parquet buckets and a manifest that says which version holds each bucket. A change is a version:
the rows of touched buckets that it does not replace, and its own, are written side by side with the old ones; writing the manifest
makes it the current one, so readers see a change whole or not at all, and a run that dies leaves the last version current. The same
version again does nothing once its manifest is there, and the same as before if it is not. Files of versions that no
kept manifest names go with ``vacuum``.

Rows of the target are never shuffled: they pass by a broadcast of the changed keys where these take up to BROADCAST_BYTES (beyond, by a
join of the touched buckets with the keys), and are written by the tasks that read them. One writer at a time.

Defined results: null keys are a key of their own; keys that are not there do nothing; several rows of a key stay together; a change without
keys makes a version with the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakevec.errors import Validation

BUCKETS, BROADCAST_BYTES = 64, 64 << 20
_ENTRIES = "bucket int, version long"


@dataclass(frozen=True)
class KeyedTable:
    """``schema``: of the rows, as DDL; ``key``: the column whose rows are replaced together."""

    spark: SparkSession
    path: str
    schema: str
    key: str
    buckets: int = BUCKETS

    def _fs(self, path: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _versions(self, folder: str, done: bool) -> list[int]:
        fs, path = self._fs(f"{self.path}/{folder}")
        names = [f.getPath() for f in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(p.getName().rpartition("=")[2]) for p in names if not done or self._exists(f"{p.toString()}/_SUCCESS"))

    def _exists(self, path: str) -> bool:
        fs, path = self._fs(path)
        return fs.exists(path)

    def version(self) -> int | None:
        """The current version; None before the first."""
        return max(self._versions("manifest", True), default=None)

    def manifest(self, version: int | None = None) -> dict[int, int]:
        """The version that holds each bucket with rows: at most ``buckets`` numbers."""
        version = self.version() if version is None else version
        if version is None:
            return {}
        rows = self.spark.read.schema(_ENTRIES).parquet(f"{self.path}/manifest/version={version}")
        return {r.bucket: r.version for r in rows.collect()}

    def rows(self, version: int | None = None, buckets: set[int] | None = None) -> DataFrame:
        """The rows of a version, of the current one by default; of some buckets with ``buckets``."""
        entries = self.manifest(version)
        paths = [f"{self.path}/data/version={v}/bucket={b}" for b, v in sorted(entries.items()) if buckets is None or b in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def bucket(self, key: str | Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def replace(self, version: int, rows: DataFrame, keys: DataFrame | None = None) -> bool:
        """Make ``version``: the rows of ``keys`` (its one column, or the keys of ``rows`` without it) go, ``rows`` come. False if it is there
        already. ``rows`` and ``keys`` are read more than once: hand in stored tables."""
        now = self.version()
        if now is not None and version <= now:
            if version in self._versions("manifest", True):
                return False
            raise Validation(f"version {version} is older than {now}")
        keys = rows.select(self.key) if keys is None else keys
        keys = keys.select(F.col(keys.columns[0]).alias("_gone")).distinct()
        entries = self.manifest(now)
        touched = {r[0] for r in keys.select(self.bucket("_gone").alias("b")).unionByName(rows.select(self.bucket(self.key).alias("b"))).distinct().collect()}  # at most ``buckets``
        size = keys.agg(F.coalesce(F.sum(F.octet_length(F.col("_gone").cast("string")) + 32), F.lit(0))).first()[0]
        gone = F.broadcast(keys) if size <= BROADCAST_BYTES else keys
        kept = self.rows(now, touched)
        kept = kept.join(gone, F.col(self.key).eqNullSafe(F.col("_gone")), "left_anti").withColumn("bucket", self.bucket(self.key))
        put = rows.select(*kept.columns[:-1]).withColumn("bucket", self.bucket(self.key)).repartition("bucket")
        data = f"{self.path}/data/version={version}"
        kept.unionByName(put).write.mode("overwrite").partitionBy("bucket").parquet(data)
        written = {b for b in touched if self._exists(f"{data}/bucket={b}")}
        new = {b: v for b, v in entries.items() if b not in touched} | dict.fromkeys(written, version)
        self.spark.createDataFrame(sorted(new.items()), _ENTRIES).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/version={version}")
        return True

    def delete(self, version: int, keys: DataFrame) -> bool:
        return self.replace(version, self.spark.createDataFrame([], self.schema), keys)

    def insert_new(self, version: int, rows: DataFrame) -> bool:
        """Rows whose key is not there yet come; a second run adds none. ``rows`` is a stored table."""
        here = {r[0] for r in rows.select(self.bucket(self.key).alias("b")).distinct().collect()}
        keys = rows.select(F.col(self.key).alias("_new")).distinct()
        known = self.rows(None, here).select(self.key).join(keys, F.col(self.key).eqNullSafe(F.col("_new")), "left_semi").distinct()
        return self.replace(version, rows.join(known.withColumnRenamed(self.key, "_known"), F.col(self.key).eqNullSafe(F.col("_known")), "left_anti"))

    def vacuum(self, keep: int = 1) -> list[int]:
        """Delete all but the last ``keep`` versions, and data that none of these holds; the versions whose data went."""
        done = self._versions("manifest", True)
        used = {v for version in done[-keep:] for v in self.manifest(version).values()} | set(done[-keep:])
        old = [v for v in self._versions("data", False) if v not in used]
        for folder, versions in (("manifest", [v for v in self._versions("manifest", False) if v not in done[-keep:]]), ("data", old)):
            for v in versions:
                fs, path = self._fs(f"{self.path}/{folder}/version={v}")
                fs.delete(path, True)
        for v in set(self._versions("data", False)):  # buckets of kept versions that a later one holds
            held = {b for version in done[-keep:] for b, own in self.manifest(version).items() if own == v}
            fs, path = self._fs(f"{self.path}/data/version={v}")
            for entry in fs.listStatus(path):
                name = entry.getPath().getName()
                if name.startswith("bucket=") and int(name[7:]) not in held:
                    fs.delete(entry.getPath(), True)
        return old
