"""Versioned tables in a shared folder: a write makes a new version, a pointer names the current one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

SCHEMA_VERSION = 1


class SnapshotStore:
    """Tables under `folder`; readers see either the old or the new version of a table, never a part.

    A version is written to a folder of its own before the pointer is replaced, so an interrupted write
    changes nothing. Writing the same version id again is a no-op, which makes batches idempotent.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def versions(self, table: str) -> list[int]:
        """Committed versions; each has a marker whose creation is atomic."""
        found = self._fs.globStatus(self._path(f"{table}/_done-*"))
        return sorted(int(s.getPath().getName().split("-")[1]) for s in found or [])

    def read(self, table: str, version: int | None = None) -> DataFrame | None:
        have = self.versions(table)
        if not have:
            return None
        return self.spark.read.parquet(f"{self.folder}/{table}/v-{have[-1] if version is None else version}")

    def write(self, table: str, df: DataFrame, version: int) -> None:
        if version in self.versions(table):
            return
        staged = f"{table}/_staged-{version}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder}/{staged}")
        final = self._path(f"{table}/v-{version}")
        if self._fs.exists(final):  # left by a run that died before its marker
            self._fs.delete(final, True)
        if not self._fs.rename(self._path(staged), final):
            raise OSError(f"version {version} of {table} could not be written")
        self._fs.create(self._path(f"{table}/_done-{version}"), False).close()

    def drop_before(self, table: str, keep: int) -> None:
        """Removes all but the newest `keep` versions."""
        for v in self.versions(table)[:-keep]:
            self._fs.delete(self._path(f"{table}/_done-{v}"), False)
            self._fs.delete(self._path(f"{table}/v-{v}"), True)
