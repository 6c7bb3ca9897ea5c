"""A versioned table in a folder: optimistic commits, reads of whole versions, late deletes.

A version is written to a folder of its own first; a commit then creates the pointer file of the
next number, which fails if another writer made it before. Readers only see versions that have a
pointer. This needs a file system with atomic creation (HDFS, a local or shared POSIX folder);
object stores need a table format instead.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer committed first."""


class VersionedTable:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.folder}/versions"))

    def versions(self) -> list[int]:
        """Numbers of the committed versions."""
        found = self._fs.listStatus(self._path(f"{self.folder}/versions"))
        return sorted(int(f.getPath().getName()) for f in found if f.getPath().getName().isdigit())

    def _data(self, version: int) -> str:
        stream = self._fs.open(self._path(f"{self.folder}/versions/{version}"))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame | None:
        """The latest or a given version; None if there is none."""
        known = self.versions()
        if not known or version is not None and version not in known:
            return None
        return self.spark.read.parquet(self._data(known[-1] if version is None else version))

    def commit(self, df: DataFrame, expected: int) -> int:
        """Writes ``df`` as the version after ``expected`` (0 for the first) or raises Conflict."""
        if (self.versions() or [0])[-1] != expected:
            raise Conflict(f"version {expected} is not the latest")
        data = f"{self.folder}/data/{uuid.uuid4().hex}"
        df.write.parquet(data)
        target = self._path(f"{self.folder}/versions/{expected + 1}")
        try:
            stream = self._fs.create(target, False)  # fails if it is there
        except Exception as e:
            self._fs.delete(self._path(data), True)
            raise Conflict(f"version {expected + 1} was made by another writer") from e
        stream.write(bytearray(data.encode()))
        stream.close()
        return expected + 1

    def vacuum(self, keep: int = 2) -> int:
        """Deletes all but the last ``keep`` versions with their data; returns how many."""
        old = self.versions()[: -keep or None] if keep else self.versions()
        for version in old:
            self._fs.delete(self._path(self._data(version)), True)
            self._fs.delete(self._path(f"{self.folder}/versions/{version}"), False)
        return len(old)
