"""A stored table that is replaced as a whole, or not at all.

Rows of a new version are written beside the old ones first. The version counts from the moment its mark exists, a small
file named by the version's number; a mark is made only where there is none, so of two writers that started from one
version one wins and the other is told. A run that ends between both steps leaves the old version as it was.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer has replaced the version this one started from."""


class VersionedTable:
    """Versions of a table in a shared ``folder``; version 0 is the empty start."""

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _files(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        files, path = self._files(), self._path(folder)
        return sorted(s.getPath().getName() for s in files.listStatus(path)) if files.exists(path) else []

    def version(self) -> int:
        """The newest version."""
        return max([0, *[int(n) for n in self._names("marks") if n.isdigit()]])

    def _place(self, version: int) -> str:
        return self.spark.read.text(f"{self.folder}/marks/{version:012d}").first()[0]

    def read(self, version: int | None = None) -> DataFrame:
        """Rows of a version, the newest one by default."""
        version = self.version() if version is None else version
        if version == 0:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/rows/{self._place(version)}")

    def write(self, rows: DataFrame, version: int) -> str:
        """Write the rows of a version to come, which nobody reads yet; the place to ``publish``."""
        place = f"{version:012d}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/rows/{place}")
        return place

    def publish(self, place: str) -> int:
        """Make written rows the newest version, unless there is one of that number."""
        version = int(place.split("-")[0])
        try:
            mark = self._files().create(self._path(f"marks/{version:012d}"), False)
        except Exception as error:
            if self.version() >= version:
                raise Conflict(f"version {version} of {self.folder} exists") from error
            raise
        mark.write(bytearray(place.encode()))
        mark.close()
        return version

    def replace(self, change: Callable[[DataFrame], DataFrame], tries: int = 5) -> int:
        """Replace the newest version by what ``change`` makes of it; done anew where another writer came first."""
        while True:
            base = self.version()
            try:
                return self.publish(self.write(change(self.read(base)), base + 1))
            except Conflict:
                tries -= 1
                if not tries:
                    raise

    def clean(self, keep: int = 2) -> list[str]:
        """Remove rows of versions before the last ``keep`` and rows that were never published; their places."""
        newest = self.version()
        kept = {self._place(v) for v in range(max(1, newest - keep + 1), newest + 1)}
        # rows of a version to come may still be published
        gone = [n for n in self._names("rows") if n not in kept and int(n.split("-")[0]) <= newest]
        for name in gone:
            self._files().delete(self._path(f"rows/{name}"), True)
        return gone
