"""Versions of a folder's contents: each is committed by one writer, all at once, onto the one before.

A version is a file ``_versions/<number>`` that names what belongs to it. It is written aside and renamed to
its place; a rename onto a file that is there fails, so of two writers one wins on any Hadoop file system that
renames atomically, and a reader sees the whole of a version or none of it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer committed this version first."""


class Commits:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _file(self, name: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def latest(self) -> int:
        """0 before the first."""
        fs, folder = self._file("_versions")
        return max((int(x.getPath().getName()) for x in fs.listStatus(folder)), default=0) if fs.exists(folder) else 0

    def content(self, version: int) -> str:
        fs, where = self._file(f"_versions/{version:08d}")
        stream = fs.open(where)
        try:
            return stream.readUTF()
        finally:
            stream.close()

    def commit(self, onto: int, content: str) -> int:
        fs, aside = self._file(f"_aside/{uuid.uuid4().hex}")
        stream = fs.create(aside, False)
        stream.writeUTF(content)
        stream.close()
        _, place = self._file(f"_versions/{onto + 1:08d}")
        fs.mkdirs(place.getParent())
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        context = hadoop.FileContext.getFileContext(aside.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(aside, place, self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0))
        except Exception as e:
            if "FileAlreadyExists" not in str(e):
                raise
            fs.delete(aside, False)
            raise Conflict(f"version {onto + 1} is taken") from None
        return onto + 1
